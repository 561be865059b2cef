"""Chat, evaluation and payload queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill import tables
from docmill.functions import text as T
from docmill.functions.arrays import let
from docmill.operators import chat as H
from docmill.operators import enrichment as N
from docmill.operators import evaluation as V
from docmill.operators import search as S
from docmill.operators.vector_search import vector_search
from docmill.plans import sql as Q

KEY = ["message_id"]


def _talk(spark, root):
    return tables.load(spark, root, "conversations")


def _text(col: str):
    return F.col(col).cast("string")


# --- messages ------------------------------------------------------------------------------

_NAMES = ["weather", "Meteo", "météo", "rag", "KB", "nobody", "as sistant", "assistant"]


def _addressed(spark, root):
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.col("turn").cast("int"))
    return _talk(spark, root).select(
        "conv_id", "turn",
        F.when(F.col("conv_id") % 3 == 0, F.col("text"))
        .otherwise(F.concat(F.lit("@"), name, F.lit("\n "), "text", F.lit("  "))).alias("message"))


ADDRESSED = f"""
addressed AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 <> 0
    THEN [{', '.join(f"'{n}'" for n in _NAMES)}][turn + 1] END AS name FROM conversations)
"""


def q_parse_mention(spark, root):
    return H.parse_mention(_addressed(spark, root)).select(
        "conv_id", "turn", "agent_id", F.md5("clean_message").alias("message_md5"))


def _requests(spark, root):
    """Messages as requests; some are made too long, blank or unsafe, or get odd names."""
    return _talk(spark, root).select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", F.concat("text", F.lit(" <ScRiPt>")))
        .when(F.col("turn") == 5, F.lit(" \n\t "))
        .when(F.col("turn") == 6, F.repeat(F.col("text"), 40))
        .otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("message"),
        F.when(F.col("conv_id") % 5 == 0, F.lit(None)).when(F.col("conv_id") % 5 == 1, F.lit("bad id!"))
        .when(F.col("conv_id") % 5 == 2, F.repeat(F.lit("x"), 101))
        .otherwise(F.concat(F.lit("s_"), _text("conv_id"))).alias("session_id"),
        F.when(F.col("turn") == 1, F.lit("vendor/model:1.5 beta")).when(F.col("turn") == 2, F.lit("vendor/model:1.5"))
        .alias("model"))


def q_validate_messages(spark, root):
    return H.validate_messages(_requests(spark, root)).select(
        "conv_id", "turn", "valid", "reason", F.md5("message").alias("message_md5"))


def _cited(spark, root):
    """Answers with citations, links, glued brackets and double brackets in them."""
    return _talk(spark, root).select(
        "conv_id", "turn",
        F.concat(
            F.regexp_replace("text", r"\.", F.concat(F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("]."))),
            F.lit(" see ["), _text("conv_id"), F.lit("](link) x[9] [["), _text("turn"),
            F.lit("]] [12][13] é[14] [x] [15]")).alias("answer"))


def q_cited_indices(spark, root):
    return _cited(spark, root).select(
        "conv_id", "turn", F.array_join(H.cited_indices(F.col("answer")).cast("array<string>"), ",").alias("cited"))


def q_history_filter(spark, root):
    """Turns after an earlier history of as many messages as the conversation number mod 3."""
    rows = _talk(spark, root).withColumn("prior", F.col("conv_id") % 3)
    kept = H.history_filter(rows, "conv_id", F.floor(F.col("turn") / 1000), [F.col("turn")], "prior")
    return kept.select("conv_id", "turn", "role", F.col("message_no").cast("bigint").alias("message_no"))


def q_model_switch_segments(spark, root):
    model = (
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 3, F.lit(None))
        .when((F.col("conv_id") + F.floor(F.col("turn") / 3)) % 3 == 0, "small").otherwise("large"))
    rows = _talk(spark, root).select("conv_id", "turn", model.alias("model"))
    return H.model_segment(rows, "conv_id", "turn").select("conv_id", "turn", "model")


# --- sources -------------------------------------------------------------------------------


def _sources(spark, root):
    """Order lines as the sources of an answer (the order)."""
    return tables.load(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("message_id"),
        (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("position"),
        F.concat(F.lit("Part "), _text("l_partkey")).alias("title"),
        F.concat(F.lit("docs/s"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".md")).alias("path"),
        (F.col("l_quantity") / 50.0).alias("similarity"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("https://example.org/"), _text("l_suppkey"), F.lit(".PDF")))
        .when(F.col("l_returnflag") == "R", F.lit("https://example.org/page")).alias("url"),
        F.when(F.col("l_linestatus") == "F", F.lit("")).otherwise(F.lit("words")).alias("content"),
        F.when(F.col("l_partkey") % 5 == 0, "inside").alias("metadata_content"))


SOURCES = """
sources AS (SELECT l_orderkey AS message_id,
    l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS position,
    'Part ' || l_partkey AS title, 'docs/s' || (l_suppkey % 7) || '.md' AS path, l_quantity / 50.0::DOUBLE AS similarity,
    CASE l_returnflag WHEN 'A' THEN 'https://example.org/' || l_suppkey || '.PDF'
                      WHEN 'R' THEN 'https://example.org/page' END AS url,
    l_returnflag = 'A' AND l_linestatus = 'F' AND l_partkey % 5 <> 0 AS bare
  FROM lineitem),
cites AS (SELECT o_orderkey AS message_id, o_custkey % 6 + 1 AS a, o_custkey % 4 + 3 AS b FROM orders)
"""


def _answers(spark, root):
    """Answers of orders cite two numbers each."""
    a, b = (F.col("o_custkey") % 6 + 1).cast("string"), (F.col("o_custkey") % 4 + 3).cast("string")
    return tables.load(spark, root, "orders").select(
        F.col("o_orderkey").alias("message_id"),
        F.concat(F.lit("As said in ["), a, F.lit("] and ["), b, F.lit("], not [99](x).")).alias("answer"))


def q_sources_event(spark, root):
    events = H.sources_event(_sources(spark, root), _answers(spark, root), KEY)
    shown = F.transform("sources", lambda s: F.concat(
        s["path"], F.lit("@"), F.round(s["similarity"] * 100, 0).cast("int").cast("string")))
    return events.select(
        "message_id", F.array_join(shown, ";").alias("sources"),
        F.array_join(F.col("cited_indices").cast("array<string>"), ",").alias("cited"))


def _chunk_list(col: str = "chunks"):
    return F.array_join(F.transform(col, lambda c: F.round(c["similarity"] * 100, 0).cast("int").cast("string")), ";")


def q_group_sources(spark, root):
    return H.group_sources(_sources(spark, root), KEY).select(
        "message_id", F.col("group_no").cast("bigint").alias("group_no"), "path", "title", "url",
        F.round("max_similarity", 9).alias("max_similarity"), _chunk_list().alias("chunks"))


def q_filter_group_sources(spark, root):
    cited = _answers(spark, root).select("message_id", H.cited_indices(F.col("answer")).alias("cited_indices"))
    shown = H.filter_group_sources(_sources(spark, root), cited, KEY)
    return shown.select(
        "message_id", F.col("shown_no").cast("bigint").alias("shown_no"), "path", "title", "cited",
        F.round("max_similarity", 9).alias("max_similarity"), _chunk_list().alias("chunks"))


def q_dedup_sources(spark, root):
    return H.dedup_sources(_sources(spark, root), KEY).select(
        "message_id", "path", "position", "title", F.round("similarity", 9).alias("similarity"))


# --- tool calls ----------------------------------------------------------------------------


def _events(spark, root):
    return tables.load(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def q_pair_tool_calls(spark, root):
    """Views and clicks as calls; purchases and sign-ups as results of the same user and k."""
    events = _events(spark, root).withColumn(
        "call_id", F.concat(_text("user_id"), F.lit(":"), F.get_json_object("props", "$.k")))
    calls = events.where("event_type in ('view', 'click')").select("event_id", "call_id", F.col("event_type").alias("tool_name"))
    results = events.where("event_type in ('purchase', 'signup')").select(
        "call_id", "ts", "event_id", F.concat("event_type", F.lit(" "), _text("value")).alias("result"))
    return H.pair_tool_calls(calls, results, ["ts", "event_id"]).select(
        "event_id", "call_id", "tool_name", "tool_result")


def q_tool_call_runs(spark, root):
    """Events of a user as tool calls; six-hour buckets bound every window."""
    events = _events(spark, root)
    bucket = F.floor(F.unix_seconds("ts") / 21600)
    runs = H.tool_call_runs(events, "user_id", bucket, ["ts", "event_id"], "event_type")
    return runs.select(
        "user_id", F.col("group_no").cast("bigint").alias("group_no"), "event_type", "count",
        F.col("first_call.event_id").alias("first_event"))


def _calls(spark, root):
    return _talk(spark, root).select(
        F.col("conv_id").alias("session_id"), "turn",
        F.when(F.col("role") == "user", "search").when(F.col("role") == "assistant", "weather")
        .otherwise("listing").alias("tool_name"),
        F.when(F.col("role") == "system", "{}").when(
            F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("query")))).alias("args"))


def q_tool_usage(spark, root):
    return H.tool_usage(_calls(spark, root), ["turn"]).select("session_id", "tool_name", "calls", "first_call")


def q_tool_calls(spark, root):
    """Every call of a session in order, with its arguments as shown."""
    listed = H.list_tool_calls(_calls(spark, root), "session_id", F.floor(F.col("turn") / 1000), ["turn"])
    return listed.select("session_id", F.col("call_no").cast("bigint").alias("call_no"), "shown")


# --- event streams -------------------------------------------------------------------------


def _bodies(spark, root, talk=None):
    """Every message as event text: a token per word, a tool call, a broken event, an event
    without data, sources, the end and a piece cut off."""
    words = F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1))
    tokens = F.transform(words, lambda w: F.concat(
        F.lit("event: token\ndata: "), F.to_json(F.struct(w.alias("content"))), F.lit("\n\n")))
    return (_talk(spark, root) if talk is None else talk).select(
        "conv_id", "turn",
        F.concat(
            F.lit('event: tool_call\ndata: {"tool_name": "search", "tool_args": {"limit": 3}}\n\n'),
            F.array_join(tokens, ""),
            F.lit("event: token\ndata: {broken\n\nevent: token\n\n"),
            F.lit('event: sources\ndata: {"content": "", "sources": [{"title": "t'), _text("turn"),
            F.lit('"}], "cited_indices": [1]}\n\n'),
            F.when(F.col("role") == "system", F.lit('event: error\ndata: {"content": "stopped"}\n\n'))
            .otherwise(F.lit('event: done\ndata: {"content": ""}\n\n')),
            F.lit('event: token\ndata: {"content": "cut off"}')).alias("body"))


def q_sse_parse(spark, root):
    # dealt without a key, so that messages of one conversation and turn, or without them, are no one task
    rows = H.parse_sse(_bodies(None, None, tables.spread(_talk(spark, root))), ["conv_id", "turn"])
    return rows.select(
        "conv_id", "turn", F.col("seq").cast("bigint").alias("seq"), "type", "content", "sources", "tool_name", "tool_args")


def q_assemble_message(spark, root):
    events = H.parse_sse(_bodies(None, None, tables.spread(_talk(spark, root), "conv_id", "turn")), ["conv_id", "turn"])
    done = H.assemble_messages(events, ["conv_id", "turn"])
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat(c["tool_name"], c["tool_args"])), "|")
    return done.select(
        "conv_id", "turn", F.md5("content").alias("content_md5"), F.length("content").cast("bigint").alias("size"),
        "sources", "cited_indices", calls.alias("tool_calls"), "error", "done")


# --- evaluation ----------------------------------------------------------------------------


def _golden(spark, root):
    """Benchmark texts as golden questions; their words are the expected keywords."""
    words = F.array_distinct(T.tokens(F.col("query")))
    return tables.question_table(spark, root).select(
        "query_id", words.alias("expected_keywords"),
        F.when(F.length("query") % 3 == 0, "semantic").when(F.length("query") % 3 == 1, "keyword")
        .otherwise("procedural").alias("query_type"))


def _eval_inputs(spark, root):
    return (tables.query_table(spark, root), tables.chunk_texts(spark, root), tables.document_table(spark, root))


def _eval_vectors(spark, root):
    return tables.chunk_vectors(spark, root)


def q_keyword_hits(spark, root):
    found = vector_search(*_eval_inputs(spark, root), k=5, threshold=0.2, vectors=_eval_vectors(spark, root))
    return V.keyword_hits(found, _golden(spark, root)).select(
        "query_id", "query_type", F.col("hits").cast("bigint").alias("hits"),
        F.col("total").cast("bigint").alias("total"), F.round("top_similarity", 9).alias("top_similarity"))


def q_search_benchmark(spark, root):
    golden = _golden(spark, root)
    near = V.keyword_hits(vector_search(*_eval_inputs(spark, root), k=5, threshold=0.2, vectors=_eval_vectors(spark, root)), golden)
    both = V.keyword_hits(S.hybrid_search(*_eval_inputs(spark, root), k=5, threshold=0.2, vectors=_eval_vectors(spark, root)), golden)
    return V.compare_search(near, both).select(
        "query_type", "vector_hits", "hybrid_hits", "total",
        F.round("vector_similarity", 9).alias("vector_similarity"),
        F.round("hybrid_similarity", 9).alias("hybrid_similarity"), "winner")


def q_threshold_sweep(spark, root):
    queries = tables.query_table(spark, root)
    found = vector_search(*_eval_inputs(spark, root), k=10, threshold=0.0, vectors=_eval_vectors(spark, root))
    return V.threshold_sweep(queries, found).select(
        "query_id", "threshold", "results", F.round("max_similarity", 9).alias("max_similarity"),
        F.round("avg_similarity", 9).alias("avg_similarity"), F.round("min_similarity", 9).alias("min_similarity"))


def q_threshold_recommend(spark, root):
    queries = tables.query_table(spark, root)
    found = vector_search(*_eval_inputs(spark, root), k=30, threshold=0.3, vectors=_eval_vectors(spark, root))
    sweep = V.threshold_sweep(queries, found, V.ANALYSIS_GRID)
    return V.recommend_threshold(sweep).select(
        "query_id", "recommended", F.round("best_similarity", 9).alias("best_similarity"), "relevance")


# --- payloads ------------------------------------------------------------------------------

_CODES = [0, 1, 2, 3, 45, 48, 51, 61, 71, 80, 95, 99, 7, 42]


def _weather(spark, root):
    """Events as weather payloads: value as temperature, k as humidity, thirty hours ahead."""
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("event_id") % len(_CODES)).cast("int"))
    # k is read out of the text once a row, not once an hour
    hours = let(k, lambda k: F.transform(F.sequence(F.lit(0), F.lit(29)), lambda h: (h * 7 + k) % 31 + F.lit(0.5)))
    return tables.spread(_events(spark, root), "event_id", rows=20_000).select(
        "event_id", F.concat(F.lit("station "), _text("user_id")).alias("location_name"),
        F.to_json(F.struct(
            F.struct(F.col("value").alias("temperature_2m"), k.alias("relative_humidity_2m"),
                     code.alias("weather_code"), (k / 2.0).alias("wind_speed_10m")).alias("current"),
            F.struct(hours.alias("temperature_2m")).alias("hourly"))).alias("payload"))


def q_weather_readings(spark, root):
    return N.weather_readings(_weather(spark, root)).select(
        "event_id", "location_name", "temperature", "unit", "description", "humidity", "wind_kmh",
        "high_24h", "low_24h")


def q_weather_by_location(spark, root):
    return N.weather_by_location(N.weather_readings(_weather(spark, root))).select(
        "location_name", "readings", "high", "low", F.round("avg_temperature", 9).alias("avg_temperature"))


def q_parse_location(spark, root):
    k = F.get_json_object("props", "$.k")
    asked = (
        F.when(F.col("event_type") == "view", F.concat(_text("value"), F.lit(",-"), k, F.lit(".25")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Place "), k, F.lit(", North")))
        .when(F.col("event_type") == "error", F.concat(k, F.lit(", "), k))
        .otherwise(F.concat(F.lit("town"), k)))
    rows = _events(spark, root).select("event_id", asked.alias("location"))
    lat, lon, name = N.parse_location(F.col("location"))
    return rows.select("event_id", "location", lat.alias("lat"), lon.alias("lon"), name.alias("name"))


def _features(spark, root):
    """Customers as worksites: a square around a point, or two for one segment; some without
    geometry, some asked in a third language."""
    x = F.col("c_custkey") % 180 + F.lit(0.5)
    y = F.col("c_custkey") % 90 + F.lit(0.25)

    def ring(dx: float):
        at = lambda a, b: F.array(x + F.lit(a + dx), y + F.lit(b))
        return F.array(at(0.0, 0.0), at(0.0, 1.0), at(1.0, 1.0), at(1.0, 0.0), at(0.0, 0.0))

    multi = F.col("c_mktsegment") == "BUILDING"
    coordinates = F.when(multi, F.to_json(F.array(F.array(ring(0.0)), F.array(ring(10.0))))).otherwise(
        F.to_json(F.array(ring(0.0))))
    geometry = F.concat(
        F.lit('{"type":"'), F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'),
        coordinates, F.lit("}"))
    properties = F.to_json(F.struct(
        F.col("c_name").alias("LABEL_FR"), F.concat(F.lit("nl "), "c_name").alias("LABEL_NL"),
        F.col("c_mktsegment").alias("STATUS_FR"), F.lit("2024-01-05").alias("PGM_START_DATE")))
    return tables.load(spark, root, "customer").select(
        F.col("c_custkey").alias("id_ws"),
        F.when(F.col("c_custkey") % 3 == 0, "nl").when(F.col("c_custkey") % 3 == 1, "en").otherwise("fr").alias("language"),
        F.concat(
            F.lit('{"type":"Feature",'),
            F.when(F.col("c_nationkey") > 20, F.lit('"geometry":{},')).otherwise(
                F.concat(F.lit('"geometry":'), geometry, F.lit(","))),
            F.lit('"properties":'), properties, F.lit("}")).alias("feature"))


def q_feature_flatten(spark, root):
    return N.feature_flatten(_features(spark, root)).select(
        "id_ws", "language", "geometry_type", "label", "label_fr", "label_nl", "status_fr", "status_nl", "pgm_start_date")


def q_polygon_bounds(spark, root):
    return N.polygon_bounds(N.feature_flatten(_features(spark, root))).select(
        "id_ws", F.col("points").cast("bigint").alias("points"), "south", "west", "north", "east")


QUERIES = {
    "parse_mention": q_parse_mention,
    "validate_messages": q_validate_messages,
    "cited_indices": q_cited_indices,
    "history_filter": q_history_filter,
    "model_switch_segments": q_model_switch_segments,
    "sources_event": q_sources_event,
    "group_sources": q_group_sources,
    "filter_group_sources": q_filter_group_sources,
    "dedup_sources": q_dedup_sources,
    "pair_tool_calls": q_pair_tool_calls,
    "tool_call_runs": q_tool_call_runs,
    "tool_usage": q_tool_usage,
    "tool_calls": q_tool_calls,
    "sse_parse": q_sse_parse,
    "assemble_message": q_assemble_message,
    "keyword_hits": q_keyword_hits,
    "search_benchmark": q_search_benchmark,
    "threshold_sweep": q_threshold_sweep,
    "threshold_recommend": q_threshold_recommend,
    "weather_readings": q_weather_readings,
    "weather_by_location": q_weather_by_location,
    "parse_location": q_parse_location,
    "feature_flatten": q_feature_flatten,
    "polygon_bounds": q_polygon_bounds,
}

_GROUPS = """
groups AS (SELECT message_id, path, min(position) AS first_position, arg_min(title, position) AS title,
    arg_min(coalesce(url, ''), position) AS url0, max(similarity) AS max_similarity, bool_or(is_cited) AS cited,
    string_agg(round(similarity * 100)::INT::VARCHAR, ';' ORDER BY similarity DESC, position) AS chunks
  FROM marked GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY max_similarity DESC, first_position) AS group_no
  FROM groups)
"""
_CALLS = """
WITH c AS (SELECT conv_id AS session_id, turn, CASE role WHEN 'user' THEN 'search'
      WHEN 'assistant' THEN 'weather' ELSE 'listing' END AS tool_name,
    CASE WHEN role = 'system' THEN '' ELSE ' (query=''' || CASE WHEN length(text) > 50
      THEN substr(text, 1, 50) || '...' ELSE text END || '''' || CASE WHEN turn % 2 = 0 THEN ', limit=' || turn ELSE '' END
      || ')' END AS args FROM conversations)
"""
_GOLDEN = f"""
golden AS (SELECT query_id, length(query) AS n,
    list_distinct({Q.tokens('query')}) AS kw,
    CASE length(query) % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' ELSE 'procedural' END AS query_type FROM asked)
"""


def _hits(name: str, leg: str, sim: str) -> str:
    return f"""
{name}_text AS (SELECT r.query_id, string_agg(lower(c.content || ' ' || d.title), ' ' ORDER BY r.rank) AS t,
    arg_min({sim}, r.rank) AS top FROM {leg} r JOIN chunks c USING (chunk_id)
    JOIN docs d ON d.document_id = c.document_id GROUP BY r.query_id),
{name} AS (SELECT g.query_id, g.query_type, len(g.kw) AS total,
    coalesce(len(list_filter(g.kw, lambda k: contains(x.t, k))), 0) AS hits, coalesce(x.top, 0) AS top
    FROM golden g LEFT JOIN {name}_text x USING (query_id))
"""


_CODE_SQL = f"[{', '.join(map(str, _CODES))}][event_id % {len(_CODES)} + 1]"
_K = "json_extract_string(props, '$.k')"
_WEATHER = f"""
payload AS (SELECT event_id, 'station ' || user_id AS location_name, value AS temperature, {_K}::INT AS k,
    {_CODE_SQL} AS code FROM events),
readings AS (SELECT *, (SELECT max((h * 7 + k) % 31 + 0.5::DOUBLE) FROM range(24) t(h)) AS high_24h,
    (SELECT min((h * 7 + k) % 31 + 0.5::DOUBLE) FROM range(24) t(h)) AS low_24h FROM payload)
"""
_DESCRIBE = " ".join(f"WHEN {c} THEN '{t}'" for c, t in N.WEATHER_CODES.items())

ORACLES = {
    "parse_mention": f"""WITH {ADDRESSED},
known AS (SELECT *, CASE lower(name) WHEN 'weather' THEN 'weather' WHEN 'meteo' THEN 'weather' WHEN 'rag' THEN 'rag'
    WHEN 'kb' THEN 'rag' WHEN 'assistant' THEN 'rag' END AS agent_id FROM addressed)
SELECT conv_id, turn, agent_id, md5(CASE WHEN agent_id IS NOT NULL THEN {Q.strip('text')}
    WHEN name IS NULL THEN text ELSE '@' || name || chr(10) || ' ' || text || '  ' END) AS message_md5 FROM known""",
    "validate_messages": f"""
WITH r AS (SELECT conv_id, turn,
    CASE WHEN role = 'system' THEN text || ' <ScRiPt>' WHEN turn = 5 THEN ' ' || chr(10) || chr(9) || ' '
         WHEN turn = 6 THEN repeat(text, 40) ELSE '  ' || text || chr(10) END AS m,
    conv_id % 5 AS s, turn AS t FROM conversations),
c AS (SELECT *, CASE WHEN length(m) > 10000 THEN 'message too long' WHEN {Q.strip('m')} = '' THEN 'message empty'
    WHEN contains(lower(m), '<script') THEN 'message has script' WHEN s = 2 THEN 'session too long'
    WHEN s = 1 THEN 'session format' WHEN t = 1 THEN 'model format' END AS reason FROM r)
SELECT conv_id, turn, reason IS NULL AS valid, reason, md5({Q.strip('m')}) AS message_md5 FROM c""",
    "cited_indices": r"""
WITH a AS (SELECT conv_id, turn, replace(text, '.', ' [' || (turn + 1) || '].') || ' see [' || conv_id || '](link) x[9] [['
    || turn || ']] [12][13] é[14] [x] [15]' AS answer FROM conversations),
p AS (SELECT conv_id, turn, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM (
    SELECT conv_id, turn, string_split(answer, '[') AS ps FROM a)),
l AS (SELECT *, coalesce(nullif(right(lag(piece) OVER (PARTITION BY conv_id, turn ORDER BY i), 1), ''), '[') AS prev FROM p),
n AS (SELECT DISTINCT conv_id, turn, regexp_extract(piece, '^([0-9]+)\]', 1)::BIGINT AS no FROM l
    WHERE i > 0 AND regexp_matches(piece, '^[0-9]+\]([^(]|$)') AND NOT regexp_matches(prev, '[\p{L}\p{N}_]')),
g AS (SELECT conv_id, turn, string_agg(no::VARCHAR, ',' ORDER BY no) AS cited FROM n GROUP BY ALL)
SELECT a.conv_id, a.turn, coalesce(g.cited, '') AS cited FROM a LEFT JOIN g USING (conv_id, turn)""",
    "history_filter": """
SELECT conv_id, turn, role, message_no FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_no FROM conversations WHERE role <> 'system')
WHERE message_no > conv_id % 3""",
    "model_switch_segments": """
WITH m AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN NULL
    WHEN (conv_id + turn // 3) % 3 = 0 THEN 'small' ELSE 'large' END AS model FROM conversations),
f AS (SELECT *, last_value(model IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m),
s AS (SELECT *, sum((model IS NOT NULL AND prev IS NOT NULL AND model <> prev)::INT) OVER (
    PARTITION BY conv_id ORDER BY turn) AS seg FROM f)
SELECT conv_id, turn, model FROM (SELECT *, max(seg) OVER (PARTITION BY conv_id) AS last FROM s) WHERE seg = last""",
    "sources_event": f"""WITH {SOURCES}
SELECT s.message_id, string_agg(s.path || '@' || round(s.similarity * 100)::INT, ';' ORDER BY s.similarity DESC, s.position) AS sources,
       any_value(CASE WHEN c.a = c.b THEN c.a::VARCHAR ELSE least(c.a, c.b) || ',' || greatest(c.a, c.b) END) AS cited
FROM sources s JOIN cites c USING (message_id) GROUP BY s.message_id""",
    "group_sources": f"""WITH {SOURCES}, marked AS (SELECT *, false AS is_cited FROM sources), {_GROUPS}
SELECT message_id, group_no, path, title, nullif(url0, '') AS url, round(max_similarity, 9) AS max_similarity, chunks
FROM ranked""",
    "filter_group_sources": f"""WITH {SOURCES},
kept AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY position) AS no FROM sources WHERE NOT bare),
marked AS (SELECT k.*, coalesce(k.no = c.a OR k.no = c.b, false) AS is_cited FROM kept k LEFT JOIN cites c USING (message_id)),
{_GROUPS},
shown AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY cited DESC, group_no) AS shown_no FROM ranked)
SELECT message_id, shown_no, path, title, cited, round(max_similarity, 9) AS max_similarity, chunks
FROM shown WHERE cited OR shown_no <= 5""",
    "dedup_sources": f"""WITH {SOURCES}
SELECT message_id, path, position, title, round(similarity, 9) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id, path ORDER BY similarity DESC, position) AS r FROM sources)
WHERE r = 1""",
    "pair_tool_calls": f"""
WITH e AS (SELECT *, user_id || ':' || {_K} AS call_id FROM events),
r AS (SELECT call_id, last(event_type || ' ' || value ORDER BY ts, event_id) AS tool_result FROM e
      WHERE event_type IN ('purchase', 'signup') GROUP BY call_id)
SELECT event_id, call_id, event_type AS tool_name, tool_result FROM e LEFT JOIN r USING (call_id)
WHERE event_type IN ('view', 'click')""",
    "tool_call_runs": """
WITH c AS (SELECT *, coalesce(lag(event_type) OVER w <> event_type, true)::INT AS change FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS group_no FROM c)
SELECT user_id, group_no, any_value(event_type) AS event_type, count(*) AS count,
       first(event_id ORDER BY ts, event_id) AS first_event FROM g GROUP BY user_id, group_no""",
    "tool_calls": f"""{_CALLS}
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS call_no, tool_name || args AS shown FROM c""",
    "tool_usage": f"""{_CALLS}
SELECT session_id, tool_name, count(*) AS calls, arg_min(tool_name || args, turn) AS first_call FROM c GROUP BY ALL""",
    "sse_parse": r"""
WITH w AS (SELECT conv_id, turn, role, regexp_extract_all(text, '\S+\s*') AS ws FROM conversations),
e AS (SELECT conv_id, turn, 0 AS seq, 'tool_call' AS type, '' AS content, NULL AS sources, 'search' AS tool_name,
        '{"limit":3}' AS tool_args FROM w
  UNION ALL SELECT conv_id, turn, unnest(range(1, len(ws) + 1)), 'token', unnest(ws), NULL, NULL, NULL FROM w
  UNION ALL SELECT conv_id, turn, len(ws) + 3, 'sources', '', '[{"title":"t' || turn || '"}]', NULL, NULL FROM w
  UNION ALL SELECT conv_id, turn, len(ws) + 4, CASE WHEN role = 'system' THEN 'error' ELSE 'done' END,
        CASE WHEN role = 'system' THEN 'stopped' ELSE '' END, NULL, NULL, NULL FROM w)
SELECT conv_id, turn, seq::BIGINT AS seq, type, content, sources, tool_name, tool_args FROM e""",
    "assemble_message": rf"""
WITH w AS (SELECT conv_id, turn, role, array_to_string(regexp_extract_all(text, '\S+\s*'), '') AS content FROM conversations)
SELECT conv_id, turn, md5(content) AS content_md5, length(content) AS size, '[{{"title":"t' || turn || '"}}]' AS sources,
       '[1]' AS cited_indices, 'search{{"limit":3}}' AS tool_calls, CASE WHEN role = 'system' THEN 'stopped' END AS error,
       role <> 'system' AS done FROM w""",
    "keyword_hits": f"""WITH {Q.CORPUS}, {Q.nearest('vector_leg', 5, 0.2, False)}, {_GOLDEN},
{_hits('near', 'vector_leg', 'r.similarity')}
SELECT query_id, query_type, hits, total, round(top, 9) AS top_similarity FROM near""",
    "search_benchmark": f"""WITH {Q.CORPUS}, {Q.fusion(k=5, threshold=0.2)},
{Q.nearest('plain_leg', 5, 0.2, False)}, {_GOLDEN},
{_hits('near', 'plain_leg', 'r.similarity')}, {_hits('both_ways', 'hybrid', 'r.similarity')}
SELECT coalesce(n.query_type, 'TOTAL') AS query_type, sum(n.hits)::BIGINT AS vector_hits, sum(b.hits)::BIGINT AS hybrid_hits,
       sum(n.total)::BIGINT AS total, round(avg(n.top), 9) AS vector_similarity, round(avg(b.top), 9) AS hybrid_similarity,
       CASE WHEN sum(b.hits) > sum(n.hits) THEN 'HYBRID' WHEN sum(n.hits) > sum(b.hits) THEN 'VECTOR' ELSE 'TIE' END AS winner
FROM near n JOIN both_ways b USING (query_id) GROUP BY ROLLUP (n.query_type)""",
    "threshold_sweep": f"""WITH {Q.CORPUS}, {Q.nearest('vector_leg', 10, 0.0, False)},
grid AS (SELECT unnest([{', '.join(map(str, V.SWEEP_GRID))}])::DOUBLE AS threshold)
SELECT a.query_id, g.threshold, count(v.chunk_id) AS results, round(max(v.similarity), 9) AS max_similarity,
       round(avg(v.similarity), 9) AS avg_similarity, round(min(v.similarity), 9) AS min_similarity
FROM asked a CROSS JOIN grid g LEFT JOIN vector_leg v ON v.query_id = a.query_id AND v.similarity >= g.threshold
GROUP BY ALL""",
    "threshold_recommend": f"""WITH {Q.CORPUS}, {Q.nearest('vector_leg', 30, 0.3, False)},
grid AS (SELECT unnest([{', '.join(map(str, V.ANALYSIS_GRID))}])::DOUBLE AS threshold),
sweep AS (SELECT a.query_id, g.threshold, max(v.similarity) AS m
  FROM asked a CROSS JOIN grid g LEFT JOIN vector_leg v ON v.query_id = a.query_id AND v.similarity >= g.threshold GROUP BY ALL)
SELECT query_id, max(threshold) FILTER (m >= 0.4) AS recommended, round(max(m), 9) AS best_similarity,
       CASE WHEN max(m) >= 0.7 THEN 'HIGH' WHEN max(m) >= 0.5 THEN 'MEDIUM' WHEN max(m) >= 0.4 THEN 'LOW' ELSE 'VERY LOW' END AS relevance
FROM sweep GROUP BY query_id""",
    "weather_readings": f"""WITH {_WEATHER}
SELECT event_id, location_name, temperature, '°C' AS unit, CASE code {_DESCRIBE} ELSE 'weather code ' || code END AS description,
       k AS humidity, k / 2.0::DOUBLE AS wind_kmh, high_24h, low_24h FROM readings""",
    "weather_by_location": f"""WITH {_WEATHER}
SELECT location_name, count(*) AS readings, max(high_24h) AS high, min(low_24h) AS low, round(avg(temperature), 9) AS avg_temperature
FROM readings GROUP BY location_name""",
    "parse_location": f"""
SELECT event_id, CASE event_type WHEN 'view' THEN value || ',-' || k || '.25' WHEN 'click' THEN 'Place ' || k || ', North'
         WHEN 'error' THEN k || ', ' || k ELSE 'town' || k END AS location,
       CASE WHEN event_type = 'view' THEN value END AS lat, CASE WHEN event_type = 'view' THEN -(k::INT) - 0.25::DOUBLE END AS lon,
       CASE WHEN event_type = 'view' THEN printf('%.2f°, %.2f°', value, -(k::INT) - 0.25::DOUBLE) END AS name
FROM (SELECT *, {_K} AS k FROM events)""",
    "feature_flatten": """
SELECT c_custkey AS id_ws, CASE WHEN c_custkey % 3 = 0 THEN 'nl' ELSE 'fr' END AS language,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type,
       CASE WHEN c_custkey % 3 = 0 THEN 'nl ' ELSE '' END || c_name AS label, c_name AS label_fr, 'nl ' || c_name AS label_nl,
       c_mktsegment AS status_fr, NULL::VARCHAR AS status_nl, '2024-01-05' AS pgm_start_date
FROM customer WHERE c_nationkey <= 20""",
    "polygon_bounds": """
SELECT c_custkey AS id_ws, CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 5 END::BIGINT AS points,
       c_custkey % 90 + 0.25::DOUBLE AS south, c_custkey % 180 + 0.5::DOUBLE AS west, c_custkey % 90 + 1.25::DOUBLE AS north,
       c_custkey % 180 + CASE WHEN c_mktsegment = 'BUILDING' THEN 11.5 ELSE 1.5 END::DOUBLE AS east
FROM customer WHERE c_nationkey <= 20""",
}
