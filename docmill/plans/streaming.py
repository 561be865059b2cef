"""Session, request and streaming queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill import tables
from docmill.operators import chat as H
from docmill.operators import sessions as E
from docmill.plans import sql as Q
from docmill.plans.chat import ORACLES as CHAT
from docmill.plans.chat import _bodies
from docmill.plans.ingest import sliding
from docmill.session import checkpoint_dir
from docmill.streaming import jobs


WAVES = 3
_END_HOURS = 1  # the last event comes so long after all others that every limit is over


def _events(spark, root):
    return tables.load(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, root, name) -> DataFrame:
    table = tables.load(spark, root, name)
    rows = jobs.read_table_stream(spark, root, f"{name}.parquet", table.schema)
    tasks = tables.tasks_needed(table)
    return rows.repartition(tasks) if tasks else rows


def _run(spark, rows: DataFrame) -> DataFrame:
    """Run a stream over what is there now and read its output."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = jobs.append_batches(rows, f"{base}/out", f"{base}/checkpoint", availableNow=True)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def _session_columns(rows):
    # times as microseconds: the same value in every session time zone
    return rows.select(
        "user_id", F.unix_micros("session_start").alias("session_start"),
        F.unix_micros("last_event").alias("last_event"), "events")


def q_session_expiry(spark, root):
    return _session_columns(E.sessions(_events(spark, root), "user_id"))


def q_stream_closed_sessions(spark, root):
    """The sessions that the stream knows to be over; those still open stay in its state."""
    return _session_columns(_run(spark, jobs.session_stream(_stream(spark, root, "events"), "user_id")))


def q_stream_ingest(spark, root):
    rows = _run(spark, jobs.ingest_stream(_stream(spark, root, "documents")))
    return rows.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.md5("content").alias("content_md5"), "is_toc")


def q_stream_assemble(spark, root):
    """Event text arriving as a stream, assembled per message as batches come in."""
    talk = _stream(spark, root, "conversations")
    events = H.parse_sse(_bodies(None, None, talk), ["conv_id", "turn"])
    done = _run(spark, jobs.assemble_stream(events, ["conv_id", "turn"]))
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat(c["tool_name"], c["tool_args"])), "|")
    return done.select(
        "conv_id", "turn", F.md5("content").alias("content_md5"), F.length("content").cast("bigint").alias("size"),
        "sources", "cited_indices", calls.alias("tool_calls"), "error", "done")


def _run_in_waves(spark, rows: DataFrame, wave, job) -> DataFrame:
    """Run ``job`` over ``rows`` that arrive in waves (0, 1, ...): after each wave the stream is
    started again and goes on from its state. The rows are made once; a start of the stream sees the
    folders of the waves up to its own."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = rows.withColumn("wave", wave)
    table.where(F.col("wave").between(0, WAVES - 1)).write.partitionBy("wave").parquet(f"{base}/in")
    for number in range(WAVES):
        # folders by name: one without rows is not there, which a pattern takes
        out = job(spark.readStream.schema(rows.schema).parquet(f"{base}/in/wave=[0-{number}]"))
        jobs.append_batches(out, f"{base}/out", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _pieces(spark, root) -> DataFrame:
    """Event text cut every few bytes, also inside letters; a wave has a third of each connection,
    an hour after the one before."""
    bodies = _bodies(None, None, tables.spread(tables.load(spark, root, "conversations"), "conv_id", "turn"))
    size = 5 + F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(90))
    count = F.ceil(F.octet_length("body") / size).cast("int")
    cut = bodies.select(
        "conv_id", "turn", F.col("body").cast("binary").alias("body"), size.cast("int").alias("size"), count.alias("count"),
        F.explode_outer(F.sequence(F.lit(0), count - 1)).alias("piece_no"))
    wave = F.floor(F.col("piece_no") * WAVES / F.col("count")).cast("int")
    return cut.select(
        "conv_id", "turn", "piece_no", F.timestamp_seconds(F.lit(1_700_000_000) + wave * 3600).alias("ts"),
        F.substring("body", F.col("piece_no") * F.col("size") + 1, F.col("size")).alias("piece"), wave.alias("part"))


def q_stream_sse(spark, root):
    """Events out of pieces that end anywhere, over three starts of the stream."""
    key = ["conv_id", "turn"]

    def job(pieces):
        return jobs.parse_frames(jobs.frame_stream(pieces, key, idle_seconds=2 * 3600), key)

    rows = _run_in_waves(spark, _pieces(spark, root), F.col("part"), job)
    return rows.select("conv_id", "turn", "seq", "type", "content", "sources", "tool_name", "tool_args")


_START = 1_700_000_000


def _timed_events(spark, root) -> DataFrame:
    """A message starts every 200 seconds of its conversation's hours: a token per word, half a
    second apart up to 30 seconds, then the end. Every third turn has no end but a late token."""
    talk = tables.spread(tables.load(spark, root, "conversations"), "conv_id", "turn")
    words = F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1))
    start = F.lit(_START) + F.col("conv_id") * 2_000 + F.col("turn") * 200

    def event(kind, content, after):
        return F.struct(F.lit(kind).alias("type"), content.alias("content"), after.cast("double").alias("after"))

    said = F.transform(words, lambda w, i: event("token", w, F.least(i / 2, F.lit(30.0))))
    end = F.when(F.col("turn") % 3 == 2, event("token", F.lit("late"), F.lit(75.0))).otherwise(
        event("done", F.lit(""), F.lit(31.0)))
    rows = talk.select("conv_id", "turn", start.alias("start"), F.concat(said, F.array(end)).alias("all"))
    rows = rows.select("conv_id", "turn", "start", F.size("all").alias("size"), F.posexplode_outer("all").alias("seq", "e"))
    none = F.lit(None).cast("string")
    return rows.select(
        "conv_id", "turn", "seq", "e.type", "e.content", F.floor(F.col("seq") * WAVES / F.col("size")).cast("int").alias("part"),
        F.timestamp_millis(((F.col("start") + F.col("e.after")) * 1000).cast("long")).alias("ts"),
        *(none.alias(n) for n in ("sources", "cited_indices", "tool_name", "tool_args", "tool_result")))


def q_stream_time_limit(spark, root):
    """Messages with a time limit; a wave ends in the midst of many of them."""
    key = ["conv_id", "turn"]
    events = _timed_events(spark, root)
    # every message has events in each wave: the delay covers the time that a wave spans
    span = tables.load(spark, root, "conversations").agg(
        (F.max("conv_id") - F.min("conv_id")) * 2_000 + (F.max("turn") - F.min("turn")) * 200 + 100)
    delay = int(span.first()[0] or 0)
    end = F.lit(_END_HOURS * 3600) + delay
    closing = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("seq"),
        F.lit("done").alias("type"), F.lit("").alias("content"), F.lit(WAVES - 1).alias("part"), F.timestamp_add("SECOND", end, F.col("ts")).alias("ts"),
        *(F.lit(None).cast("string").alias(n) for n in ("sources", "cited_indices", "tool_name", "tool_args", "tool_result")))
    done = _run_in_waves(
        spark, events.unionByName(closing), F.col("part"), lambda rows: jobs.assemble_stream(rows, key, "ts", delay=f"{delay} seconds"))
    return done.where("conv_id >= 0").select("conv_id", "turn", F.md5("content").alias("content_md5"), "error", "done")


def _dated(spark, root) -> DataFrame:
    """Messages ten minutes apart with one long pause, and the model named in most."""
    model = (
        F.when((F.col("conv_id") + F.col("turn")) % 4 == 3, F.lit(None))
        .when((F.col("conv_id") + F.floor(F.col("turn") / 3)) % 3 == 0, "small").otherwise("large"))
    pause = F.when(F.col("turn") > F.col("conv_id") % 4, 3_700).otherwise(0)
    return tables.load(spark, root, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"), model.alias("model"),
        F.timestamp_seconds(_START + F.col("turn") * 600 + pause).alias("ts"))


def q_stream_history(spark, root):
    """The history valid at every message, over three starts of the stream."""
    wave = F.least(F.floor((F.unix_seconds("ts") - _START) / 1_500), F.lit(WAVES - 1)).cast("int")
    rows = _run_in_waves(spark, _dated(spark, root), wave, lambda m: jobs.history_stream(m, "conv_id", "turn"))
    said = F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select(
        "conv_id", "turn", F.size("history").cast("bigint").alias("messages"), F.md5(F.array_join(said, "|")).alias("history_md5"))


def _requests(events):
    """Events as requests: the type names the path, the value is the time in hundredths."""
    path = (
        F.when(F.col("event_type") == "view", "/health/live").when(F.col("event_type") == "click", "/docs")
        .otherwise(F.concat(F.lit("/api/v1/"), "event_type")))
    return events.select("event_id", path.alias("path"), (F.col("value") * 10).alias("latency_ms"))


def q_slow_requests(spark, root):
    return E.slow_requests(_requests(_events(spark, root))).select(
        "event_id", "path", F.round("latency_ms", 6).alias("latency_ms"))


def q_stream_slow_requests(spark, root):
    rows = _run(spark, E.slow_requests(_requests(_stream(spark, root, "events"))))
    return rows.select("event_id", "path", F.round("latency_ms", 6).alias("latency_ms"))


QUERIES = {
    "stream_sse": q_stream_sse,
    "stream_time_limit": q_stream_time_limit,
    "stream_history": q_stream_history,
    "session_expiry": q_session_expiry,
    "stream_closed_sessions": q_stream_closed_sessions,
    "stream_ingest": q_stream_ingest,
    "stream_assemble": q_stream_assemble,
    "slow_requests": q_slow_requests,
    "stream_slow_requests": q_stream_slow_requests,
}

_SESSIONS = """
gaps AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 1 HOUR, true)::INT AS fresh FROM events
         WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM gaps),
sessions AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS events FROM numbered GROUP BY user_id, no)
"""
_SLOW = """
WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN '/health/live' WHEN 'click' THEN '/docs'
             ELSE '/api/v1/' || event_type END AS path, value * 10 AS latency_ms FROM events)
SELECT event_id, path, round(latency_ms, 6) AS latency_ms FROM r
WHERE latency_ms > 500 AND NOT starts_with(path, '/health') AND NOT starts_with(path, '/docs')"""
_HISTORY = """
m AS (SELECT *, turn * 600 + CASE WHEN turn > conv_id % 4 THEN 3700 ELSE 0 END AS s,
        CASE WHEN (conv_id + turn) % 4 = 3 THEN NULL WHEN (conv_id + turn // 3) % 3 = 0 THEN 'small' ELSE 'large' END AS model
      FROM conversations WHERE role <> 'system'),
idle AS (SELECT *, coalesce(s - lag(s) OVER w >= 3600, true)::INT AS fresh FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY s, turn)),
sat AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY s, turn) AS sitting FROM idle),
used AS (SELECT *, last_value(model IGNORE NULLS) OVER (PARTITION BY conv_id, sitting ORDER BY s, turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sat),
part AS (SELECT *, sum((model IS NOT NULL AND before IS NOT NULL AND model <> before)::INT)
           OVER (PARTITION BY conv_id, sitting ORDER BY s, turn) AS part FROM used),
h AS (SELECT conv_id, turn, list(role || ':' || text) OVER (PARTITION BY conv_id, sitting, part ORDER BY s, turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM part)
"""
ORACLES = {
    "stream_sse": CHAT["sse_parse"],
    "stream_time_limit": """
SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(text, '\\S+\\s*'), '')) AS content_md5,
  CASE WHEN turn % 3 = 2 THEN 'An error occurred' END AS error, turn % 3 <> 2 AS done FROM conversations
WHERE turn % 3 <> 2 OR regexp_matches(text, '\\S')
UNION ALL
SELECT conv_id, turn, md5('late'), 'An error occurred', false FROM conversations WHERE turn % 3 = 2""",
    "stream_history": f"""WITH {_HISTORY}
SELECT conv_id, turn, coalesce(len(said), 0)::BIGINT AS messages,
  md5(coalesce(array_to_string(said, '|'), '')) AS history_md5 FROM h""",
    "session_expiry": f"""WITH {_SESSIONS}
SELECT user_id, epoch_us(a) AS session_start, epoch_us(z) AS last_event, events FROM sessions""",
    "stream_closed_sessions": f"""WITH {_SESSIONS}
SELECT user_id, epoch_us(a) AS session_start, epoch_us(z) AS last_event, events FROM sessions
WHERE z + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_ingest": f"""WITH RECURSIVE {sliding()}
SELECT doc_id, chunk_index, md5(content) AS content_md5, {Q.is_toc('content')} AS is_toc FROM chunks""",
    "stream_assemble": CHAT["assemble_message"],
    "slow_requests": _SLOW,
    "stream_slow_requests": _SLOW,
}
