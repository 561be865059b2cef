"""Sources, storage, crawl, chat and streaming on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import catalog, chat, crawl, documents, enrichment, evaluation, sessions
from docmill.sources import files, store
from docmill.streaming import jobs


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_read_documents(spark, tmp_path):
    write(tmp_path / "a" / "one.md", "# Titre é\nbody")
    write(tmp_path / "a" / "latin.txt", "caf\xe9".encode("latin-1"))
    write(tmp_path / "p.HTML", "skipped: patterns are lower case")
    write(tmp_path / "p.html", "<html><body><h1>Page</h1><p>x</p></body></html>")
    write(tmp_path / "s.pdf", b"%PDF")
    write(tmp_path / "examples" / "no.md", "no")
    write(tmp_path / "web" / "no.md", "no")
    write(tmp_path / "code.py", "no")
    rows = {r["source"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a/latin.txt", "a/one.md", "p.html", "s.pdf"]
    assert rows["a/latin.txt"]["content"] == "café" and rows["a/one.md"]["title"] == "Titre é"
    assert rows["p.html"]["content"] == "# Page\nx"
    assert rows["s.pdf"]["errors"] == ["no converter for .pdf"] and rows["s.pdf"]["format"] == "structured"


def test_golden_and_stopwords(spark, tmp_path):
    write(tmp_path / "g.csv", 'query,expected_doc_path,expected_keywords,min_similarity,query_type\n'
          '"What, now?",data/,"[\'API key\',\'l\'eau\',\'429\']",0.65,semantic\n')
    row = files.read_golden(spark, str(tmp_path / "g.csv")).first()
    assert row["query"] == "What, now?" and row["expected_keywords"] == ["API key", "l'eau", "429"]
    assert row["min_similarity"] == 0.65 and row["query_type"] == "semantic"
    write(tmp_path / "s.json", '{\n"default": ["un"],\n"en": ["a", "b"]}')
    assert files.read_stopwords(spark, str(tmp_path / "s.json"), "en") == ["a", "b"]
    assert files.read_stopwords(spark, str(tmp_path / "s.json"), "xx") == ["un"]


def test_transcript(spark):
    frame = spark.createDataFrame([("[time: 0.0-5.96]  Welcome\n\n[time: 6.26-11.44]  Founded\nno mark",)], "text string")
    rows = files.transcript_segments(frame).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(0.0, 5.96, "Welcome"), (6.26, 11.44, "Founded")]


def test_lookup(spark):
    stored = spark.createDataFrame([(p,) for p in ("raw/a/f.md", "processed/f.md", "processed/g.md", "other/h.md")], "path string")
    asked = ["documents/data/raw/a/f.md", "x/f.md", "g.md", "h.md", "other/h.md", "/raw/a/f.md", "", "none.md"]
    got = files.lookup_documents(spark.createDataFrame([(a,) for a in asked], "requested string"), stored)
    found = {r["requested"]: (r["path"], r["match"]) for r in got.collect()}
    assert found["documents/data/raw/a/f.md"] == ("raw/a/f.md", "exact")
    assert found["x/f.md"] == ("raw/a/f.md", "name") and found["g.md"] == ("processed/g.md", "name")
    assert found["h.md"] == (None, "not_found") and found["other/h.md"] == ("other/h.md", "exact")
    assert found["/raw/a/f.md"] == (None, "invalid") and found[""] == (None, "invalid")


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([("a", "A"), ("b", "B")], "document_id string, title string")
    chunks = spark.createDataFrame(
        [("a", 0, [1.0]), ("a", 1, None), ("b", 0, [2.0])], "document_id string, chunk_index int, embedding array<float>")
    path = str(tmp_path / "store")
    store.write_corpus(docs, chunks, path)
    store.write_corpus(docs, chunks, path, mode="append", keep_null_embeddings=False)
    saved_docs, saved = store.read_corpus(spark, path)
    assert saved_docs.count() == 4 and saved.count() == 5
    store.write_corpus(docs, chunks, path)
    assert [tuple(r) for r in store.table_counts(*store.read_corpus(spark, path)).collect()] == [("documents", 2), ("chunks", 3)]
    left = store.cascade_delete(docs, chunks, docs.where("document_id = 'a'"))
    assert [d.count() for d in left] == [1, 1]
    with pytest.raises(ValueError):
        store.write_corpus(docs, chunks, path, mode="merge")


def test_markdown_quoting(spark):
    values = ["plain", "a: b", "- item", "2024-01-01", "12", "true", "it's", "x #y", "", "@at", "a:b"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(store.yaml_scalar(F.col("v"))).collect()]
    assert got == ["plain", "'a: b'", "'- item'", "'2024-01-01'", "'12'", "'true'", "it's", "'x #y'", "''", "'@at'", "a:b"]


def test_metadata_precedence(spark):
    text = "---\ntitle: T\nfile_size: 7\nword_count: 99\n---\nx y"
    frame = spark.createDataFrame([(text, "/r/d.md")], "content string, path string")
    meta = documents.with_metadata(frame).first()["metadata"]
    assert meta["file_size"] == "7" and meta["word_count"] == str(len(text.split())) and meta["title"] == "T"
    assert meta["file_path"] == "/r/d.md" and meta["line_count"] == "6"


def test_list_documents_pages(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", f"s{i}", f"2024-01-0{i + 1}", {"lang": "fr" if i % 2 else "en"}) for i in range(6)],
        "document_id string, source string, created_at string, metadata map<string,string>")
    chunks = spark.createDataFrame([("d5",), ("d5",), ("d1",)], "document_id string")
    rows = catalog.list_documents(docs, chunks, limit=2, offset=1, metadata_filter={"lang": "fr"}).collect()
    assert sorted((r["document_id"], r["chunk_count"]) for r in rows) == [("d1", 1), ("d3", 0)]
    everything = catalog.list_documents(docs, chunks).collect()
    assert len(everything) == 6


def crawl_by_levels(starts, links, fetched, max_depth, max_pages):
    """Pages in order of level, then of their first finder and its link's position."""
    order, level = {}, {}
    for place, url in enumerate(starts):
        level.setdefault(url, (0, place))
    for depth in range(max_depth + 1):
        ranked = sorted(level, key=level.get)
        order |= {url: depth for url in ranked}
        finders = [(rank, place, link) for rank, url in enumerate(ranked) if url in fetched
                   for place, link in enumerate(links.get(url, []))]
        level = {link: (rank, place) for rank, place, link in reversed(finders) if link not in order}
    return list(order.items())[:max_pages]


@pytest.mark.parametrize("max_depth,max_pages", [(2, 100), (3, 8), (0, 5), (2, 1)])
def test_frontier(spark, max_depth, max_pages):
    rng = random.Random(max_pages)
    urls = [f"u{i:02d}" for i in range(40)]
    links = {u: rng.sample(urls, 4) for u in urls}
    fetched = set(urls[:30])
    rows = [("s", u, n, v) for u, out in links.items() for n, v in enumerate(out)]
    got = crawl.crawl_frontier(
        spark.createDataFrame([("s", "u00", 0), ("s", "u07", 1), ("s", "u00", 2)], "name string, url string, position int"),
        spark.createDataFrame(rows, "name string, url string, position int, link string"),
        spark.createDataFrame([(u,) for u in fetched], "url string"), max_depth, max_pages).orderBy("visit").collect()
    assert [(r["url"], r["depth"]) for r in got] == crawl_by_levels(["u00", "u07", "u00"], links, fetched, max_depth, max_pages)


def test_follow_rules(spark):
    sources = spark.createDataFrame(
        [("site", "https://d.org:80", ["/guide/", "/api/"], ["/login", "/api/"])],
        "name string, base_url string, url_patterns array<string>, exclude_patterns array<string>")
    links = ["https://d.org:80/guide/a", "https://d.org:80/api/x", "https://d.org/guide/a", "https://d.org:80/other",
             "https://d.org:80/guide/login", "https://d.org:80/guide/seen"]
    frame = spark.createDataFrame([("u", i, v) for i, v in enumerate(links)], "url string, position int, link string")
    seen = spark.createDataFrame([("https://d.org:80/guide/seen",)], "url string")
    assert [r["link"] for r in crawl.follow_filter(frame, sources, seen).collect()] == [links[0]]


def test_crawl_counters(spark):
    rows = [("a", True, None), ("a", False, "boom"), ("a", False, ""), ("a", True, "late")]
    row = crawl.crawl_summary(spark.createDataFrame(rows, "name string, success boolean, error string")).first()
    assert (row["total_urls"], row["successful"], row["failed"], row["skipped"], row["success_rate"]) == (4, 2, 1, 1, 50.0)


@pytest.mark.parametrize("text,cited", [
    ("see [1], [[2]] x[3] [4](u) [5][6]", [1, 2, 5, 6]), ("none", []), ("é[1] _[2] -[3]", [3]), ("[2][2] [1]", [1, 2]),
])
def test_citations(spark, text, cited):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(chat.cited_indices(F.col("t"))).first()[0] == cited


def test_mentions(spark):
    cases = {
        "@weather Météo Paris?": ("weather", "Météo Paris?"), "Hello world": (None, "Hello world"),
        "@METEO\n x ": ("weather", "x"), "@nobody hi": (None, "@nobody hi"), "@kb": (None, "@kb"), "@kb  ": ("rag", ""),
    }
    frame = spark.createDataFrame([(m,) for m in cases], "message string")
    got = {r["message"]: (r["agent_id"], r["clean_message"]) for r in chat.parse_mention(frame).collect()}
    assert got == cases


def test_tool_runs_and_pairs(spark):
    calls = spark.createDataFrame([("s", n, t, f"id{n}") for n, t in enumerate("aaba")], "s string, n int, tool_name string, call_id string")
    runs = chat.tool_call_runs(calls, "s", F.lit(0), ["n"]).orderBy("group_no").collect()
    assert [(r["tool_name"], r["count"]) for r in runs] == [("a", 2), ("b", 1), ("a", 1)]
    results = spark.createDataFrame([("id0", 1, "old"), ("id0", 2, "new")], "call_id string, n int, result string")
    got = {r["call_id"]: r["tool_result"] for r in chat.pair_tool_calls(calls, results, ["n"]).collect()}
    assert got["id0"] == "new" and got["id1"] is None


def test_dedup_sources(spark):
    rows = [(1, 0, "Doc 1", "test.pdf", 0.95, 5), (1, 1, "Doc 1", "test.pdf", 0.88, 7)]
    frame = spark.createDataFrame(rows, "m int, position int, title string, path string, similarity double, page int")
    got = chat.dedup_sources(frame, ["m"]).collect()
    assert [(r["similarity"], r["page"]) for r in got] == [(0.95, 5)]


def test_sse_details(spark):
    body = (
        'event: token\ndata: {"content": "a"}\n\n  \n\nevent: token\ndata: {"content": 5}\n\ndata: {"content": "no type"}\n\n'
        "event: token\ndata: null\n\nevent: error\ndata: {}\n\nevent: token\nevent: done\ndata: {}\n\nevent: token\ndata: {\"content\": \"held\"}"
    )
    frame = spark.createDataFrame([(1, body)], "m int, body string")
    events = chat.parse_sse(frame, ["m"])
    assert [(r["type"], r["content"]) for r in events.orderBy("seq").collect()] == [
        ("token", "a"), ("token", "5"), ("error", ""), ("done", "")]
    done = chat.assemble_messages(events, ["m"]).first()
    assert done["content"] == "a5" and done["error"] == "An error occurred" and done["done"] and done["sources"] is None


def test_weather(spark):
    payload = '{"current":{"temperature_2m":12.5,"relative_humidity_2m":80,"weather_code":61,"wind_speed_10m":9.0},"hourly":{"temperature_2m":[%s]}}'
    rows = [("Here", payload % ",".join(map(str, range(30)))), ("There", payload.replace("61", "4") % "")]
    got = {r["location_name"]: r for r in enrichment.weather_readings(
        spark.createDataFrame(rows, "location_name string, payload string")).collect()}
    assert got["Here"]["high_24h"] == 23.0 and got["Here"]["low_24h"] == 0.0
    assert got["Here"]["summary"] == "Here: 12.5°C, slight rain, humidity 80%, wind 9.0 km/h\n24h forecast: High 23.0°C, Low 0.0°C"
    assert got["There"]["description"] == "weather code 4"


def test_locations(spark):
    cases = {"50.85,4.35": ("50.85°, 4.35°"), "-1,2": "-1.00°, 2.00°", "Paris, France": None, "Paris": None, "1, 2": None, "1,2,3": None}
    frame = spark.createDataFrame([(c,) for c in cases], "l string")
    got = {r[0]: r[1] for r in frame.select("l", enrichment.parse_location(F.col("l"))[2]).collect()}
    assert got == cases


def test_polygons(spark):
    feature = '{"geometry":{"type":"Polygon","coordinates":%s},"properties":{"LABEL_FR":"f","LABEL_NL":"n"}}'
    rows = [(1, "nl", feature % "[[[4.0,50.0],[5.0,51.0]],[[4.5,49.0]]]"), (2, "de", feature % "[[[4.0,50.0,1.0]]]"), (3, "fr", '{"properties":{}}')]
    flat = enrichment.feature_flatten(spark.createDataFrame(rows, "id int, language string, feature string"))
    got = {r["id"]: r for r in enrichment.polygon_bounds(flat).collect()}
    assert sorted(got) == [1, 2] and got[1]["label"] == "n" and got[2]["language"] == "fr"
    assert (got[1]["points"], got[1]["south"], got[1]["west"], got[1]["north"], got[1]["east"]) == (3, 49.0, 4.0, 51.0, 5.0)
    assert got[2]["points"] == 0


def test_threshold_report(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    results = spark.createDataFrame([(1, 0.72), (1, 0.5), (1, 0.31)], "query_id int, similarity double")
    sweep = evaluation.threshold_sweep(queries, results, evaluation.ANALYSIS_GRID)
    got = {r["query_id"]: (r["recommended"], r["relevance"]) for r in evaluation.recommend_threshold(sweep).collect()}
    assert got == {1: (0.65, "HIGH"), 2: (None, "VERY LOW")}
    counts = {(r["query_id"], r["threshold"]): r["results"] for r in sweep.collect()}
    assert counts[1, 0.5] == 2 and counts[2, 0.3] == 0 and len(counts) == 16


# --- sessions and streams ------------------------------------------------------------------


def moments(rng, n, span):
    return sorted(rng.randrange(span) for _ in range(n))


def test_sessions_against_plain_walk(spark):
    rng = random.Random(9)
    data = {"a": moments(rng, 300, 200_000), "b": [0, 3600, 7199, 10800]}
    rows = [(k, t) for k, ts in data.items() for t in ts]
    frame = spark.createDataFrame(rows, "k string, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r["k"], int(r["session_start"].timestamp()), int(r["last_event"].timestamp()), r["events"])
                 for r in sessions.sessions(frame, "k").collect())
    want = []
    for k, ts in data.items():
        for t in ts:
            if want and want[-1][0] == k and t - want[-1][2] < 3600:
                want[-1] = (k, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((k, t, t, 1))
    assert got == sorted(want)
    now = F.timestamp_seconds(F.lit(10800 + 3599))
    assert sessions.expired(sessions.sessions(frame.where("k = 'b'"), "k"), now).count() == 2


def test_slow_requests(spark):
    rows = [("/api/x", 500.0), ("/api/x", 500.1), ("/health/live", 900.0), ("/docs", 900.0)]
    got = sessions.slow_requests(spark.createDataFrame(rows, "path string, latency_ms double")).collect()
    assert [tuple(r) for r in got] == [("/api/x", 500.1)]


def test_stream_in_many_batches(spark, tmp_path):
    """Files arriving one by one give the same chunks and sessions as all at once."""
    from docmill.operators.chunking import chunk_sliding

    source = str(tmp_path / "in")
    rng = random.Random(4)
    times = moments(rng, 300, 30_000)
    rows = [(i, ("text. " * rng.randrange(0, 400)).strip(), "k" + str(i % 3), t) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, k string, t int").withColumn("ts", F.timestamp_seconds("t"))
    for part in range(3):
        frame.where(F.col("doc_id").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(source)

    def run(name, rows_of):
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = rows_of(stream)
        query = jobs.append_batches(out, str(tmp_path / name), str(tmp_path / (name + "-cp")))
        query.awaitTermination()
        return spark.read.schema(out.schema).parquet(str(tmp_path / name)).collect()

    chunks = run("chunks", jobs.ingest_stream)
    want = chunk_sliding(frame.select("doc_id", "text")).collect()
    assert sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in chunks) == sorted(
        (r["doc_id"], r["chunk_index"], r["content"]) for r in want)
    closed = run("sessions", lambda s: jobs.session_stream(s, "k", idle_seconds=100, delay="1 second"))
    every = sessions.sessions(frame, "k", idle_seconds=100).collect()
    end = max(times) - 1
    done = {(r["k"], r["session_start"], r["events"]) for r in every if r["last_event"].timestamp() + 100 <= end}
    assert {(r["k"], r["session_start"], r["events"]) for r in closed} == done
    first = run("first", lambda s: jobs.first_per_period(s.select("k", "ts"), ["k"], "ts", "1 day"))
    assert sorted(r["k"] for r in first) == ["k0", "k1", "k2"]


def test_table_stream_of_a_file_and_of_a_folder(spark, tmp_path, root):
    """A table may be one file or a folder of part files."""
    events = spark.read.parquet(f"{root}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for at, folder in enumerate((root, str(tmp_path))):
        rows = jobs.read_table_stream(spark, folder, "events.parquet", events.schema)
        query = jobs.append_batches(rows, str(tmp_path / f"out{at}"), str(tmp_path / f"cp{at}"))
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"out{at}")).count() == events.count()


def test_messages_cut_between_batches(spark, tmp_path):
    """Events that arrive in three batches give the same messages as all at once."""
    from docmill.operators import chat

    schema = "m int, seq int, type string, content string, sources string, cited_indices string, " \
        "tool_name string, tool_args string, tool_result string"
    none = (None,) * 5
    events = [
        (1, 0, "tool_call", "", None, None, "search", "{}", None), (1, 1, "token", "Hel", *none),
        (2, 0, "token", "a", *none), (1, 2, "token", "lo", *none), (1, 3, "sources", "", "[1]", "[2]", None, None, None),
        (2, 1, "error", "", *none), (1, 4, "token", "!", *none), (1, 5, "done", "", *none), (3, 0, "token", "open", *none),
    ]
    frame = spark.createDataFrame(events, schema)
    for part in range(3):
        spark.createDataFrame(events[part * 3 : part * 3 + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.assemble_stream(stream, ["m"])
    jobs.append_batches(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    whole = {r["m"]: r for r in chat.assemble_messages(frame, ["m"]).collect()}
    assert sorted(r["m"] for r in found) == [1, 2]
    for r in found:
        for column in ("content", "sources", "cited_indices", "tool_calls", "error", "done"):
            assert r[column] == whole[r["m"]][column], column
