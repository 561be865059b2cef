import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import fulltext as FT
from docmill.operators import search as S
from docmill.operators import vector_search as VS
from docmill.operators.ranking import number_rows, number_runs, top_per_key

DIM = 16


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    chunks = [(f"c{i:04d}", f"d{i % 7}", rng.normal(size=DIM).astype(np.float32).tolist()) for i in range(400)]
    chunks += [("dup1", "d1", chunks[5][2]), ("dup0", "d1", chunks[5][2]), ("zero", "d1", [0.0] * DIM), ("none", "d1", None)]
    queries = [(i, rng.normal(size=DIM).astype(np.float32).tolist()) for i in range(9)]
    queries += [(90, chunks[5][2]), (91, [0.0] * DIM), (92, None)]
    return (
        spark.createDataFrame(queries, "query_id int, embedding array<float>"),
        spark.createDataFrame(chunks, "chunk_id string, document_id string, embedding array<float>").repartition(5),
        queries,
        chunks,
    )


def brute(queries, chunks, k, threshold):
    out = {}
    for q, v in queries:
        if v is None or not np.any(v):
            continue
        v = np.array(v, dtype=float)
        found = []
        for c, _, e in chunks:
            if e is None or not np.any(e):
                continue
            e = np.array(e, dtype=float)
            sim = round(float(v @ e / np.linalg.norm(v) / np.linalg.norm(e)), 12)
            if sim >= threshold:
                found.append((-sim, c))
        for rank, (sim, c) in enumerate(sorted(found)[:k], 1):
            out[q, rank] = (c, round(-sim, 9))
    return out


@pytest.mark.parametrize("k,threshold", [(10, 0.0), (3, 0.3), (500, -1.0)])
@pytest.mark.parametrize("query_rows", [4096, 4])
def test_vector_leg(vectors, k, threshold, query_rows):
    """Both the broadcast path and the blocked path (forced by a small bound) are exact."""
    queries, chunks, plain_q, plain_c = vectors
    rows = VS.vector_leg(queries, chunks, k, threshold, ["document_id"], query_rows=query_rows).collect()
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["similarity"], 9)) for r in rows}
    assert got == brute(plain_q, plain_c, k, threshold)
    parent = {c: d for c, d, _ in plain_c}
    assert all(parent[r["chunk_id"]] == r["document_id"] for r in rows)


def test_blocks_are_cut(vectors, monkeypatch):
    queries, chunks, plain_q, plain_c = vectors
    monkeypatch.setattr(VS, "CHUNK_BLOCK", 50)
    monkeypatch.setattr(VS, "QUERY_BLOCK", 2)
    rows = VS.vector_leg(queries, chunks, 7, 0.0, query_rows=3).collect()
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["similarity"], 9)) for r in rows}
    assert got == brute(plain_q, plain_c, 7, 0.0)


def test_top_per_key_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 20}", rng.randrange(50), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v int, id int")
    got = top_per_key(frame, ["k"], [F.col("v").desc(), F.col("id")], 6, salt=F.col("id"), salts=8).collect()
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((-v, i) for kk, v, i in rows if kk == k)[:6]
        want.update({(k, n): i for n, (_, i) in enumerate(mine, 1)})
    assert {(r["k"], r["rank"]): r["id"] for r in got} == want


def test_numbering_across_buckets(spark):
    rng = random.Random(2)
    rows, want_no, want_run = [], {}, {}
    for key in ("hot", "a", "b"):
        at, last, run = 0, object(), 0
        for n in range(1, 400 if key == "hot" else 15):
            at += rng.choice([1, 1, 1, 40])
            value = rng.choice(["x", "x", "y", None])
            if n == 1 or value != last:
                run += 1
            last = value
            rows.append((key, at, value))
            want_no[key, at], want_run[key, at] = n, run
    frame = spark.createDataFrame(rows, "k string, at int, v string").repartition(6)
    bucket = F.floor(F.col("at") / 16)
    numbered = number_rows(frame, "k", bucket, [F.col("at")], "no").collect()
    assert {(r["k"], r["at"]): r["no"] for r in numbered} == want_no
    runs = number_runs(frame, "k", bucket, ["at"], "v", "run").collect()
    assert {(r["k"], r["at"]): r["run"] for r in runs} == want_run


# --- keyword search ------------------------------------------------------------------------


def plain_parse(query):
    import re

    groups = [[]]
    for piece in re.findall(r'-?"[^"]*"|[^\s"]+', query):
        if piece.lower() == "or":
            groups.append([])
            continue
        words = re.findall(r"[^\W_]+", piece.lower())
        if words:
            groups[-1].append((piece.startswith("-"), words))
    return [g for g in groups if g]


def plain_search(query, text):
    import re

    tokens = re.findall(r"[^\W_]+", text.lower())

    def holds(words):
        m = len(words)
        return any(tokens[i : i + m] == words for i in range(len(tokens) - m + 1))

    groups = plain_parse(query)
    if not any(all(neg != holds(words) for neg, words in g) for g in groups):
        return None
    sets = [{w for neg, words in g if not neg for w in words} for g in groups]
    sets = [s for s in sets if s]
    named = set().union(*sets) if sets else set()
    hits = [i for i, t in enumerate(tokens) if t in named]
    covers = []
    for b, q in enumerate(hits):
        starts = [a for a in range(b + 1) if any(s <= {tokens[h] for h in hits[a : b + 1]} for s in sets)]
        if starts:
            covers.append((starts[-1], b))
    minimal = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
    return sum(0.1 / (1 + (hits[b] - hits[a]) - (b - a)) for a, b in minimal)


QUERIES = [
    "alpha", "alpha beta", "alpha or beta", '"alpha beta"', '"alpha beta" gamma', "alpha -beta", "-alpha",
    '-"alpha beta" gamma', "beta-gamma", "alpha beta or gamma delta", "alpha alpha", "or", "...", "", "delta or -alpha",
    'alpha "beta', "ALPHA Beta.",
]


@pytest.mark.parametrize("lead_rows", [4000, 0])
@pytest.mark.parametrize("with_stats", [False, True])
def test_keyword_search(spark, lead_rows, with_stats):
    """Every match and its score, for both join paths and both choices of the lead word."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "other", "filler", "x1"]
    texts = [" ".join(rng.choices(words, weights=[3, 3, 2, 1, 8, 8, 1], k=rng.randrange(0, 30))) for _ in range(60)]
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string").repartition(4)
    tokens = FT.token_table(chunks)
    stats = FT.term_stats(FT.build_postings(tokens)) if with_stats else None
    rows = FT.fts_matches(queries, tokens, stats, lead_rows=lead_rows).collect()
    got = {(r["query_id"], r["chunk_id"]): r["rank_cd"] for r in rows}
    assert len(got) == len(rows)
    want = {}
    for q, query in enumerate(QUERIES):
        for c, text in enumerate(texts):
            score = plain_search(query, text)
            if score is not None:
                want[q, c] = score
    assert got.keys() == want.keys()
    for key, score in want.items():
        assert got[key] == pytest.approx(score), (QUERIES[key[0]], texts[key[1]])


# --- fusion and presentation ---------------------------------------------------------------


def legs(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, document_id string, rank int")


def test_rrf(spark):
    text = legs(spark, [(1, "a", "d", 1)])
    near = legs(spark, [(1, "a", "d", 3), (1, "b", "d", 1)])
    got = {r["chunk_id"]: r["score"] for r in S.rrf_fuse(text, near, 50).collect()}
    assert got["a"] == pytest.approx(0.038475768, abs=1e-9) and got["b"] == pytest.approx(0.019607843, abs=1e-9)


def corpus(spark):
    chunks = [
        (i, f"d{i // 5}", f"word{i} shared text number {i}", [1.0, i / 10.0] if i % 4 else None, i == 3)
        for i in range(20)
    ]
    docs = [(f"d{i}", f"Guide {i} of type {'ABCD'[i]}", f"g{i}.md") for i in range(4)]
    queries = [(1, "shared type A", [1.0, 0.5]), (2, "nothing here", [-1.0, -0.5]), (3, "hi", [1.0, 0.0])]
    return (
        spark.createDataFrame(queries, "query_id int, query string, embedding array<float>"),
        spark.createDataFrame(chunks, "chunk_id int, document_id string, content string, embedding array<float>, is_toc boolean"),
        spark.createDataFrame(docs, "document_id string, title string, source string"),
    )


def test_hybrid(spark):
    queries, chunks, docs = corpus(spark)
    rows = S.hybrid_search(queries, chunks, docs, k=30).collect()
    first = [r for r in rows if r["query_id"] == 1]
    assert not any(r["chunk_id"] == 3 for r in rows)  # contents chunk
    assert not any(r["query_id"] == 2 for r in rows)  # nothing near, no words
    per_doc = {}
    for r in first:
        per_doc[r["document_id"]] = per_doc.get(r["document_id"], 0) + 1
    assert max(per_doc.values()) <= 3
    with_toc = S.hybrid_search(queries, chunks, docs, k=100, exclude_toc=False, max_per_doc=100).collect()
    assert any(r["chunk_id"] == 3 for r in with_toc)


def test_keyword_only_rows_keep_null_similarity(spark):
    queries, chunks, docs = corpus(spark)
    q = queries.where("query_id = 1").withColumn("query", F.lit("word4 shared"))
    rows = {r["chunk_id"]: r for r in S.hybrid_search(q, chunks, docs, k=60, max_per_doc=60).collect()}
    assert rows[4]["similarity"] is None and rows[4]["text_rank"] == 1
    again = S.rerank(S.hybrid_search(q, chunks, docs, k=60, max_per_doc=60), q).collect()
    assert [r["similarity"] for r in again if r["chunk_id"] == 4] == [None]


def test_rerank_orders(spark):
    queries, chunks, docs = corpus(spark)
    found = S.hybrid_search(queries, chunks, docs, k=30)
    rows = S.rerank(found, queries).orderBy("query_id", "position").collect()
    third = [(r["score"], r["chunk_id"]) for r in rows if r["query_id"] == 3]  # no keywords
    assert third == sorted(third, key=lambda x: (-x[0], x[1]))
    first = [r["similarity"] for r in rows if r["query_id"] == 1 and r["similarity"] is not None]
    assert first == sorted(first, reverse=True) and max(first) == 1.0


def test_verdicts(spark):
    results = spark.createDataFrame([(1, 0.9), (1, None), (2, 0.44), (3, None)], "query_id int, similarity double")
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id int")
    got = {r["query_id"]: (r["verdict"], r["best_percent"]) for r in S.scope_verdict(results, queries).collect()}
    assert got == {1: ("answered", 90), 2: ("out_of_scope", 44), 3: ("out_of_scope", 0), 4: ("no_result", 0)}


def test_page_ranges(spark):
    frame = spark.createDataFrame([(5, 5), (3, 7), (8, None), (0, 0), (None, None)], "s int, e int")
    got = [r[0] for r in frame.select(S.page_range(F.col("s"), F.col("e"))).collect()]
    assert got == ["p. 5", "p. 3-7", "p. 8", "p. 0", None]


def test_citation_percent_truncates(spark):
    frame = spark.createDataFrame([(1, "T", 0.29, "c"), (2, "U", 0.6, "d")], "n int, t string, s double, c string")
    got = [r[0] for r in frame.select(S.citation(F.col("n"), F.col("t"), F.col("s"), F.col("c"))).collect()]
    assert got == ['[1] Source: "T" (Pertinence: 28% - FAIBLE)\nc\n', '[2] Source: "U" (Pertinence: 60%)\nd\n']


def test_expand(spark):
    queries = spark.createDataFrame([(1, "The API and webhook?"), (2, "plain")], "query_id int, query string")
    synonyms = spark.createDataFrame([("api", "endpoints REST"), ("webhook", "callback")], "term string, extra string")
    got = {r["query_id"]: r["expanded"] for r in S.expand_queries(queries, synonyms).collect()}
    assert got == {1: "The API and webhook? endpoints REST callback", 2: "plain"}


def test_expander_function(spark):
    def expander(texts):
        if "bad" in texts:
            raise RuntimeError("no model")
        return [f"more {t}" for t in texts]

    queries = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id int, query string").repartition(2, "query_id")
    got = {r["query"]: r["expanded"] for r in S.expand_with(queries.where("query_id = 1"), expander).collect()}
    got |= {r["query"]: r["expanded"] for r in S.expand_with(queries.where("query_id = 2"), expander).collect()}
    assert got == {"good": "good more good", "bad": "bad"}


def test_call_by_name(spark):
    from docmill.operators.catalog import call_function

    queries, chunks, docs = corpus(spark)
    rows = call_function("match_chunks", queries=queries, chunks=chunks, docs=docs, k=2, threshold=0.5).collect()
    assert sorted((r["query_id"], r["rank"]) for r in rows) == [(1, 1), (1, 2), (3, 1), (3, 2)]


def test_vectors_beside_the_texts(spark):
    """Search over one table and over texts and vectors kept apart give the same rows."""
    queries, chunks, docs = corpus(spark)
    if "is_toc" not in chunks.columns:
        chunks = chunks.withColumn("is_toc", F.lit(False))
    texts = chunks.drop("embedding")
    vectors = chunks.where("embedding is not null").select("chunk_id", "document_id", "is_toc", "embedding")
    columns = ["query_id", "chunk_id", "rank", "similarity", "content", "document_title"]
    for mode in ("hybrid", "vector"):
        whole = S.hybrid_search(queries, chunks, docs, k=3, threshold=0.1, mode=mode)
        apart = S.hybrid_search(queries, texts, docs, k=3, threshold=0.1, mode=mode, vectors=vectors)
        assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, apart.select(columns).collect()))


@pytest.mark.parametrize("k", [1, 4])
def test_switches_change_the_plan_only(spark, monkeypatch, k):
    """Both sides of every size switch give the same rows."""
    import docmill.operators.search as module

    queries, chunks, docs = corpus(spark)
    if "is_toc" not in chunks.columns:
        chunks = chunks.withColumn("is_toc", F.lit(False))
    near = [sorted(map(str, VS.vector_leg(queries, chunks, k, query_rows=n).collect())) for n in (1, 4096)]
    assert near[0] == near[1]
    tokens = FT.token_table(chunks)
    words = [sorted(map(str, FT.fts_matches(queries, tokens, lead_rows=n).collect())) for n in (0, 10_000)]
    assert words[0] == words[1]
    found = []
    for most in (0, 120_000):
        monkeypatch.setattr(module, "BROADCAST_ROWS", most)
        rows = S.hybrid_search(queries, chunks, docs, k=k, threshold=0.1)
        found.append(sorted(map(str, rows.select("query_id", "chunk_id", "rank", "similarity", "content").collect())))
    assert found[0] == found[1]
