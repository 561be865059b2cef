"""Keyword matches found a batch of chunks at a time."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import cover_scan
from docmill.operators import fulltext as FT

WORDS = ["alpha", "beta", "gamma", "delta", "é", "other", "x1", "b2"]
NUMBERS = "query_id bigint, query string"


def made(spark, seed, queries=30, chunks=80):
    """Random queries and chunks; keys repeat and are null, some texts are empty or null."""
    rng = random.Random(seed)

    def piece():
        words = " ".join(rng.choices(WORDS, k=rng.choice([1, 1, 1, 2, 3])))
        return rng.choice(["", "", "", "-"]) + (f'"{words}"' if " " in words else words)

    asked = [(rng.choice([None, i, i, i // 2]), rng.choice([" ", " ", " or "]).join(
        p for _ in range(rng.randrange(0, 6)) for p in ([piece(), "or"] if rng.random() < 0.4 else [piece()]))) for i in range(queries)]
    texts = [(rng.choice([None, i, i, i // 2]), rng.choice([None, *[" ".join(rng.choices(WORDS, k=rng.randrange(0, 40)))] * 9]))
             for i in range(chunks)]
    return spark.createDataFrame([*asked, (-1, None)], NUMBERS), spark.createDataFrame(texts, "chunk_id bigint, content string").repartition(3)


def row_by_row(queries, tokens):
    """Every chunk beside every alternative, by the expressions of the shuffled path."""
    parsed = FT.parse_queries(queries)
    groups = F.transform("alternatives", FT.positive_words)
    earlier = F.slice("alternatives", F.lit(1), F.col("alternative"))
    pairs = parsed.select("query_id", "alternatives", F.array_distinct(F.flatten(groups)).alias("terms"), groups.alias("groups"),
                          F.posexplode("alternatives").alias("alternative", "items"))
    pairs = pairs.withColumn("words_before", F.array().cast("array<string>")).withColumn("others_before", earlier)
    return FT._scored(pairs.crossJoin(tokens.where("tokens is not null")), ["chunk_id"])


@pytest.mark.parametrize("seed,words", [(1, 1_000_000), (2, 50), (3, 1)])
def test_scan_gives_the_same_scores_to_the_last_bit(spark, monkeypatch, seed, words):
    queries, chunks = made(spark, seed)
    tokens = FT.token_table(chunks)
    want = sorted(map(str, row_by_row(queries, tokens).collect()))
    asked = FT.parse_queries(queries).where("size(alternatives) > 0").collect()
    known, parsed = cover_scan.numbered_queries([r["alternatives"] for r in asked], min)
    monkeypatch.setattr(cover_scan, "BATCH_WORDS", words)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist(
        [{"chunk_id": r[0], "tokens": r[1]} for r in tokens.collect()], schema=pa.schema([("chunk_id", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    ids = pa.array([r["query_id"] for r in asked], pa.int64())
    found = [(h["query_id"], r["chunk_id"], h["rank_cd"]) for b in cover_scan.scan(iter([batch, batch.slice(0, 0)]), known, ids, parsed, None)
             for r in b.to_pylist() for h in r["hits"]]
    got = sorted(str(r) for r in spark.createDataFrame(found, "query_id bigint, chunk_id bigint, rank_cd double").collect())
    assert got == want and len(got) > 100
    assert sorted(map(str, FT.fts_matches(queries, tokens).collect())) == want


@pytest.mark.parametrize("k", [1, 3])
def test_best_chunks_are_those_of_all_matches(spark, k):
    """Leaving out chunks early gives the first k of every query, ties by id, null first."""
    queries, chunks = made(spark, 4, chunks=150)
    tokens = FT.token_table(chunks.dropDuplicates(["chunk_id"])).cache()
    queries = queries.dropDuplicates(["query_id"]).cache()
    every = {}
    for q, c, score in FT.fts_matches(queries, tokens).withColumn("rank_cd", F.round("rank_cd", 12)).collect():
        every.setdefault(q, []).append((-score, c is not None, c or 0, c))
    want = {(q, i + 1, c) for q, rows in every.items() for i, (_, _, _, c) in enumerate(sorted(rows, key=lambda r: r[:3])[:k])}
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in FT.fts_search(queries, tokens, k).collect()} == want
    assert FT.fts_matches(queries, tokens, best=k).count() < FT.fts_matches(queries, tokens).count()


def test_phrases_with_any_word_inside(spark):
    """A word that the analyser takes out stands for any one word, but not for the end of a text."""
    alternatives = [[[(False, ["a", "", "b"])]], [[(True, ["a", "", "b"])]], [[(False, ["a", "", "b"]), (False, ["c"])], [(False, ["d"])]]]
    queries = spark.createDataFrame(list(enumerate(alternatives)), f"query_id int, alternatives array<array<{FT.ITEM}>>")
    texts = [["a", "x", "b"], ["a", "b"], ["x", "a", ""], ["b", "a", "", "b", "c"], ["d", "c"], ["a"], ["", "b"]]
    tokens = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, tokens array<string>").coalesce(1)
    rows = {(r["query_id"], r["chunk_id"]): r["rank_cd"] for r in FT.fts_matches(queries, tokens).collect()}
    assert {c for q, c in rows if q == 0} == {0, 3} and {c for q, c in rows if q == 1} == {1, 2, 4, 5, 6}
    assert {c for q, c in rows if q == 2} == {3, 4}
    assert rows == {(r["query_id"], r["chunk_id"]): r["rank_cd"] for r in FT.fts_matches(queries, tokens, lead_rows=0).collect()}


def test_many_alternatives_take_one_scan(spark, tmp_path):
    """Thousands of alternatives are scored in one scan, without an expression per chunk and query."""
    words = [f"w{i}" for i in range(50)]
    queries = spark.createDataFrame([(q, " or ".join(words)) for q in range(100)], NUMBERS)
    spark.range(40).select(F.col("id").alias("chunk_id"), F.concat(F.lit("w"), "id", F.lit(" w1 w1")).alias("content")).write.parquet(str(tmp_path / "c"))
    found = FT.fts_matches(queries, FT.token_table(spark.read.parquet(str(tmp_path / "c"))))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "aggregate(" not in text and "Exchange" not in text
    rows = found.collect()
    assert len(rows) == 4000 and [r["rank_cd"] for r in rows if r["chunk_id"] == 1] == pytest.approx([0.3] * 100)


def stems(words):
    return words.select("word", F.when(F.col("word") == "le", "").otherwise(F.regexp_replace("word", "s$", "")).alias("stem"))


@pytest.mark.parametrize("few", [True, False])
def test_stems_of_texts(spark, monkeypatch, few):
    """Texts become stems in the scan, without a shuffle of their words; chunks with one id are merged."""
    monkeypatch.setattr(FT, "FORM_ROWS", FT.FORM_ROWS if few else 0)
    queries = spark.createDataFrame([(1, '"chats le chien" or maisons -oiseau'), (2, "le"), (3, "fleurs"), (4, None)], "query_id int, query string")
    texts = [(0, "Chat un chiens"), (1, "chats chiens"), (2, "maison"), (3, "maisons, oiseaux oiseau"), (4, "autre"), (5, ""), (6, None)]
    chunks = spark.createDataFrame(texts, "chunk_id int, content string").coalesce(2)
    parsed, tokens = FT.analysed(queries, chunks, stems)
    rows = {(r["query_id"], r["chunk_id"]): r["rank_cd"] for r in FT.fts_matches(parsed, tokens).collect()}
    assert rows == {(1, 0): pytest.approx(0.05), (1, 2): pytest.approx(0.1)}
    got = {r["chunk_id"]: r["tokens"] for r in tokens.collect() if r["tokens"] is not None}
    assert got == {0: ["chat", "", "chien"], 1: ["chat", "chien"], 2: ["maison"], 3: ["maison", "", "oiseau"], 4: [""], 5: []}
    text = tokens._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in text) != few and ("Generate" in text) != few
    twice = FT.analysed(queries, chunks.unionAll(chunks), stems)[1]
    assert {r["chunk_id"]: r["tokens"] for r in twice.collect()}[1] == ["chat", "chat", "chien", "chien", ""]
