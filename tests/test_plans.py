"""The shape of the plans that matters at scale."""

import re

import pytest
from pyspark.sql import functions as F

from docmill import plans
from docmill.functions import text as T
from docmill.operators import catalog, chunking, fulltext, search, vector_search


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, root, tmp_path_factory):
    """A chunk store of many files, as ingestion writes it."""
    path = str(tmp_path_factory.mktemp("store"))
    docs = spark.read.parquet(f"{root}/documents.parquet")
    vectors = spark.read.parquet(f"{root}/embeddings.parquet")
    rows = docs.join(vectors, docs.doc_id == vectors.vec_id, "left").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"),
        F.col("text").alias("content"), "embedding", F.lit(False).alias("is_toc"))
    rows.repartition(12).write.parquet(f"{path}/chunks")
    docs.groupBy(F.col("source").alias("document_id")).agg(
        F.first("source").alias("title"), F.first("source").alias("source")
    ).write.parquet(f"{path}/documents")
    items = spark.read.parquet(f"{root}/benchmark.parquet")
    items.join(vectors, items.item_id == vectors.vec_id, "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding"
    ).write.parquet(f"{path}/queries")
    return [spark.read.parquet(f"{path}/{name}") for name in ("queries", "chunks", "documents")]


def test_vector_scan_is_not_shuffled_and_reads_two_columns(stored):
    queries, chunks, _ = stored
    text = plan(vector_search.vector_candidates(queries, chunks, 10))
    assert "Exchange" not in text
    assert "struct<chunk_id:bigint,embedding:array<float>>" in text
    assert "IsNotNull(embedding)" in text


def test_keyword_scan_is_not_shuffled(stored):
    queries, chunks, _ = stored
    found = fulltext.fts_matches(queries, fulltext.token_table(chunks))
    text = plan(found)
    assert not re.search(r"Exchange (?:hash|range|round|Single)", text)
    assert "struct<chunk_id:bigint,content:string>" in text  # no vectors read
    ranked = plan(fulltext.fts_search(queries, fulltext.token_table(chunks), 30))
    assert ranked.index("WindowGroupLimit") < ranked.index("Generate")


def test_hybrid_has_no_nested_loops(stored):
    queries, chunks, docs = stored
    text = plan(search.rerank(search.hybrid_search(queries, chunks, docs), queries))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # the contents flag is filtered in the scan of both legs
    assert text.count("is_toc") >= 2 and "PushedFilters" in text


def test_chunking_is_one_stage(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    chunks = chunking.chunk_sliding(docs).withColumn("is_toc", T.is_toc(F.col("content")))
    text = plan(chunks)
    assert "Exchange" not in text
    # the windows are computed once: two scans of the pattern (heads and tails)
    assert text.count("regexp_extract_all(text") == 2


def test_listing_counts_only_its_page(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select(
        F.col("doc_id").alias("document_id"), F.col("n_chars").alias("created_at"))
    chunks = spark.read.parquet(f"{root}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    text = plan(catalog.list_documents(docs, chunks, 10))
    assert "TakeOrderedAndProject" in text and "LeftSemi" in text and "text" not in re.findall(r"ReadSchema: (\S+)", text)


@pytest.mark.parametrize("name", ["fts_search", "fts_websearch", "cover_density", "postings"])
def test_registered_keyword_queries_read_no_vectors(spark, root, name):
    text = plan(plans.all_queries()[name](spark, root))
    assert "embedding" not in text


@pytest.mark.parametrize("name", ["hybrid_search", "rerank", "format_citations", "vector_search", "vector_fallback"])
def test_registered_searches_never_shuffle_texts(spark, root, name):
    """Hash exchanges before the final texts carry ids, numbers and vectors only; the texts of all
    chunks are spread once by key (small input) and joined by broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = plans.all_queries()[name](spark, root)
        nodes = shuffled(frame._jdf.queryExecution().optimizedPlan(), frame)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert nodes["texts beside vectors"] == 0


def shuffled(optimized, frame):
    """Number of joins whose both sides hold a whole text or a vector."""
    both = 0
    for line in optimized.toString().split("\n"):
        if re.search(r"Project \[.*\bcontent#\d+.*\bembedding#\d+|Project \[.*\bembedding#\d+.*\bcontent#\d+", line):
            both += 1
    return {"texts beside vectors": both}


@pytest.mark.parametrize("name", sorted(n for n in plans.all_queries() if not n.startswith("stream")))
def test_no_query_multiplies_tables(spark, root, name):
    text = plan(plans.all_queries()[name](spark, root))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
