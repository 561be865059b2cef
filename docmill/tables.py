"""The given tables as a knowledge base: documents, chunks, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table, with the files that it has now."""
    return spark.read.parquet(f"{root}/{name}.parquet")


ROWS_PER_TASK = 2_000  # rows of heavy work that a task is given; it may meet four times as many


def tasks_needed(df: DataFrame, rows: int = ROWS_PER_TASK) -> int | None:
    """How many tasks the rows of ``df`` should be dealt to, None if its splits will do. The rows of
    each split are counted: a file cut by bytes has splits without any row, as a row group belongs to
    one split whole."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    filled, most, total = splits.agg(F.count("n"), F.max("n"), F.sum("n")).first()
    if filled >= cores and most <= 4 * rows:
        return None
    return max(cores, -(-(total or 0) // rows))


def spread(df: DataFrame, *key: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Give heavy per-row work a task per core, and one for every ``rows`` rows of a larger input, so
    that no task grows with the input. An input whose splits are like that is left alone."""
    tasks = tasks_needed(df, rows)
    return df.repartition(tasks, *key) if tasks else df


def chunk_texts(spark: SparkSession, root: str, toc: bool = True, rows: int = ROWS_PER_TASK) -> DataFrame:
    """One chunk per text, without vectors. The parent document is its ``source``, so a parent holds
    many chunks. Lighter work may take more ``rows`` a task, which spares a shuffle of the texts."""
    docs = spread(load(spark, root, "documents").select("doc_id", "source", "text"), "doc_id", rows=rows)
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.col("text").alias("content"),
        # stored by ingestion in earnest; generated here so that a filter on it stays above
        # the repartitioning instead of running the patterns in the one task that reads the file
        *([F.explode_outer(F.array(T.is_toc(F.col("text")))).alias("is_toc")] if toc else []),
    )


def chunk_vectors(spark: SparkSession, root: str, toc: bool = True) -> DataFrame:
    """Vectors of the chunks with the chunk's document and contents flag, without texts. Only these
    narrow columns meet in the join."""
    vectors = load(spark, root, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return chunk_texts(spark, root, toc).drop("content").join(vectors, "chunk_id")


def document_table(spark: SparkSession, root: str) -> DataFrame:
    """One document per ``source``; its title is the first line of its first text."""
    docs = load(spark, root, "documents")
    return docs.groupBy(F.col("source").alias("document_id")).agg(
        F.min_by(F.substring_index("text", "\n", 1), "doc_id").alias("title"),
        F.concat(F.first("source"), F.lit(".md")).alias("source"),
    )


def question_table(spark: SparkSession, root: str) -> DataFrame:
    """Every benchmark text as a question, without vectors."""
    return load(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def query_table(spark: SparkSession, root: str) -> DataFrame:
    """Every question with the vector of the same number."""
    vectors = load(spark, root, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )
    return question_table(spark, root).join(vectors, "query_id", "left")
