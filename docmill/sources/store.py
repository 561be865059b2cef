"""Writing, replacing, deleting and updating the stored documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T


def write_corpus(
    docs: DataFrame,
    chunks: DataFrame,
    path: str,
    mode: str = "overwrite",
    keep_null_embeddings: bool = True,
) -> None:
    """Store documents and chunks as parquet below ``path``.

    ``overwrite`` replaces everything (documents stay readable until their chunks are gone, as
    chunks are replaced first), ``append`` adds without looking for duplicates. Chunks without
    a vector can be left out. Files are sorted by document inside, so a read of a few documents
    skips most row groups; no shuffle is made for it.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    kept = chunks if keep_null_embeddings else chunks.where(F.col("embedding").isNotNull())
    kept.sortWithinPartitions("document_id").write.mode(mode).parquet(f"{path}/chunks")
    docs.write.mode(mode).parquet(f"{path}/documents")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/chunks")


def cascade_delete(
    docs: DataFrame, chunks: DataFrame, doomed: DataFrame, key: str = "document_id"
) -> tuple[DataFrame, DataFrame]:
    """Documents not named in ``doomed`` and the chunks of those documents."""
    gone = doomed.select(key).distinct()
    return docs.join(gone, key, "left_anti"), chunks.join(gone, key, "left_anti")


def table_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per table with its number of rows."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table_name"), "rows"
    )
    return one(docs, "documents").unionAll(one(chunks, "chunks"))


def upsert_documents(
    stored: DataFrame, incoming: DataFrame, now: Column, key: str = "document_id"
) -> DataFrame:
    """Merge ``incoming`` over ``stored``. A row that arrives is stamped ``updated_at``; a new
    one also gets ``created_at``; every other row keeps both."""
    values = [c for c in incoming.columns if c != key]
    left = stored.withColumn("_old", F.lit(True)).alias("s")
    right = incoming.withColumn("_new", F.lit(True)).alias("i")
    joined = left.join(right, key, "full_outer")
    merged = [
        (
            F.when(F.col("_new"), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
            if c in values
            else F.col(f"s.{c}")
        )
        for c in stored.columns
        if c not in (key, "created_at", "updated_at")
    ]
    return joined.select(
        key,
        *merged,
        F.when(F.col("_old"), F.col("s.created_at")).otherwise(now).alias("created_at"),
        F.when(F.col("_new"), now).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a document id: the first 32 bits of the md5 of its text, modulo ``buckets``."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return (head % buckets).cast("int")


def write_bucketed(
    docs: DataFrame, chunks: DataFrame, path: str, buckets: int = BUCKETS, key: str = "document_id"
) -> None:
    """Store documents and chunks in one folder per bucket of the document id, replacing what is
    there. Later changes rewrite only the buckets that they touch. Rows are rebalanced by bucket, so
    that one with very many rows is written by several tasks."""
    spark = docs.sparkSession
    for name, table in (("chunks", chunks), ("documents", docs)):
        rows = table.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket")
        rows.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    settings = spark.createDataFrame([(buckets, key)], "buckets int, key string")
    settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def read_bucketed(spark: SparkSession, path: str, name: str, schema=None) -> DataFrame:
    """A stored table with its ``bucket``."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/{name}")


def _settings(spark: SparkSession, path: str) -> tuple[int, str]:
    row = spark.read.parquet(f"{path}/settings").first()
    return row["buckets"], row["key"]


def _numbers(rows: DataFrame) -> list[int]:
    """The buckets of ``rows``; there are no more than the store has."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def _rewrite(rows: DataFrame, path: str, touched: list[int], key: str) -> None:
    """Replace the ``touched`` buckets of a table by ``rows``; a bucket without rows goes."""
    spark = rows.sparkSession
    written = Observation()
    (
        rows.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", key)
        .observe(written, F.collect_set("bucket").alias("buckets"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
    for bucket in set(touched) - set(written.get["buckets"] or []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_bucketed(spark: SparkSession, path: str, doomed: DataFrame) -> None:
    """Delete the documents named in ``doomed`` and their chunks. Only buckets that hold one of them
    are read whole and written anew; chunks go first, so that none is ever without its document."""
    buckets, key = _settings(spark, path)
    gone = doomed.select(key).distinct()
    asked = _numbers(gone.withColumn("bucket", bucket_of(F.col(key), buckets)))
    for name in ("chunks", "documents"):
        table = read_bucketed(spark, path, name)
        near = table.where(F.col("bucket").isin(asked))
        touched = _numbers(near.join(gone, key, "left_semi"))
        if touched:
            kept = table.where(F.col("bucket").isin(touched)).join(gone, key, "left_anti")
            _rewrite(kept.select(table.columns), f"{path}/{name}", touched, key)


def upsert_bucketed(spark: SparkSession, path: str, incoming: DataFrame, now: Column) -> None:
    """Merge ``incoming`` into the stored documents as ``upsert_documents`` does, reading and writing
    only the buckets of the ids that arrive."""
    buckets, key = _settings(spark, path)
    touched = _numbers(incoming.select(bucket_of(F.col(key), buckets).alias("bucket")))
    if not touched:
        return
    table = read_bucketed(spark, path, "documents")
    old = table.where(F.col("bucket").isin(touched)).drop("bucket")
    merged = upsert_documents(old, incoming, now, key).withColumn("bucket", bucket_of(F.col(key), buckets))
    _rewrite(merged.select(table.columns), f"{path}/documents", touched, key)


def bucket_versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row per bucket with a number that changes when one of its files does."""
    files = read_bucketed(spark, path, name).select(
        "bucket", "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    mark = F.xxhash64("file_path", "file_modification_time", "file_size").cast("decimal(38,0)")
    return files.groupBy("bucket").agg(F.sum(mark).alias("version"))


def yaml_scalar(value: Column) -> Column:
    """A string as YAML writes it: plain, or in single quotes where plain would change it."""
    special = (
        (value == "")
        | value.rlike(r"^[\s]|\s$|: |:$| #|^[-?:] |^[-?:]$|^[\[\]{},#&*!|>'\"%@`]")
        | value.rlike(r"^[-+]?(?:[0-9][0-9_]*)?\.?[0-9_]+(?:[eE][-+][0-9]+)?$")
        | value.rlike(r"^(?i:true|false|yes|no|on|off|null|~|y|n)$")
        | value.rlike(r"^\d{4}-\d\d?-\d\d?(?:[Tt ].*)?$")
        | value.rlike("^---|^\\.\\.\\.|^=$")
    )
    return F.when(
        special, F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    ).otherwise(value)


def render_markdown(pages: DataFrame, fields: dict[str, Column], body: Column) -> DataFrame:
    """Add ``document``: page metadata as a sorted header, a blank line and the page text.
    NULL fields are left out."""
    lines = [
        F.when(col.isNotNull(), F.concat(F.lit(f"{name}: "), yaml_scalar(col)))
        for name, col in sorted(fields.items())
    ]
    return pages.withColumn(
        "document",
        F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), body),
    )
