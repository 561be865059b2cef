"""Shared by the training-data operators: written intermediates, batches, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from docmill.session import checkpoint_dir, cut_lineage, ship_package

__all__ = [
    "bounded_sample", "crc_remainder", "cut_lineage", "numbered", "read_table", "release", "ship_package", "stored", "text_batches",
]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it from there: later
    steps read only the columns they need, and a lost executor loses nothing. With ``tidy`` Spark
    removes the shuffle files of the writing job at once, not when the driver's garbage is collected."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame, keep: DataFrame | None = None) -> None:
    """Remove the tables made by :func:`stored` that ``df`` reads and nothing reads any more, but none
    that ``keep`` reads."""
    spark = df.sparkSession
    kept = set(keep.inputFiles()) if keep is not None else set()
    for file in {path.rsplit("/", 1)[0] for path in set(df.inputFiles()) - kept}:
        if not file.rsplit("/", 1)[-1].startswith("stored-"):
            raise ValueError(f"{file} is not an intermediate table")
        place = spark._jvm.org.apache.hadoop.fs.Path(file)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return context.getCheckpointDir().rstrip("/")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus).cast("int")


def text_batches(batches: Iterator[pa.RecordBatch], rows: int, size: int, column: int = 1):
    """Cut Arrow batches so that one holds at most ``rows`` rows and about ``size`` bytes of text.
    A single text above ``size`` comes alone."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _byte_ends(batch.column(column))
        start = 0
        while start < batch.num_rows:
            base = offsets[start - 1] if start else 0
            stop = int(np.searchsorted(offsets, base + size, side="right"))
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def bounded_sample(df: DataFrame, pick: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash ``pick`` among about twice as many that another hash
    of it lets through, so that few rows come together however many tasks there are."""
    total = df.count()
    if total > 4 * rows:
        share = int(2 * rows / total * (1 << 40))
        df = df.where(F.pmod(F.xxhash64(pick), F.lit(1 << 40)) < share)
    return df.orderBy(pick).limit(rows)


def _byte_ends(values: pa.Array):
    """Running total of bytes at the end of each value."""
    import numpy as np
    import pyarrow.compute as pc

    return np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))


def numbered(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that come before in ``order``, which has to
    be unique. Rows are dealt by range; only one total per range meets in one task."""
    placed = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = stored(placed, tidy=True)
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(totals), "_range")
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_range", "_base")
    )
