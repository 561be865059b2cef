"""Top rows per key and positions within a key, safe for keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rank",
    salt: Column | None = None,
    salts: int = 64,
) -> DataFrame:
    """The first ``k`` rows of every key with their 1-based rank.

    With ``salt`` a key's rows are first cut to ``k`` per salt value in parallel, so the last
    window sees ``k * salts`` rows of a key however many there were. Both steps keep the exact
    first ``k``: ``order`` must be total.
    """
    if salt is not None:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        df = df.drop("_r", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def number_rows(
    df: DataFrame,
    key: str,
    bucket: Column,
    order: list[Column],
    name: str = "row_no",
) -> DataFrame:
    """``row_number`` per key without sorting a whole key in one task.

    ``bucket`` must not decrease along ``order`` (an hour, a block of turns). Rows are numbered
    inside (key, bucket); the counts of earlier buckets are added from a summary that has one
    row per bucket.
    """
    rows = df.withColumn("_b", bucket)
    local = rows.withColumn(
        "_n", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
    )
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(key, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(key, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    )
    return (
        local.join(offsets, [key, "_b"])
        .withColumn(name, F.col("_n") + F.col("_o"))
        .drop("_n", "_o", "_b")
    )


def number_runs(
    df: DataFrame,
    key: str,
    bucket: Column,
    order: list[str],
    value: str,
    name: str = "run",
) -> DataFrame:
    """Number the runs of equal consecutive values per key, starting at 1.

    Runs are found inside (key, bucket). A bucket summary (first value, last value, changes)
    tells which buckets continue the run before them and how many runs came earlier, so the
    per-key window reads one row per bucket.
    """
    rows = df.withColumn("_b", bucket)
    w = Window.partitionBy(key, "_b").orderBy(*order)
    previous = F.lag(value).over(w)
    first_row = F.row_number().over(w) == 1
    change = (~first_row & ~previous.eqNullSafe(F.col(value))).cast("int")
    marked = rows.withColumn("_change", change).withColumn("_local", F.sum("_change").over(w))
    place = F.struct(*order)
    summary = marked.groupBy(key, "_b").agg(
        F.min_by(value, place).alias("_first"),
        F.max_by(value, place).alias("_last"),
        F.sum("_change").alias("_changes"),
    )
    by_bucket = Window.partitionBy(key).orderBy("_b")
    starts_new = (
        (F.row_number().over(by_bucket) == 1)
        | ~F.lag("_last").over(by_bucket).eqNullSafe(F.col("_first"))
    ).cast("int")
    summary = summary.withColumn("_new", starts_new)
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        key,
        "_b",
        (
            F.coalesce(F.sum(F.col("_changes") + F.col("_new")).over(before), F.lit(0))
            + F.col("_new")
        ).alias("_base"),
    )
    return (
        marked.join(summary, [key, "_b"])
        .withColumn(name, F.col("_local") + F.col("_base"))
        .drop("_b", "_change", "_local", "_base")
    )
