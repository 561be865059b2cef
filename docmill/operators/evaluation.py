"""Retrieval quality: keyword hits, search comparison and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grids of the threshold reports.
SWEEP_GRID = [0.0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
ANALYSIS_GRID = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65]


def keyword_hits(results: DataFrame, golden: DataFrame) -> DataFrame:
    """How many expected keywords occur in the results of each golden question, and the
    similarity of its first result. ``results`` holds a few rows per question."""
    text = F.lower(F.concat("content", F.lit(" "), "document_title"))
    gathered = results.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda r: r["t"]
            ),
            " ",
        ).alias("_all"),
        F.min_by("similarity", "rank").alias("top_similarity"),
    )
    found = F.filter(
        "expected_keywords", lambda k: F.contains(F.col("_all"), F.lower(k))
    )
    return golden.join(gathered, "query_id", "left").select(
        *golden.columns,
        F.when(F.col("_all").isNull(), 0).otherwise(F.size(found)).alias("hits"),
        F.size("expected_keywords").alias("total"),
        F.coalesce("top_similarity", F.lit(0.0)).alias("top_similarity"),
    )


def winner(vector: Column, hybrid: Column) -> Column:
    return F.when(hybrid > vector, "HYBRID").when(vector > hybrid, "VECTOR").otherwise("TIE")


def compare_search(vector_hits: DataFrame, hybrid_hits: DataFrame) -> DataFrame:
    """Hits of both searches by question type, with a total row and the winner of each."""
    left = vector_hits.select(
        "query_id", "query_type", "total", F.col("hits").alias("_v"), F.col("top_similarity").alias("_vs")
    )
    right = hybrid_hits.select(
        "query_id", F.col("hits").alias("_h"), F.col("top_similarity").alias("_hs")
    )
    rows = left.join(right, "query_id").rollup("query_type").agg(
        F.sum("_v").alias("vector_hits"),
        F.sum("_h").alias("hybrid_hits"),
        F.sum("total").alias("total"),
        F.avg("_vs").alias("vector_similarity"),
        F.avg("_hs").alias("hybrid_similarity"),
    )
    return rows.withColumn("query_type", F.coalesce("query_type", F.lit("TOTAL"))).withColumn(
        "winner", winner(F.col("vector_hits"), F.col("hybrid_hits"))
    )


def threshold_sweep(
    queries: DataFrame, results: DataFrame, grid: list[float] = SWEEP_GRID
) -> DataFrame:
    """Result count and similarities per question and threshold.

    ``results`` are the first k at the lowest threshold; the first k at a higher one are those
    of them that reach it, so the search runs once. Every row is counted for the thresholds it
    reaches, without a cross join.
    """
    steps = F.array(*[F.lit(float(t)) for t in grid])
    reached = results.select(
        "query_id",
        "similarity",
        F.explode(F.filter(steps, lambda t: F.col("similarity") >= t)).alias("threshold"),
    )
    stats = reached.groupBy("query_id", "threshold").agg(
        F.count(F.lit(1)).alias("results"),
        F.max("similarity").alias("max_similarity"),
        F.avg("similarity").alias("avg_similarity"),
        F.min("similarity").alias("min_similarity"),
    )
    every = queries.select("query_id", F.explode(steps).alias("threshold"))
    return every.join(stats, ["query_id", "threshold"], "left").withColumn(
        "results", F.coalesce("results", F.lit(0))
    )


def relevance_label(similarity: Column) -> Column:
    # Labels and their limits.
    return (
        F.when(similarity >= 0.7, "HIGH").when(similarity >= 0.5, "MEDIUM")
        .when(similarity >= 0.4, "LOW").otherwise("VERY LOW")
    )


def recommend_threshold(sweep: DataFrame, least: float = 0.4) -> DataFrame:
    """The highest threshold that still gives a result with similarity ``least``, or NULL."""
    good = (F.col("results") > 0) & (F.col("max_similarity") >= least)
    return sweep.groupBy("query_id").agg(
        F.max(F.when(good, F.col("threshold"))).alias("recommended"),
        F.max("max_similarity").alias("best_similarity"),
    ).withColumn("relevance", relevance_label(F.coalesce("best_similarity", F.lit(0.0))))
