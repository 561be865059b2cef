"""Document metadata and run reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docmill.functions import text as T


def with_title(docs: DataFrame, text_col: str = "content", path_col: str = "path") -> DataFrame:
    return docs.withColumn("title", T.extract_title(F.col(text_col), F.col(path_col)))


def with_source(docs: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """Path relative to the folder that was ingested."""
    base = root.rstrip("/") + "/"
    path = F.col(path_col)
    return docs.withColumn(
        "source",
        F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path)))
        .otherwise(path),
    )


def with_metadata(
    docs: DataFrame, text_col: str = "content", path_col: str = "path"
) -> DataFrame:
    """Add ``metadata``: file facts, then header fields over them, then line and word counts,
    which nothing overrides."""
    text = F.col(text_col)
    facts = F.create_map(
        F.lit("file_path"), F.col(path_col),
        F.lit("file_size"), F.length(text).cast("string"),
        F.lit("ingestion_date"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    )
    counts = F.create_map(
        F.lit("line_count"), T.line_count(text).cast("string"),
        F.lit("word_count"), T.word_count(text).cast("string"),
    )
    head = F.coalesce(T.frontmatter(text), F.create_map().cast("map<string,string>"))
    rows = docs.withColumns({"_facts": facts, "_head": head, "_counts": counts})

    def under(low: str, high: str):
        return F.map_concat(
            F.map_filter(low, lambda k, _: ~F.map_contains_key(F.col(high), k)), F.col(high)
        )

    rows = rows.withColumn("_facts", under("_facts", "_head"))
    return rows.withColumn("metadata", under("_facts", "_counts")).drop(
        "_facts", "_head", "_counts"
    )


def ingest_summary(
    docs: DataFrame, chunks: DataFrame, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: chunks made and errors; a document without chunks reports one."""
    made = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks_created"))
    rows = docs.join(made, key, "left").withColumn(
        "chunks_created", F.coalesce("chunks_created", F.lit(0)).cast("bigint")
    )
    # Fixed value: the error of a document without chunks.
    errors = F.when(F.col("chunks_created") == 0, F.array(F.lit("No chunks created"))).otherwise(
        F.array().cast("array<string>")
    )
    return rows.withColumn("errors", errors)


def run_totals(summary: DataFrame, by: list[str] = ()) -> DataFrame:
    return summary.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("chunks_created").alias("chunks"),
        F.sum(F.size("errors")).alias("errors"),
        F.count_if(F.size("errors") == 0).alias("succeeded"),
    )


def write_counted(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], path: str, first: Column) -> dict[str, int]:
    """Write the chunks that ``chunker`` makes of ``docs`` and return the totals of ``run_totals``,
    counted by the writing job itself. ``first`` is true for one chunk of every document that has any."""
    arrived, made = Observation(), Observation()
    chunks = chunker(docs.observe(arrived, F.count(F.lit(1)).alias("documents")))
    counted = chunks.observe(made, F.count(F.lit(1)).alias("chunks"), F.count_if(first).alias("succeeded"))
    counted.write.mode("overwrite").parquet(path)
    totals = arrived.get | made.get
    return totals | {"errors": totals["documents"] - totals["succeeded"]}


def conversion_summary(converted: DataFrame, text_col: str = "markdown") -> DataFrame:
    """Add status, length and a one-line preview of 200 characters."""
    text = F.col(text_col)
    ok = text.isNotNull() & (text != "")
    return converted.withColumns({
        "status": F.when(ok, "success").otherwise("failed"),
        "size": F.coalesce(F.length(text), F.lit(0)),
        "preview": F.replace(F.substring(F.coalesce(text, F.lit("")), 1, 200), F.lit("\n"), F.lit(" ")),
    })
