"""Lookups, listings, counts and parameterised SQL over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from docmill.operators.search import hybrid_search
from docmill.operators.vector_search import vector_search
from docmill.sources.store import table_counts

__all__ = [
    "get_documents", "get_by_source", "list_documents", "table_counts", "run_sql", "call_function",
]

# search functions that can be called by name
FUNCTIONS = {"match_chunks": vector_search, "hybrid_search": hybrid_search}


def get_documents(docs: DataFrame, wanted: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents with the wanted ids; an id without a document gives no row."""
    return docs.join(wanted.select(key).distinct(), key, "left_semi")


def get_by_source(docs: DataFrame, wanted: DataFrame, id_col: str = "document_id") -> DataFrame:
    """The document of each wanted source, only where exactly one has it.

    Counted before the join, so a source with very many documents is one row.
    """
    single = (
        docs.groupBy("source")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias(id_col))
        .where("_n = 1")
        .drop("_n")
    )
    return single.join(wanted.select("source").distinct(), "source", "left_semi")


def contains_all(metadata: Column, wanted: dict[str, str]) -> Column:
    """True when a string map holds every wanted pair."""
    held = F.lit(True)
    for key, value in wanted.items():
        held = held & F.coalesce(metadata[key] == value, F.lit(False))
    return held


NUMBERS = ["BIGINT", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT"]


def contains_json(value: Column, wanted) -> Column:
    """True when a variant holds ``wanted`` (dict, list, string, number, bool or None): an object holds
    every wanted key with a value that holds the wanted one, an array holds every wanted element
    somewhere, numbers are compared by value, and everything else by type and value. A whole array also
    holds a single wanted scalar."""
    if not isinstance(wanted, (dict, list)):
        inside = F.try_variant_get(value, "$", "array<variant>")
        return _same_json(value, wanted) | F.coalesce(F.exists(inside, lambda x: _holds_json(x, wanted)), F.lit(False))
    return _holds_json(value, wanted)


def _holds_json(value: Column, wanted) -> Column:
    if isinstance(wanted, dict):
        held = F.try_variant_get(value, "$", "map<string,variant>")
        parts = [F.array_contains(F.map_keys(held), key) & _holds_json(F.try_element_at(held, F.lit(key)), item)
                 for key, item in wanted.items()]
    elif isinstance(wanted, list):
        held = F.try_variant_get(value, "$", "array<variant>")
        parts = [F.exists(held, _holder(item)) for item in wanted]
    else:
        return _same_json(value, wanted)
    found = held.isNotNull()
    for part in parts:
        found = found & F.coalesce(part, F.lit(False))
    return found


def _holder(wanted):
    return lambda value: _holds_json(value, wanted)


def _same_json(value: Column, wanted) -> Column:
    kind = F.schema_of_variant(value)
    if wanted is None:
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    if isinstance(wanted, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    elif isinstance(wanted, (int, float)):
        number = kind.isin(NUMBERS) | kind.startswith("DECIMAL")
        same = number & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    else:
        same = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    return F.coalesce(same, F.lit(False))


def list_documents(
    docs: DataFrame,
    chunks: DataFrame,
    limit: int = 100,
    offset: int = 0,
    metadata_filter: dict | None = None,
    key: str = "document_id",
) -> DataFrame:
    """A page of documents, newest first, with their chunk counts. ``metadata`` may be a map of
    strings, a variant or JSON text; the latter two can be filtered by nested values.

    The page is cut before chunks are counted: it has at most ``limit`` rows, so it is
    broadcast to the chunk scan and only its chunks are grouped.
    """
    rows = docs
    if metadata_filter and isinstance(docs.schema["metadata"].dataType, MapType):
        rows = docs.where(contains_all(F.col("metadata"), metadata_filter))
    elif metadata_filter:
        value = F.col("metadata")
        value = F.try_parse_json(value) if isinstance(docs.schema["metadata"].dataType, StringType) else value
        rows = docs.where(contains_json(value, metadata_filter))
    page = rows.orderBy(F.col("created_at").desc(), key).offset(offset).limit(limit)
    counts = (
        chunks.select(key)
        .join(F.broadcast(page.select(key)), key, "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("chunk_count"))
    )
    return page.join(counts, key, "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("bigint")
    )


def run_sql(spark: SparkSession, query: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL over named frames (``{name}`` in the text) with ``:parameters``."""
    return spark.sql(query, args=args or {}, **frames)


def call_function(name: str, **params) -> DataFrame:
    return FUNCTIONS[name](**params)


def create_search_function(spark: SparkSession, chunks: DataFrame, documents: DataFrame) -> None:
    """The session's SQL gets the table function ``match_chunks(query_embedding, match_count,
    similarity_threshold)``, which a statement can join laterally for each of its rows."""
    chunks.createOrReplaceTempView("searchable_chunks")
    documents.createOrReplaceTempView("searchable_documents")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    a, q = "c.embedding", "query_embedding"
    cosine = f"try_divide({dot.format(a, q)}, sqrt({dot.format(a, a)}) * sqrt({dot.format(q, q)}))"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION match_chunks(
          query_embedding ARRAY<FLOAT>, match_count INT, similarity_threshold DOUBLE)
        RETURNS TABLE (chunk_id BIGINT, content STRING, similarity DOUBLE, document_title STRING, document_source STRING)
        RETURN
          SELECT chunk_id, content, similarity, title, source FROM (
            SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS place FROM (
              SELECT c.chunk_id, c.content, round({cosine}, 12) AS similarity, d.title, d.source
              FROM searchable_chunks c JOIN searchable_documents d ON d.document_id = c.document_id)
            WHERE similarity >= match_chunks.similarity_threshold)
          WHERE place <= match_chunks.match_count""")
