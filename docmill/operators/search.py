"""Hybrid retrieval: two ranked legs, fusion, diversity, re-ranking and presentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import vectors as V
from docmill.operators.fulltext import Analyzer, fts_search, simple_analyzer, token_table
from docmill.operators.ranking import top_per_key
from docmill.operators.vector_search import QUERY_ROWS, vector_leg, vector_search

LIMIT = 30
THRESHOLD = 0.30
OUT_OF_SCOPE = 0.45
RRF_K = 50
MAX_PER_DOCUMENT = 3
TITLE_BOOST = 0.15
CANDIDATES = 3  # each leg keeps this many times the limit
BROADCAST_ROWS = 120_000  # most result rows (ids, ranks, titles) sent to every executor


def without_toc(chunks: DataFrame, exclude: bool = True) -> DataFrame:
    return chunks.where(~F.coalesce("is_toc", F.lit(False))) if exclude else chunks


def rrf_fuse(text_leg: DataFrame, vector_leg: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two legs ``(query_id, chunk_id, document_id, rank)``. The legs
    are stacked and grouped once; a leg without the chunk adds nothing."""
    keys = ["query_id", "chunk_id", "document_id"]
    none = F.lit(None).cast("int")
    stacked = text_leg.select(*keys, F.col("rank").alias("text_rank"), none.alias("vector_rank"))
    stacked = stacked.unionByName(
        vector_leg.select(*keys, none.alias("text_rank"), F.col("rank").alias("vector_rank"))
    )
    merged = stacked.groupBy(*keys).agg(
        F.max("text_rank").alias("text_rank"), F.max("vector_rank").alias("vector_rank")
    )

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))

    return merged.withColumn("score", part("text_rank") + part("vector_rank"))


def limit_per_document(fused: DataFrame, max_per_doc: int = MAX_PER_DOCUMENT) -> DataFrame:
    """At most ``max_per_doc`` chunks of a document per query, best score first."""
    return top_per_key(
        fused,
        ["query_id", "document_id"],
        [F.col("score").desc(), F.col("chunk_id")],
        max_per_doc,
        rank="doc_rank",
    )


def is_small(queries: DataFrame, k: int) -> bool:
    """True when ``k`` results for every query are few enough to broadcast as narrow rows, and
    the query vectors are too."""
    most = min(BROADCAST_ROWS // k, QUERY_ROWS)
    return queries.limit(most + 1).count() <= most


def attach_chunks(
    hits: DataFrame, chunks: DataFrame, docs: DataFrame, small: bool, columns: list[str] = ()
) -> DataFrame:
    """Add document columns and then chunk text to result rows ``(query_id, chunk_id,
    document_id, ...)``.

    Results hold at most ``k`` rows of ids and numbers per query. When that is ``small`` these, and
    no titles or texts, are broadcast to both tables, which are scanned and not shuffled; what is
    left of them, the rows of the results, is joined as its size allows.
    """
    def near(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if small else rows

    about = docs.select(
        "document_id",
        F.col("title").alias("document_title"),
        F.col("source").alias("document_source"),
        *([F.col("metadata").alias("document_metadata")] if "metadata" in docs.columns else []),
    )
    about = about.join(near(hits.select("document_id").distinct()), "document_id", "leftsemi")
    extra = [c for c in ("metadata", "page_start", "page_end") if c in chunks.columns]
    text = chunks.select("chunk_id", "content", *extra, *columns)
    return text.join(near(hits), "chunk_id").join(about, "document_id")


def hybrid_candidates(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = LIMIT,
    threshold: float = THRESHOLD,
    rrf_k: int = RRF_K,
    exclude_toc: bool = True,
    max_per_doc: int = MAX_PER_DOCUMENT,
    tokens: DataFrame | None = None,
    stats: DataFrame | None = None,
    analyzer: Analyzer = simple_analyzer,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Fused, capped and cut result ids: ``(query_id, chunk_id, document_id, text_rank,
    vector_rank, score, rank)``. Only ids and ranks travel; text is joined afterwards.

    The similarity threshold applies to the vector leg alone, and a query without keyword
    matches keeps its vector results. ``vectors`` (chunk_id, document_id, is_toc, embedding) are the
    chunks' vectors if ``chunks`` does not hold them; the keyword leg never reads them.
    """
    pool = without_toc(chunks, exclude_toc)
    if tokens is None:
        tokens = token_table(pool, analyzer, ["document_id"])
    text_hits = fts_search(queries, tokens, CANDIDATES * k, stats, analyzer, ["document_id"])
    beside = pool if vectors is None else without_toc(vectors, exclude_toc)
    near = vector_leg(queries, beside, CANDIDATES * k, threshold, ["document_id"])
    fused = limit_per_document(rrf_fuse(text_hits, near, rrf_k), max_per_doc)
    return top_per_key(fused, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    k: int = LIMIT,
    threshold: float = THRESHOLD,
    rrf_k: int = RRF_K,
    exclude_toc: bool = True,
    max_per_doc: int = MAX_PER_DOCUMENT,
    mode: str = "hybrid",
    vectors: DataFrame | None = None,
    **index,
) -> DataFrame:
    """Chunks found by meaning and by words, fused by reciprocal rank, with their similarity
    (NULL without a vector), text and document. ``mode="vector"`` uses the vectors alone.
    ``vectors`` (chunk_id, document_id, is_toc, embedding) are the chunks' vectors if ``chunks`` does
    not hold them."""
    small = is_small(queries, k)
    if mode == "vector":
        return vector_search(queries, chunks, docs, k, threshold, vectors)
    if vectors is None and "embedding" not in chunks.columns:
        vectors = chunks.select(
            "chunk_id", "document_id", "is_toc", F.lit(None).cast("array<float>").alias("embedding")
        )
    found = hybrid_candidates(
        queries, chunks, k, threshold, rrf_k, exclude_toc, max_per_doc, vectors=vectors, **index
    )
    own = (chunks if vectors is None else vectors).select("chunk_id", "embedding")
    asked = queries.select("query_id", F.col("embedding").alias("_asked"))
    pairs = found.select("query_id", "chunk_id")
    known = own.join(F.broadcast(pairs) if small else pairs, "chunk_id")
    known = known.join(F.broadcast(asked) if small else asked, "query_id").select(
        "query_id", "chunk_id",
        F.round(V.cosine(F.col("embedding"), F.col("_asked")), 12).alias("similarity"),
    )
    found = found.join(known, ["query_id", "chunk_id"], "left")
    return attach_chunks(found, chunks, docs, small)


def rerank(
    results: DataFrame,
    queries: DataFrame,
    max_boost: float = TITLE_BOOST,
    classifiers: list[str] | None = None,
    order: Column | None = None,
) -> DataFrame:
    """Raise similarities by title matches and rank again (``position`` from 1).

    Keywords come from the original question. A question without keywords keeps the fusion
    order; ``order`` is that order (descending), by default ``score``.
    """
    words = (
        queries.select("query_id", T.normalize_text(F.col("query")).alias("_text"))
        .select("query_id", T.extract_keywords(F.col("_text"), classifiers, normalized=True)
                .alias("keywords"))
    )
    rows = results.join(words, "query_id")
    rows = rows.withColumn(
        "boost", T.title_boost(F.col("document_title"), F.col("keywords"), max_boost, classifiers)
    )
    rows = rows.withColumn("title_boosted", (F.col("boost") > 0)).withColumn(
        "similarity",
        F.when(
            F.col("boost") > 0,
            F.when(
                F.col("similarity").isNotNull(),
                F.least(F.col("similarity") + F.col("boost"), F.lit(1.0)),
            ),
        ).otherwise(F.col("similarity")),
    )
    base = order if order is not None else F.col("score")
    key = F.when(F.size("keywords") > 0, F.coalesce("similarity", F.lit(-2.0))).otherwise(base)
    rows = rows.withColumn("_key", key)
    # ties keep the order of the search, as a stable sort does
    return top_per_key(
        rows,
        ["query_id"],
        [F.col("_key").desc(), base.desc(), F.col("chunk_id")],
        2**31 - 1,
        rank="position",
    ).drop("_key")


def result_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunks_found"),
        F.avg("similarity").alias("avg_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.min("similarity").alias("min_similarity"),
    )


def scope_verdict(
    results: DataFrame, queries: DataFrame, out_of_scope: float = OUT_OF_SCOPE
) -> DataFrame:
    """``no_result``, ``out_of_scope`` or ``answered`` per query, with the best percentage."""
    best = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.max("similarity").alias("max_similarity"),
    )
    top = F.coalesce("max_similarity", F.lit(0.0))
    return (
        queries.select("query_id")
        .join(best, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
            F.when(F.coalesce("found", F.lit(0)) == 0, "no_result")
            .when(top < out_of_scope, "out_of_scope")
            .otherwise("answered")
            .alias("verdict"),
            (top * 100.0).cast("int").alias("best_percent"),
        )
    )


def page_range(start: Column, end: Column) -> Column:
    """``p. 3-7`` or ``p. 3``; page 0 counts, no start gives NULL."""
    first = F.concat(F.lit("p. "), start.cast("string"))
    return F.when(
        start.isNotNull(),
        F.when(
            end.isNotNull() & (end != start), F.concat(first, F.lit("-"), end.cast("string"))
        ).otherwise(first),
    )


def source_objects(results: DataFrame) -> DataFrame:
    """Result rows as source records. ``document_metadata`` may be a string map or JSON text;
    JSON that is no object has no fields. URL and metadata appear only with a URL."""
    cols = dict(results.dtypes)

    def field(column: str, key: str) -> Column:
        if column not in cols:
            return F.lit(None).cast("string")
        if cols[column].startswith("map"):
            return F.col(column)[key]
        if cols[column] == "string":
            return F.get_json_object(column, f"$.{key}")
        return F.lit(None).cast("string")

    start = F.col("page_start") if "page_start" in cols else field("metadata", "page_start").cast("int")
    end = F.col("page_end") if "page_end" in cols else field("metadata", "page_end").cast("int")
    url = field("document_metadata", "url")
    url = F.when(url != "", url)
    meta = F.col("document_metadata") if "document_metadata" in cols else F.lit(None).cast("string")
    keep = [c for c in ("position", "rank") if c in cols]
    return results.select(
        "query_id",
        *keep,
        "chunk_id",
        F.col("document_title").alias("title"),
        F.col("document_source").alias("path"),
        "similarity",
        "content",
        start.alias("page_number"),
        page_range(start, end).alias("page_range"),
        url.alias("url"),
        F.when(url.isNotNull(), meta).alias("metadata"),
    )


def citation(position: Column, title: Column, similarity: Column, content: Column) -> Column:
    # The citation line and its mark for weak hits.
    percent = (similarity * 100.0).cast("int")
    return F.concat(
        F.lit("["), position.cast("string"), F.lit('] Source: "'), title,
        F.lit('" (Pertinence: '), F.coalesce(percent, F.lit(0)).cast("string"), F.lit("%"),
        F.when(F.coalesce(similarity, F.lit(0.0)) < 0.6, " - FAIBLE").otherwise(""),
        F.lit(")\n"), content, F.lit("\n"),
    )


def format_citations(results: DataFrame, position: str = "position") -> DataFrame:
    """One context text per query: a header with the count, then the numbered citations."""
    line = citation(
        F.col(position), F.col("document_title"), F.col("similarity"), F.col("content")
    )
    gathered = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("no"), line.alias("text"))))
        .alias("_lines")
    )
    # Fixed value: the header line.
    return gathered.select(
        "query_id",
        F.concat(
            F.lit("Trouvé "),
            F.size("_lines").cast("string"),
            F.lit(" résultats pertinents (triés par pertinence):\n\n"),
            F.array_join(F.transform("_lines", lambda x: x["text"]), "\n---\n"),
        ).alias("context"),
    )


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Question plus the extra terms of every known word in it (``synonyms``: term, extra).

    Terms are matched as whole normalised words and joined by key; a question without a known
    word stays as it is.
    """
    words = queries.select(
        "query_id", F.explode(F.array_distinct(T.tokens(T.normalize_text(F.col("query"))))).alias("term")
    )
    extra = (
        words.join(synonyms, "term")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("term", "extra"))).alias("_extra"))
        .select(
            "query_id",
            F.array_join(F.transform("_extra", lambda e: e["extra"]), " ").alias("extra"),
        )
    )
    return queries.join(extra, "query_id", "left").withColumn(
        "expanded",
        F.when(F.col("extra").isNull(), F.col("query")).otherwise(
            F.concat_ws(" ", "query", "extra")
        ),
    ).drop("extra")


def expand_with(queries: DataFrame, expander: Callable[[list[str]], list[str]]) -> DataFrame:
    """Question plus what a function from questions to extra text (a language model) adds.
    A batch that fails keeps its questions unchanged."""

    @F.pandas_udf("string")
    def extra(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                yield pd.Series([t.strip() or None for t in expander(texts.tolist())])
            except Exception:  # expansion is optional: a failed batch is searched as asked
                yield pd.Series([None] * len(texts), dtype="object")

    return queries.withColumn("expanded", F.concat_ws(" ", "query", extra("query")))


def dedup_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct questions (one ``query_id`` each) and the map from every question to it."""
    printed = queries.withColumn(
        "fingerprint", T.fingerprint(F.col("query"), F.col("embedding"))
    )
    lead = printed.groupBy("fingerprint").agg(F.min("query_id").alias("lead_id"))
    mapping = printed.select("query_id", "fingerprint").join(lead, "fingerprint")
    distinct = queries.join(lead.select(F.col("lead_id").alias("query_id")), "query_id", "semi")
    return distinct, mapping


def search_distinct(queries: DataFrame, chunks: DataFrame, docs: DataFrame, **params) -> DataFrame:
    """Search every distinct question once and give its results to all its copies."""
    distinct, mapping = dedup_queries(queries)
    found = vector_search(distinct, chunks, docs, **params)
    return found.withColumnRenamed("query_id", "lead_id").join(mapping, "lead_id").drop("lead_id")
