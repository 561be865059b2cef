"""Search queries over the given tables and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import tables
from docmill.functions import text as T
from docmill.functions import vectors as V
from docmill.functions.arrays import explode_rows
from docmill.functions.stemming import french_stems, stems_sql
from docmill.operators import fulltext as FT
from docmill.operators import search as S
from docmill.operators.vector_search import vector_leg, vector_search
from docmill.plans import sql as Q


def _round(name: str):
    return F.round(name, 9).alias(name)


def q_vector_search(spark: SparkSession, root: str) -> DataFrame:
    found = vector_search(
        tables.query_table(spark, root),
        tables.chunk_texts(spark, root, toc=False),
        tables.document_table(spark, root),
        vectors=tables.chunk_vectors(spark, root, toc=False),
    )
    return found.select(
        "query_id", "rank", "chunk_id", "document_id", "document_title", "document_source",
        F.md5("content").alias("content_md5"), _round("similarity"),
    )


def q_semantic_leg(spark, root):
    chunks = S.without_toc(tables.chunk_vectors(spark, root))
    found = vector_leg(tables.query_table(spark, root), chunks, 3 * S.LIMIT, S.THRESHOLD)
    return found.select("query_id", "rank", "chunk_id", _round("similarity"))


def q_toc_filter(spark, root):
    return S.without_toc(tables.chunk_texts(spark, root)).select("chunk_id", "document_id")


SCAN_ROWS = 5_000  # chunks of a task that a keyword scan is given


def _tokens(spark, root, rows: int = SCAN_ROWS):
    return FT.token_table(tables.chunk_texts(spark, root, toc=False, rows=rows))


def q_fts_search(spark, root):
    found = FT.fts_search(tables.question_table(spark, root), _tokens(spark, root), 3 * S.LIMIT)
    return found.select("query_id", "rank", "chunk_id", _round("rank_cd"))


def _web_queries(spark, root, alternatives: int = 10_000):
    """Keyword questions in web-search form made from every whole benchmark text: its first two
    words as a phrase, all further words (or so many) as alternatives, without its last word."""
    words = tables.load(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("w")
    )
    n = F.size("w")
    phrase = F.array_join(F.slice("w", 1, 2), " ")
    middle = F.array_join(F.slice("w", 3, F.least(F.greatest(n - 3, F.lit(0)), F.lit(alternatives))), " or ")
    last = F.when(n >= 3, F.concat(F.lit(" -"), F.get("w", n - 1))).otherwise("")
    return words.select("query_id", F.concat(F.lit('"'), phrase, F.lit('" '), middle, last).alias("query"))


def _web_sql(alternatives: int = 10_000) -> str:
    return f"""
web AS (SELECT query_id, '"' || array_to_string(w[1:2], ' ') || '" '
               || array_to_string(w[3:least(greatest(len(w) - 1, 2), {alternatives + 2})], ' or ')
               || CASE WHEN len(w) >= 3 THEN ' -' || w[-1] ELSE '' END AS query
        FROM (SELECT item_id AS query_id, {Q.tokens('text')} AS w FROM benchmark))
"""


FRENCH_WORDS = 4
WEB_QUERIES = _web_sql()


def q_fts_websearch(spark, root):
    found = FT.fts_search(_web_queries(spark, root), _tokens(spark, root), S.LIMIT)
    return found.select("query_id", "rank", "chunk_id", _round("rank_cd"))


def q_fts_french(spark, root):
    """Short web-search questions over French stems, stop words left out."""
    queries, tokens = FT.analysed(
        _web_queries(spark, root, FRENCH_WORDS), tables.chunk_texts(spark, root, toc=False, rows=SCAN_ROWS), french_stems)
    found = FT.fts_search(queries, tokens, S.LIMIT)
    return found.select("query_id", "rank", "chunk_id", _round("rank_cd"))


def q_french_stems(spark, root):
    """The stem of every distinct word of the texts."""
    docs = tables.spread(tables.load(spark, root, "documents"), "doc_id")
    words = explode_rows(docs, F.array_distinct(T.tokens(F.col("text"))), [], "word").distinct()
    return french_stems(words)


def q_cover_density(spark, root):
    tokens = _tokens(spark, root, tables.ROWS_PER_TASK)
    stats = FT.term_stats(FT.build_postings(tokens))
    found = FT.fts_matches(tables.question_table(spark, root), tokens, stats)
    return found.select("query_id", "chunk_id", _round("rank_cd"))


def q_postings(spark, root):
    return FT.build_postings(_tokens(spark, root, tables.ROWS_PER_TASK)).select(
        "term", "chunk_id", F.col("tf").cast("bigint").alias("tf"),
        F.array_join("positions", ",").alias("positions"),
    )


def _hybrid(spark, root, **params):
    return S.hybrid_search(
        tables.query_table(spark, root),
        tables.chunk_texts(spark, root),
        tables.document_table(spark, root),
        vectors=tables.chunk_vectors(spark, root, toc=params.get("mode") != "vector"),
        **params,
    )


def q_hybrid_search(spark, root):
    return _hybrid(spark, root).select(
        "query_id", "rank", "chunk_id", "document_id", "document_title", "document_source",
        F.md5("content").alias("content_md5"), _round("similarity"), _round("score"),
    )


def _legs(spark, root):
    queries = tables.query_table(spark, root)
    texts = S.without_toc(tables.chunk_texts(spark, root))
    vectors = S.without_toc(tables.chunk_vectors(spark, root))
    text = FT.fts_search(
        queries, FT.token_table(texts, carry=["document_id"]), 3 * S.LIMIT, carry=["document_id"]
    )
    return text, vector_leg(queries, vectors, 3 * S.LIMIT, S.THRESHOLD, ["document_id"])


def q_rrf_fusion(spark, root):
    return S.rrf_fuse(*_legs(spark, root)).select(
        "query_id", "chunk_id", F.col("text_rank").cast("bigint").alias("text_rank"),
        F.col("vector_rank").cast("bigint").alias("vector_rank"), _round("score"),
    )


def q_doc_diversity(spark, root):
    return S.limit_per_document(S.rrf_fuse(*_legs(spark, root))).select(
        "query_id", "document_id", "chunk_id", "doc_rank", _round("score")
    )


def q_vector_fallback(spark, root):
    return _hybrid(spark, root, mode="vector").select(
        "query_id", "rank", "chunk_id", "document_title", _round("similarity")
    )


def _reranked(spark, root):
    return S.rerank(_hybrid(spark, root), tables.query_table(spark, root))


def q_rerank(spark, root):
    return _reranked(spark, root).select(
        "query_id", "position", "chunk_id", "title_boosted", _round("boost"), _round("similarity")
    )


def q_result_stats(spark, root):
    return S.result_stats(_reranked(spark, root)).select(
        "query_id", "chunks_found", _round("avg_similarity"), _round("max_similarity"),
        _round("min_similarity"),
    )


def q_scope_verdict(spark, root):
    return S.scope_verdict(_reranked(spark, root), tables.query_table(spark, root))


def _with_pages(df):
    """Page numbers and document metadata made from the row itself."""
    return df.withColumns({
        "page_start": F.when(F.col("chunk_id") % 5 != 0, (F.col("chunk_id") % 40).cast("int")),
        "page_end": F.when(
            F.col("chunk_id") % 3 != 0, (F.col("chunk_id") % 40 + F.col("chunk_id") % 2).cast("int")
        ),
        "document_metadata": F.when(F.col("chunk_id") % 4 == 0, F.lit("[1]")).otherwise(
            F.when(F.col("chunk_id") % 4 == 1, F.lit("{}")).otherwise(
                F.concat(F.lit('{"url":"https://example.org/'), "document_id", F.lit('"}'))
            )
        ),
    })


def q_source_objects(spark, root):
    rows = S.source_objects(_with_pages(_reranked(spark, root)))
    return rows.select(
        "query_id", "position", "title", "path", _round("similarity"),
        F.md5("content").alias("content_md5"), "page_number", "page_range", "url", "metadata",
    )


def q_format_citations(spark, root):
    return S.format_citations(_reranked(spark, root)).select(
        "query_id", F.md5("context").alias("context_md5"), F.length("context").alias("size")
    )


def q_dedup_queries_search(spark, root):
    """Every benchmark text asked twice under two numbers; one search serves both."""
    queries = tables.query_table(spark, root)
    twice = queries.unionByName(queries.withColumn("query_id", F.col("query_id") + 1_000_000))
    found = S.search_distinct(
        twice,
        tables.chunk_texts(spark, root, toc=False),
        tables.document_table(spark, root),
        k=10,
        vectors=tables.chunk_vectors(spark, root, toc=False),
    )
    return found.select("query_id", "rank", "chunk_id", _round("similarity"))


def q_normalize_text(spark, root):
    return tables.load(spark, root, "documents").select(
        "doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normalized_md5")
    )


def _part_question():
    number = F.substring("p_brand", 7, 10)
    return (
        F.concat(F.lit("C'est quoi un chantier de Catégorie "), number, F.lit(" de type"),
                 "p_size", F.lit(", "), "p_name", F.lit(" ?")),
        F.concat(F.lit("Chantier de type "), "p_size", F.lit(" - catégorie "), number,
                 F.lit(" - "), F.lower("p_type"), F.lit(" "), "p_name"),
    )


PART_QUESTION = """
asked AS (SELECT p_partkey, 'C''est quoi un chantier de Catégorie ' || substr(p_brand, 7, 10)
            || ' de type' || p_size || ', ' || p_name || ' ?' AS query,
            'Chantier de type ' || p_size || ' - catégorie ' || substr(p_brand, 7, 10) || ' - '
            || lower(p_type) || ' ' || p_name AS title FROM part)
"""


def q_extract_keywords(spark, root):
    question, _ = _part_question()
    parts = tables.load(spark, root, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("item"),
        T.normalize_text(question).alias("t"),
    )
    texts = tables.load(spark, root, "benchmark").select(
        F.concat(F.lit("text "), F.col("item_id").cast("string")).alias("item"),
        T.normalize_text(F.col("text")).alias("t"),
    )
    words = T.extract_keywords(F.col("t"), normalized=True)
    return parts.unionByName(texts).select("item", F.array_join(words, "|").alias("keywords"))


def q_title_boost(spark, root):
    question, title = _part_question()
    rows = tables.load(spark, root, "part").select(
        "p_partkey", title.alias("title"), T.normalize_text(question).alias("t")
    ).withColumn("kw", T.extract_keywords(F.col("t"), normalized=True))
    return rows.select(
        "p_partkey", F.round(T.title_boost(F.col("title"), F.col("kw")), 9).alias("boost")
    )


def q_query_expand(spark, root):
    """Extra terms: the name words of parts, each with the types and brands it is sold as."""
    parts = tables.load(spark, root, "part")
    synonyms = (
        parts.select(F.explode(T.tokens(F.col("p_name"))).alias("term"), "p_type")
        .groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("extra"))
    )
    queries = parts.select(F.col("p_partkey").alias("query_id"), F.concat(
        F.lit("Where is the "), "p_name", F.lit("?")).alias("query"))
    both = queries.unionByName(
        tables.load(spark, root, "benchmark").select(
            (-F.col("item_id") - 1).alias("query_id"), F.col("text").alias("query")
        )
    )
    return S.expand_queries(both, synonyms).select("query_id", "expanded")


def q_query_fingerprint(spark, root):
    """How often each turn's text was written, by its fingerprint."""
    asked = tables.load(spark, root, "conversations")
    return asked.groupBy(T.fingerprint(F.col("text")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("asked"), F.min(F.struct("conv_id", "turn"))["conv_id"].alias("first_conv")
    )


def q_vector_literal(spark, root):
    """Vectors written as text and read back."""
    rows = tables.load(spark, root, "embeddings").withColumn(
        "literal", V.encode_vector(F.col("embedding"))
    )
    back = V.decode_vector(F.col("literal"))
    return rows.select(
        "vec_id", F.size(back).cast("bigint").alias("dim"),
        (back == F.col("embedding")).alias("same"),
        F.round(V.norm(back), 6).alias("norm"),
    )


_VECTOR = f"{Q.CORPUS}, {Q.nearest('vector_leg', 10, 0.0, False)}"
_HYBRID = f"{Q.CORPUS}, {Q.fusion()}"
_FINAL = f"{_HYBRID}, {Q.RERANKED}"
_ALL_CHUNKS = f"{Q.CORPUS}, {Q.keyword_ctes('asked', 'chunks')}"

QUERIES = {
    "vector_search": q_vector_search,
    "semantic_leg": q_semantic_leg,
    "toc_filter": q_toc_filter,
    "fts_search": q_fts_search,
    "fts_websearch": q_fts_websearch,
    "fts_french": q_fts_french,
    "french_stems": q_french_stems,
    "cover_density": q_cover_density,
    "postings": q_postings,
    "hybrid_search": q_hybrid_search,
    "rrf_fusion": q_rrf_fusion,
    "doc_diversity": q_doc_diversity,
    "vector_fallback": q_vector_fallback,
    "rerank": q_rerank,
    "result_stats": q_result_stats,
    "scope_verdict": q_scope_verdict,
    "source_objects": q_source_objects,
    "format_citations": q_format_citations,
    "dedup_queries_search": q_dedup_queries_search,
    "normalize_text": q_normalize_text,
    "extract_keywords": q_extract_keywords,
    "title_boost": q_title_boost,
    "query_expand": q_query_expand,
    "query_fingerprint": q_query_fingerprint,
    "vector_literal": q_vector_literal,
}

_PAGED = """
paged AS (SELECT *, CASE WHEN chunk_id % 5 <> 0 THEN (chunk_id % 40)::INT END AS page_number,
            CASE WHEN chunk_id % 3 <> 0 THEN (chunk_id % 40 + chunk_id % 2)::INT END AS page_end,
            CASE WHEN chunk_id % 4 >= 2 THEN 'https://example.org/' || document_id END AS url
          FROM final)
"""

# texts and questions with every word replaced by its stem, and stop words by a mark
_STEMMED = rf"""
all_words AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS word
              FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)),
stems AS MATERIALIZED (SELECT word, CASE WHEN stem = '' THEN '0stop0' ELSE stem END AS stem FROM {stems_sql('all_words')}),
chunk_stems AS (
  SELECT d.doc_id AS chunk_id, coalesce(string_agg(s.stem, ' ' ORDER BY p.pos), '') AS content
  FROM documents d LEFT JOIN (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos
    FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)) p USING (doc_id)
  LEFT JOIN stems s USING (word) GROUP BY d.doc_id),
web_pieces AS (
  SELECT query_id, unnest(ps) AS piece, unnest(range(len(ps))) AS no
  FROM (SELECT query_id, regexp_extract_all(query, '-?"[^"]*"|[^\s"]+') AS ps FROM web)),
web_words AS (
  SELECT query_id, no, piece, unnest(t) AS word, unnest(range(len(t))) AS pos
  FROM (SELECT *, {Q.tokens('piece')} AS t FROM web_pieces) WHERE lower(piece) <> 'or'),
web_said AS (
  SELECT query_id, no, CASE WHEN starts_with(piece, '-') THEN '-' ELSE '' END || '"' ||
         string_agg(stem, ' ' ORDER BY pos) || '"' AS said
  FROM web_words JOIN stems USING (word) GROUP BY query_id, no, piece
  UNION ALL SELECT query_id, no, 'or' FROM web_pieces WHERE lower(piece) = 'or'),
web_stems AS (SELECT query_id, string_agg(said, ' ' ORDER BY no) AS query FROM web_said GROUP BY query_id)
"""
ORACLES = {
    "vector_search": f"""WITH {_VECTOR}
SELECT v.query_id, v.rank::INT AS rank, v.chunk_id, v.document_id, d.title AS document_title,
       d.source AS document_source, md5(c.content) AS content_md5, round(v.similarity, 9) AS similarity
FROM vector_leg v JOIN chunks c USING (chunk_id) JOIN docs d ON d.document_id = v.document_id""",
    "semantic_leg": f"""WITH {Q.CORPUS}, {Q.nearest('vector_leg', 90, 0.3, True)}
SELECT query_id, rank::INT AS rank, chunk_id, round(similarity, 9) AS similarity FROM vector_leg""",
    "toc_filter": f"WITH {Q.CORPUS} SELECT chunk_id, document_id FROM chunks WHERE NOT is_toc",
    "fts_search": f"""WITH {_ALL_CHUNKS}, {Q.keyword_leg(90)}
SELECT query_id, rank::INT AS rank, chunk_id, round(rank_cd, 9) AS rank_cd FROM text_leg""",
    "fts_websearch": f"""WITH {Q.CORPUS}, {WEB_QUERIES}, {Q.keyword_ctes('web', 'chunks')},
{Q.keyword_leg(30)}
SELECT query_id, rank::INT AS rank, chunk_id, round(rank_cd, 9) AS rank_cd FROM text_leg""",
    "fts_french": f"""WITH {_web_sql(FRENCH_WORDS)}, {_STEMMED},
{Q.keyword_ctes('web_stems', 'chunk_stems', lambda col: f"list_transform({Q.tokens(col)}, lambda w: replace(w, '0stop0', ''))")},
{Q.keyword_leg(30)}
SELECT query_id, rank::INT AS rank, chunk_id, round(rank_cd, 9) AS rank_cd FROM text_leg""",
    "french_stems": f"""
WITH words AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS word FROM documents)
SELECT word, stem FROM {stems_sql('words')}""",
    "cover_density": f"""WITH {_ALL_CHUNKS}
SELECT query_id, chunk_id, round(rank_cd, 9) AS rank_cd FROM scored""",
    "postings": f"""
SELECT term, chunk_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions
FROM (SELECT doc_id AS chunk_id, unnest(t) AS term, unnest(range(len(t))) AS pos
      FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)) GROUP BY ALL""",
    "hybrid_search": f"""WITH {_HYBRID}
SELECT query_id, rank::INT AS rank, chunk_id, document_id, document_title, document_source,
       md5(content) AS content_md5, round(similarity, 9) AS similarity, round(score, 9) AS score
FROM hybrid""",
    "rrf_fusion": f"""WITH {_HYBRID}
SELECT query_id, chunk_id, text_rank, vector_rank, round(score, 9) AS score FROM fused""",
    "doc_diversity": f"""WITH {_HYBRID}
SELECT query_id, document_id, chunk_id, doc_rank::INT AS doc_rank, round(score, 9) AS score
FROM capped""",
    "vector_fallback": f"""WITH {Q.CORPUS}, {Q.nearest('vector_leg', 30, 0.3, False)}
SELECT v.query_id, v.rank::INT AS rank, v.chunk_id, d.title AS document_title,
       round(v.similarity, 9) AS similarity
FROM vector_leg v JOIN docs d USING (document_id)""",
    "rerank": f"""WITH {_FINAL}
SELECT query_id, position::INT AS position, chunk_id, boost > 0 AS title_boosted,
       round(boost, 9) AS boost, round(similarity, 9) AS similarity FROM final""",
    "result_stats": f"""WITH {_FINAL}
SELECT query_id, count(*) AS chunks_found, round(avg(similarity), 9) AS avg_similarity,
       round(max(similarity), 9) AS max_similarity, round(min(similarity), 9) AS min_similarity
FROM final GROUP BY query_id""",
    "scope_verdict": f"""WITH {_FINAL},
best AS (SELECT query_id, count(*) AS n, max(similarity) AS m FROM final GROUP BY query_id)
SELECT a.query_id, coalesce(b.n, 0) AS found,
       CASE WHEN b.n IS NULL THEN 'no_result' WHEN coalesce(b.m, 0) < 0.45 THEN 'out_of_scope'
            ELSE 'answered' END AS verdict,
       trunc(coalesce(b.m, 0) * 100)::INT AS best_percent
FROM asked a LEFT JOIN best b USING (query_id)""",
    "source_objects": f"""WITH {_FINAL}, {_PAGED}
SELECT query_id, position::INT AS position, document_title AS title, document_source AS path,
       round(similarity, 9) AS similarity, md5(content) AS content_md5, page_number,
       CASE WHEN page_number IS NULL THEN NULL
            WHEN page_end <> page_number THEN 'p. ' || page_number || '-' || page_end
            ELSE 'p. ' || page_number END AS page_range,
       url, '{{"url":"' || url || '"}}' AS metadata
FROM paged""",
    "format_citations": f"""WITH {_FINAL},
lines AS (SELECT query_id, position, '[' || position || '] Source: "' || document_title
            || '" (Pertinence: ' || coalesce(trunc(similarity * 100)::INT, 0) || '%'
            || CASE WHEN coalesce(similarity, 0) < 0.6 THEN ' - FAIBLE' ELSE '' END || ')'
            || chr(10) || content || chr(10) AS line FROM final),
texts AS (SELECT query_id, 'Trouvé ' || count(*) || ' résultats pertinents (triés par pertinence):'
            || chr(10) || chr(10) || string_agg(line, chr(10) || '---' || chr(10) ORDER BY position)
            AS context FROM lines GROUP BY query_id)
SELECT query_id, md5(context) AS context_md5, length(context)::INT AS size FROM texts""",
    "dedup_queries_search": f"""WITH {_VECTOR}
SELECT query_id, rank::INT AS rank, chunk_id, round(similarity, 9) AS similarity FROM vector_leg
UNION ALL SELECT query_id + 1000000, rank::INT, chunk_id, round(similarity, 9) FROM vector_leg""",
    "normalize_text":
        f"SELECT doc_id, md5({Q.normalized('text')}) AS normalized_md5 FROM documents",
    "extract_keywords": f"""WITH {PART_QUESTION},
all_texts AS (SELECT 'part ' || p_partkey AS item, {Q.normalized('query')} AS t FROM asked
              UNION ALL SELECT 'text ' || item_id, {Q.normalized('text')} FROM benchmark)
SELECT item, array_to_string({Q.keywords('t')}, '|') AS keywords FROM all_texts""",
    "title_boost": f"""WITH {PART_QUESTION},
words AS (SELECT p_partkey, title, {Q.keywords('t')} AS kw
          FROM (SELECT *, {Q.normalized('query')} AS t FROM asked))
SELECT p_partkey, round({Q.title_boost('title', 'kw')}, 9) AS boost FROM words""",
    "query_expand": f"""WITH
synonyms AS (SELECT term, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS extra FROM
             (SELECT unnest({Q.tokens('p_name')}) AS term, p_type FROM part) GROUP BY term),
questions AS (SELECT p_partkey AS query_id, 'Where is the ' || p_name || '?' AS query FROM part
              UNION ALL SELECT -item_id - 1, text FROM benchmark),
hits AS (SELECT q.query_id, string_agg(s.extra, ' ' ORDER BY s.term) AS extra FROM
         (SELECT DISTINCT query_id, unnest({Q.tokens(Q.normalized('query'))}) AS term FROM questions) q
         JOIN synonyms s USING (term) GROUP BY q.query_id)
SELECT q.query_id, q.query || coalesce(' ' || h.extra, '') AS expanded
FROM questions q LEFT JOIN hits h USING (query_id)""",
    "query_fingerprint": """
SELECT substr(sha256(to_json({'f0': text})::VARCHAR), 1, 16) AS fingerprint, count(*) AS asked,
       arg_min(conv_id, conv_id * 1000000 + turn) AS first_conv
FROM conversations GROUP BY 1""",
    "vector_literal": """
SELECT vec_id, len(embedding) AS dim, ('[' || array_to_string(embedding, ',') || ']')::FLOAT[] = embedding AS same,
       round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm
FROM embeddings""",
}
