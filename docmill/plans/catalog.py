"""Catalog and crawl queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill import tables
from docmill.functions import text as T
from docmill.operators import catalog as K
from docmill.operators import chunking as C
from docmill.operators import crawl as W
from docmill.plans import sql as Q
from docmill.plans.ingest import sliding
from docmill.sources import files as SF


def _documents(spark, root):
    docs = tables.load(spark, root, "documents")
    created = F.timestamp_seconds(F.lit(1704067200) + (F.col("n_chars") * 3600))
    return docs.select(
        F.col("doc_id").alias("document_id"), "source", created.alias("created_at"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
        F.md5("text").alias("content_md5"))


def _chunks(spark, root):
    docs = tables.spread(tables.load(spark, root, "documents"), "doc_id")
    return C.chunk_sliding(docs.select(F.col("doc_id").alias("document_id"), "text"))


def _labelled(spark, root):
    return tables.load(spark, root, "labels").select((F.col("doc_id") * 2).alias("document_id"))


def q_get_document(spark, root):
    return K.get_documents(_documents(spark, root), _labelled(spark, root)).select(
        "document_id", "source", "content_md5")


def q_get_by_source(spark, root):
    """Page addresses and document sources as sources; the latter name many documents."""
    docs = tables.load(spark, root, "pages").select(
        F.col("page_id").alias("document_id"), F.col("url").alias("source"))
    docs = docs.unionByName(_documents(spark, root).select("document_id", "source"))
    return K.get_by_source(docs, docs.select("source")).select("source", "document_id")


def q_list_documents(spark, root):
    page = K.list_documents(
        _documents(spark, root), _chunks(spark, root), limit=100, offset=20,
        metadata_filter={"lang": "fr"})
    return page.select(
        "document_id", "source", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "chunk_count")


def _nested(spark, root):
    """Documents with JSON metadata: objects in objects, an array of strings and objects, numbers."""
    docs = tables.load(spark, root, "documents")
    third = (F.col("doc_id") % 3).cast("string")
    text = F.concat(
        F.lit('{"lang": "'), "lang", F.lit('", "stats": {"chars": '), F.col("n_chars").cast("string"),
        F.lit(', "long": '), F.when(F.col("n_chars") > 900, "true").otherwise("false"), F.lit(', "rate": '), third,
        F.lit('.0, "none": null}, "tags": ["'), "source", F.lit('", {"k": '), third, F.lit(', "deep": [1, '), third, F.lit("]}]}"))
    created = F.timestamp_seconds(F.lit(1704067200) + (F.col("n_chars") * 3600))
    return docs.select(F.col("doc_id").alias("document_id"), "source", created.alias("created_at"), text.alias("metadata"))


NESTED_FILTER = {"lang": "en", "stats": {"long": True, "rate": 1, "none": None}, "tags": [{"k": 1.0, "deep": [1]}]}


def q_list_documents_nested(spark, root):
    """All documents that a nested filter finds, with their chunk counts."""
    page = K.list_documents(
        _nested(spark, root), _chunks(spark, root), limit=2**31 - 1, metadata_filter=NESTED_FILTER)
    return page.select("document_id", "source", "chunk_count")


def q_metadata_containment(spark, root):
    """What every document's metadata holds."""
    value = F.col("value")
    wanted = {
        "text_for_number": {"stats": {"rate": "1"}}, "deep": {"tags": [{"deep": [2]}]}, "empty": {"stats": {}, "tags": []},
        "missing": {"stats": {"none": {"x": 1}}}, "array": {"tags": ["src1"]}, "scalar": {"tags": "src1"}, "false": {"stats": {"long": False}},
    }
    rows = _nested(spark, root).withColumn("value", F.parse_json("metadata"))
    return rows.select("document_id", *(K.contains_json(value, w).alias(f"has_{n}") for n, w in wanted.items()))


def q_sql_match_chunks(spark, root):
    """An ad-hoc statement that joins the search function with questions and labels."""
    vectors = tables.chunk_vectors(spark, root, toc=False).drop("document_id")
    chunks = tables.chunk_texts(spark, root, toc=False).join(vectors, "chunk_id")
    K.create_search_function(spark, chunks, tables.document_table(spark, root))
    return K.run_sql(spark, """
        SELECT q.query_id, m.chunk_id, m.document_title, m.document_source, round(m.similarity, 9) AS similarity, l.quality
        FROM {questions} q, LATERAL match_chunks(q.embedding, :k, :least) m
        LEFT JOIN {labels} l ON l.doc_id = m.chunk_id""", {"k": 5, "least": 0.2},
        questions=tables.query_table(spark, root).where("embedding is not null"), labels=tables.load(spark, root, "labels"))


def q_table_counts(spark, root):
    return K.table_counts(_documents(spark, root), _chunks(spark, root))


def q_adhoc_sql(spark, root):
    return K.run_sql(
        spark,
        "SELECT source, count(*) AS documents, sum(n_chars) AS characters FROM {docs} "
        "WHERE n_chars >= :least AND lang <> :lang GROUP BY source",
        {"least": 300, "lang": "de"},
        docs=tables.load(spark, root, "documents"))


def _pages(spark, root):
    return tables.spread(tables.load(spark, root, "pages"), "page_id")


def q_extract_links(spark, root):
    return W.extract_links(_pages(spark, root), ["page_id"]).select(
        "page_id", F.col("position").cast("bigint").alias("position"), "link")


def _sites(spark, root):
    """One crawl source per scheme and host, with patterns."""
    base = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    hosts = tables.load(spark, root, "pages").select(base.alias("base_url")).distinct()
    return hosts.select(
        F.col("base_url").alias("name"), "base_url",
        F.when(F.contains("base_url", F.lit("blog")), F.array(F.lit("/[a-z]+$"), F.lit("/[A-Z]")))
        .otherwise(F.array().cast("array<string>")).alias("url_patterns"),
        F.array(F.lit("/the"), F.lit(r"[.,]$")).alias("exclude_patterns"))


def _allowed(spark, root):
    links = W.extract_links(_pages(spark, root))
    sites = _sites(spark, root)
    # a host can be served under two schemes: a link belongs to the source of its own
    kept = W.follow_filter(links, sites)
    return kept.where(F.col("link").startswith(F.concat("name", F.lit("/"))))


def q_follow_filter(spark, root):
    pages = tables.load(spark, root, "pages").select("url")
    links = W.follow_filter(W.extract_links(_pages(spark, root)), _sites(spark, root), pages)
    return links.select("name", "url", F.col("position").cast("bigint").alias("position"), "link")


def _frontier(spark, root):
    pages = tables.load(spark, root, "pages")
    base = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    starts = pages.select(base.alias("name"), "url", F.col("page_id").alias("position"))
    links = _allowed(spark, root).select("name", "url", F.col("position").cast("bigint").alias("position"), "link")
    starts = starts.withColumn("position", F.col("position").cast("bigint"))
    return W.crawl_frontier(starts, links, pages, max_depth=2)


def q_crawl_frontier(spark, root):
    return _frontier(spark, root).select("name", "url", "depth", "visit")


def _results(spark, root):
    """Crawled addresses: a given page is a success, a capital address a failure."""
    pages = tables.load(spark, root, "pages").groupBy("url").agg(
        F.min(T.html_title(F.col("html"))).alias("title"), F.lit(True).alias("known"))
    rows = _frontier(spark, root).join(pages, "url", "left")
    return rows.select(
        "name", "url", "visit", "title", F.coalesce("known", F.lit(False)).alias("success"),
        F.when(F.col("known").isNull() & F.col("url").rlike("/[A-Z][^/]*$"), "HTTP 404").alias("error"))


def q_crawl_summary(spark, root):
    return W.crawl_summary(_results(spark, root)).select(
        "name", "total_urls", "successful", "failed", "skipped",
        F.round("success_rate", 9).alias("success_rate"))


def q_crawl_report(spark, root):
    return W.crawl_report(_results(spark, root), F.lit("2024-01-01").cast("timestamp")).select(
        "name", "section", "line_no", "line")


def _scraped(spark, root):
    """Pages as scraped files of a folder per host; some start with their address."""
    host = T.url_authority(F.col("url"))
    return _pages(spark, root).select(
        host.alias("folder"),
        F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"),
        F.when(F.startswith("url", F.lit("https")), F.concat(F.lit("---\nsource: ["), "url", F.lit("]\n---\n"), T.html_to_text(F.col("html"))))
        .otherwise(T.html_to_text(F.col("html"))).alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("modified"))


def q_site_inventory(spark, root):
    return W.site_inventory(_scraped(spark, root)).select(
        "folder", "url", "title", "pages_count",
        F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


def q_inventory_totals(spark, root):
    from docmill.plans.ingest import _paths

    files = _paths(spark, root).withColumn("type", SF.file_type(F.col("path"), SF.RAW_TYPES))
    return W.inventory_totals(files, W.site_inventory(_scraped(spark, root)))


def q_file_types(spark, root):
    from docmill.plans.ingest import _paths

    rows = _paths(spark, root)
    return rows.select(
        "doc_id", SF.file_type(F.col("path"), SF.RAW_TYPES).alias("raw_type"),
        SF.file_type(F.col("path"), SF.PROCESSED_TYPES).alias("processed_type"))


QUERIES = {
    "get_document": q_get_document,
    "get_by_source": q_get_by_source,
    "list_documents": q_list_documents,
    "list_documents_nested": q_list_documents_nested,
    "metadata_containment": q_metadata_containment,
    "sql_match_chunks": q_sql_match_chunks,
    "table_counts": q_table_counts,
    "adhoc_sql": q_adhoc_sql,
    "file_types": q_file_types,
    "extract_links": q_extract_links,
    "follow_filter": q_follow_filter,
    "crawl_frontier": q_crawl_frontier,
    "crawl_summary": q_crawl_summary,
    "crawl_report": q_crawl_report,
    "site_inventory": q_site_inventory,
    "inventory_totals": q_inventory_totals,
}

# links in the given pages are all of the form "/path"
# of the references only "&amp;" occurs in them
_LINKS = r"""
bases AS (SELECT page_id, url, html, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base FROM pages),
links AS (SELECT page_id, url, base, unnest(range(len(hs))) AS position, base || replace(unnest(hs), '&amp;', '&') AS link
          FROM (SELECT *, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS hs FROM bases)),
allowed AS (SELECT *, base AS name FROM links
            WHERE NOT regexp_matches(link, '/the') AND NOT regexp_matches(link, '[.,]$')
              AND (NOT contains(base, 'blog') OR regexp_matches(link, '/[a-z]+$') OR regexp_matches(link, '/[A-Z]')))
"""
_FRONTIER = _LINKS + r""",
d0 AS (SELECT name, url, row_number() OVER (PARTITION BY name ORDER BY p, url) AS visit FROM (
         SELECT base AS name, url, min(page_id) AS p FROM bases GROUP BY ALL) QUALIFY visit <= 100),
f1 AS (SELECT a.name, a.link AS url, min(d.visit * 100000 + a.position) AS p
       FROM d0 d JOIN allowed a ON a.name = d.name AND a.url = d.url
       WHERE (a.name, a.link) NOT IN (SELECT (name, url) FROM d0) GROUP BY ALL),
d1 AS (SELECT name, url, row_number() OVER (PARTITION BY name ORDER BY p, url)
         + (SELECT count(*) FROM d0 WHERE d0.name = f1.name) AS visit FROM f1 QUALIFY visit <= 100),
f2 AS (SELECT a.name, a.link AS url, min(d.visit * 100000 + a.position) AS p
       FROM d1 d JOIN allowed a ON a.name = d.name AND a.url = d.url
       WHERE (a.name, a.link) NOT IN (SELECT (name, url) FROM d0 UNION ALL SELECT (name, url) FROM d1) GROUP BY ALL),
d2 AS (SELECT name, url, row_number() OVER (PARTITION BY name ORDER BY p, url)
         + (SELECT count(*) FROM d0 WHERE d0.name = f2.name)
         + (SELECT count(*) FROM d1 WHERE d1.name = f2.name) AS visit FROM f2 QUALIFY visit <= 100),
frontier AS (SELECT name, url, 0 AS depth, visit FROM d0 UNION ALL SELECT name, url, 1, visit FROM d1
             UNION ALL SELECT name, url, 2, visit FROM d2),
results AS (SELECT f.name, f.url, f.visit, p.title, p.url IS NOT NULL AS success,
              CASE WHEN p.url IS NULL AND regexp_matches(f.url, '/[A-Z][^/]*$') THEN 'HTTP 404' END AS error
            FROM frontier f LEFT JOIN (SELECT url, min(nullif(trim(regexp_extract(html,
              '(?is)<title[^>]*>(.*?)</title>', 1)), '')) AS title FROM pages GROUP BY url) p USING (url)),
totals AS (SELECT name, count(*) AS total_urls, count(*) FILTER (success) AS successful,
             count(*) FILTER (NOT success AND error IS NOT NULL) AS failed,
             count(*) FILTER (NOT success AND error IS NULL) AS skipped FROM results GROUP BY name)
"""
_CREATED = "TIMESTAMP '2024-01-01' + INTERVAL (n_chars) HOUR"
_SITES = rf"""
scraped AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS folder,
    {Q.html_to_text('html')} AS md FROM pages),
lead AS (SELECT *, split_part(regexp_extract(array_to_string(string_split(substr(CASE WHEN url LIKE 'https%'
      THEN '---' || chr(10) || 'source: [' || url || ']' || chr(10) || '---' || chr(10) || md ELSE md END, 1, 500),
      chr(10))[1:10], chr(10)), '(http[^{Q.WS}]*)', 1), ' ', 1) AS raw FROM scraped),
sites AS (SELECT folder, coalesce(arg_min(nullif(trim(raw, '[]()"'','), ''), page_id) FILTER (page_id = first),
      'https://' || folder) AS url, count(*) AS pages_count, max(page_id) AS last
  FROM (SELECT *, min(page_id) OVER (PARTITION BY folder) AS first FROM lead) GROUP BY folder)
"""

ORACLES = {
    "get_document": """SELECT doc_id AS document_id, source, md5(text) AS content_md5 FROM documents
WHERE doc_id IN (SELECT doc_id * 2 FROM labels)""",
    "get_by_source": """WITH d AS (SELECT page_id AS document_id, url AS source FROM pages
  UNION ALL SELECT doc_id, source FROM documents)
SELECT source, min(document_id) AS document_id FROM d GROUP BY source HAVING count(*) = 1""",
    "list_documents": f"""WITH RECURSIVE {sliding()}
SELECT d.doc_id AS document_id, d.source, strftime({_CREATED}, '%Y-%m-%d %H:%M:%S') AS created_at,
       count(c.doc_id) AS chunk_count
FROM documents d LEFT JOIN chunks c USING (doc_id) WHERE d.lang = 'fr'
GROUP BY d.doc_id, d.source, d.n_chars ORDER BY d.n_chars DESC, d.doc_id LIMIT 100 OFFSET 20""",
    "list_documents_nested": f"""WITH RECURSIVE {sliding()}
SELECT d.doc_id AS document_id, d.source, count(c.doc_id) AS chunk_count
FROM documents d LEFT JOIN chunks c USING (doc_id) WHERE d.lang = 'en' AND d.n_chars > 900 AND d.doc_id % 3 = 1
GROUP BY d.doc_id, d.source""",
    "metadata_containment": """
SELECT doc_id AS document_id, false AS has_text_for_number, doc_id % 3 = 2 AS has_deep, true AS has_empty,
  false AS has_missing, source = 'src1' AS has_array, false AS has_scalar, n_chars <= 900 AS has_false FROM documents""",
    "sql_match_chunks": f"""WITH {Q.CORPUS}, {Q.nearest('found', 5, 0.2, False)}
SELECT f.query_id, f.chunk_id, d.title AS document_title, d.source AS document_source, round(f.similarity, 9) AS similarity, l.quality
FROM found f JOIN docs d USING (document_id) LEFT JOIN labels l ON l.doc_id = f.chunk_id""",
    "table_counts": f"""WITH RECURSIVE {sliding()}
SELECT 'documents' AS table_name, count(*) AS rows FROM documents
UNION ALL SELECT 'chunks', count(*) FROM chunks""",
    "adhoc_sql": """SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM documents
WHERE n_chars >= 300 AND lang <> 'de' GROUP BY source""",
    "extract_links": f"WITH {_LINKS} SELECT page_id, position, link FROM links",
    "follow_filter": f"""WITH {_LINKS}
SELECT h.base AS name, a.url, a.position, a.link FROM allowed a
JOIN (SELECT DISTINCT base, regexp_extract(base, '://(.*)$', 1) AS host FROM bases) h
  ON h.host = regexp_extract(a.base, '://(.*)$', 1)
WHERE a.link NOT IN (SELECT url FROM pages)""",
    "crawl_frontier": f"""WITH {_FRONTIER}
SELECT name, url, depth::INT AS depth, visit::INT AS visit FROM frontier""",
    "crawl_summary": f"""WITH {_FRONTIER}
SELECT name, total_urls, successful, failed, skipped,
       round(100.0::DOUBLE * successful / total_urls, 9) AS success_rate FROM totals""",
    "crawl_report": f"""WITH {_FRONTIER},
rows_out AS (
  SELECT name, 0 AS section, unnest(range(7)) AS line_no, unnest(['# Crawl Summary: ' || name, '',
    '**Date**: 2024-01-01T00:00:00', '**Total URLs**: ' || total_urls, '**Successful**: ' || successful,
    '**Failed**: ' || (total_urls - successful), '']) AS line FROM totals
  UNION ALL SELECT name, 1, unnest([0, 1]), unnest(['## Successful Crawls', '']) FROM totals WHERE successful > 0
  UNION ALL SELECT name, 2, unnest([0, 1]), unnest(['## Failed Crawls', '']) FROM totals WHERE total_urls > successful
  UNION ALL SELECT name, 1, max(visit) + 2, '' FROM results WHERE success GROUP BY name
  UNION ALL SELECT name, 2, max(visit) + 2, '' FROM results WHERE NOT success GROUP BY name
  UNION ALL SELECT name, 1, visit + 1, '- [' || coalesce(title, 'Untitled') || '](' || url || ')' FROM results WHERE success
  UNION ALL SELECT name, 2, visit + 1, '- ' || url || ': ' || coalesce(error, 'None') FROM results WHERE NOT success)
SELECT name, section::INT AS section, line_no::INT AS line_no, line FROM rows_out""",
    "site_inventory": f"""WITH {_SITES}
SELECT folder, url, array_to_string(list_transform(regexp_extract_all(replace(folder, '-', ' '), '\\p{{L}}+|[^\\p{{L}}]+'),
         lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS title,
       pages_count, strftime(TIMESTAMP '2024-01-01' + INTERVAL (last) MINUTE, '%Y-%m-%d %H:%M:%S') AS scraped_at
FROM sites""",
    "inventory_totals": f"""WITH {_SITES}
SELECT (SELECT count(*) FROM documents WHERE doc_id % 15 = 1) AS pdf_documents, count(*) AS sites,
       sum(pages_count)::BIGINT AS pages FROM sites""",
    "file_types": """
WITH k AS (SELECT doc_id, doc_id % 15 AS k FROM documents)
SELECT doc_id, CASE WHEN k IN (0, 14) THEN 'markdown' WHEN k = 1 THEN 'pdf' WHEN k = 2 THEN 'text'
         WHEN k IN (4, 12) THEN 'html' ELSE 'other' END AS raw_type,
       CASE WHEN k IN (0, 14) THEN 'markdown' WHEN k IN (4, 12) THEN 'html' ELSE 'other' END AS processed_type
FROM k""",
}
