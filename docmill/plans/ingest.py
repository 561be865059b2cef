"""Reading, describing, chunking, embedding and storing the given documents and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill import tables
from docmill.functions import text as T
from docmill.functions.markup import html_to_markdown
from docmill.operators import chunking as C
from docmill.operators import documents as D
from docmill.operators import embedding as E
from docmill.plans import sql as Q
from docmill.session import checkpoint_dir
from docmill.sources import files as SF
from docmill.sources import store as ST


def _docs(spark, root) -> DataFrame:
    return tables.spread(tables.load(spark, root, "documents"), "doc_id")


def _pages(spark, root) -> DataFrame:
    return tables.spread(tables.load(spark, root, "pages"), "page_id")


# every extension in turn, some in capitals, some without one
_EXTENSIONS = [
    ".md", ".PDF", ".txt", ".Docx", ".html", ".mp3", ".wav", ".xlsx", "", ".tar.gz", ".FLAC", ".m4a",
    ".htm", ".pptx", ".markdown",
]


def _paths(spark, root):
    ext = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("doc_id") % len(_EXTENSIONS)).cast("int"))
    return tables.load(spark, root, "documents").select(
        "doc_id", F.concat(F.lit("data/raw/"), "source", F.lit("/file_"), F.col("doc_id").cast("string"), ext).alias("path")
    )


PATHS = f"""
paths AS (SELECT doc_id, 'data/raw/' || source || '/file_' || doc_id ||
            [{', '.join(f"'{e}'" for e in _EXTENSIONS)}][doc_id % {len(_EXTENSIONS)} + 1] AS path
          FROM documents)
"""


def q_format_route(spark, root):
    return _paths(spark, root).select(
        "doc_id", "path", T.extension(F.col("path")).alias("extension"),
        T.format_class(F.col("path")).alias("format"), T.file_stem(F.col("path")).alias("stem"),
    )


def q_text_decode(spark, root):
    """Documents stored as Latin-1 where they can be, read back without being told."""
    docs = _docs(spark, root)
    fits = docs.withColumn("latin", F.col("text").rlike(r"(?s)^[\x00-\xff]*$"))
    # encode only what fits: the other rows are sent through as an empty string
    stored = F.when(
        F.col("latin"), F.encode(F.when(F.col("latin"), F.col("text")).otherwise(""), "ISO-8859-1")
    ).otherwise(F.encode("text", "UTF-8"))
    return fits.select("doc_id", SF.decode_bytes(stored).alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("size"), F.md5("t").alias("text_md5")
    )


def q_html_to_text(spark, root):
    return _pages(spark, root).select(
        "page_id", T.html_to_text(F.col("html")).alias("t")
    ).select("page_id", F.length("t").cast("bigint").alias("size"), F.md5("t").alias("text_md5"))


def q_html_to_markdown(spark, root):
    return _pages(spark, root).select("page_id", html_to_markdown("html").alias("t")).select(
        "page_id", F.length("t").cast("bigint").alias("size"), F.md5("t").alias("text_md5"))


def _markdown(spark, root):
    return _pages(spark, root).withColumn("markdown", T.html_to_text(F.col("html")))


def q_page_title(spark, root):
    pages = _markdown(spark, root)
    return pages.select(
        "page_id", T.page_title(F.col("markdown")).alias("heading"),
        F.coalesce(T.html_title(F.col("html")), T.page_title(F.col("markdown"))).alias("title"),
    )


def q_transcript_segments(spark, root):
    """Every text as a recording: a time mark on each line, blank lines between."""
    docs = _docs(spark, root)
    marked = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit("[time: "), (i * 6).cast("string"), F.lit("."), (F.col("doc_id") % 10).cast("string"),
            F.lit("-"), (i * 6 + 5).cast("string"), F.lit(".96]  "), line,
        ),
    )
    made = docs.select("doc_id", F.array_join(marked, "\n\n").alias("text"))
    return SF.transcript_segments(made, keep=["doc_id"]).select(
        "doc_id", F.round("start", 2).alias("start_s"), F.round("end", 2).alias("end_s"),
        F.md5("text").alias("text_md5"),
    )


def q_golden_load(spark, root):
    """Every benchmark text as a golden question in CSV form, read back."""
    words = T.tokens(F.col("text"))
    rows = tables.load(spark, root, "benchmark").select(
        "item_id", F.replace(F.translate("text", "\n", " "), F.lit('"'), F.lit('""')).alias("t"),
        F.array_distinct(words).alias("w"),
    )
    line = F.concat(
        F.lit('"'), "t", F.lit('",data/raw/,"['),
        F.array_join(F.transform("w", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ","),
        F.lit(']",0.'), (F.col("item_id") % 20 + 60).cast("string"), F.lit(","),
        F.when(F.size("w") > 20, "semantic").otherwise("keyword"),
    )
    parsed = SF.parse_golden(rows.select("item_id", line.alias("value")), keep=["item_id"])
    return parsed.select(
        "item_id", F.md5("query").alias("query_md5"), "expected_doc_path",
        F.array_join("expected_keywords", "|").alias("keywords"), "min_similarity", "query_type",
    )


def _lookup(spark, root):
    docs = tables.load(spark, root, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    stored = docs.select(F.concat(
        F.when(F.col("lang") == "en", "raw/").when(F.col("lang") == "fr", "processed/")
        .otherwise("archive/"), "source", F.lit("/"), name).alias("path"))
    copies = docs.where("lang = 'en'").select(
        F.concat(F.lit("processed/copies/"), name).alias("path"))
    files = stored.unionByName(copies)
    asked = docs.select(
        "doc_id",
        F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit("documents/data/raw/"), "source", F.lit("/"), name))
        .when(F.col("n_chars") % 4 == 1, F.concat(F.lit("data/lost/"), name))
        .when(F.col("n_chars") % 4 == 2, F.concat(F.lit("processed/"), "source", F.lit("/"), name))
        .otherwise(F.concat(F.lit("/raw/"), name)).alias("requested"),
    )
    return asked, files


def q_doc_lookup(spark, root):
    return SF.lookup_documents(*_lookup(spark, root))


def _headed(spark, root):
    """Texts as three kinds of markdown file: with a header, with a heading, plain."""
    docs = _docs(spark, root)
    first = F.get(T.tokens(F.col("text")), F.lit(0))
    kind = F.col("n_chars") % 4
    content = (
        F.when(kind == 0, F.concat(
            F.lit("---\ntitle: 'About "), F.coalesce(first, F.lit("nothing")), F.lit("'\nlang: "), "lang",
            F.lit("\nsource: "), "source", F.lit("\nfile_path: from header\nword_count: 0\ntags:\n  - a\n  - b\n---\n"), "text"))
        .when(kind == 1, F.concat(
            F.lit("---\ntitle: ''\nnumber: "), F.col("n_chars").cast("string"), F.lit("\n---\n\n  # Heading of "),
            F.coalesce(first, F.lit("nothing")), F.lit("  \n"), "text"))
        .when(kind == 2, F.concat(F.lit("--- no header\n## sub\n# Top "), "lang", F.lit("\n"), "text"))
        .otherwise(F.col("text"))
    )
    return docs.select(
        "doc_id", content.alias("content"),
        F.concat(F.lit("/data/raw/"), "source", F.lit("/doc."), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
    )


HEADED = f"""
headed AS (SELECT doc_id, n_chars % 4 AS kind, lang, source, n_chars,
  coalesce({Q.tokens('text')}[1], 'nothing') AS first, '/data/raw/' || source || '/doc.' || doc_id || '.md' AS path,
  text FROM documents),
built AS (SELECT *, CASE kind
  WHEN 0 THEN concat_ws(chr(10), '---', 'title: ''About ' || first || '''', 'lang: ' || lang, 'source: ' || source,
    'file_path: from header', 'word_count: 0', 'tags:', '  - a', '  - b', '---', text)
  WHEN 1 THEN concat_ws(chr(10), '---', 'title: ''''', 'number: ' || n_chars, '---', '',
    '  # Heading of ' || first || '  ', text)
  WHEN 2 THEN concat_ws(chr(10), '--- no header', '## sub', '# Top ' || lang, text)
  ELSE text END AS content FROM headed)
"""


def q_extract_title(spark, root):
    rows = D.with_source(D.with_title(_headed(spark, root)), "/data/raw")
    return rows.select("doc_id", "title", "source")


def q_frontmatter(spark, root):
    rows = D.with_metadata(_headed(spark, root)).withColumn(
        "m", F.map_filter("metadata", lambda k, _: k != "ingestion_date"))
    pairs = F.array_sort(F.transform(
        F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("doc_id", F.array_join(pairs, "|").alias("metadata"))


def q_doc_stats(spark, root):
    text = F.col("text")
    return _docs(spark, root).select(
        "doc_id", F.length(text).cast("bigint").alias("file_size"),
        T.line_count(text).cast("bigint").alias("line_count"),
        T.word_count(text).cast("bigint").alias("word_count"),
    )


def _run_docs(spark, root):
    toxic = tables.load(spark, root, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("blank"))
    return _docs(spark, root).join(toxic, "doc_id", "left").withColumn(
        "text", F.when(F.col("blank"), "  \n ").otherwise(F.col("text"))).drop("blank")


def _run(spark, root):
    """An ingestion run in which texts labelled toxic arrive blank."""
    docs = _run_docs(spark, root)
    chunks = C.chunk_sliding(docs.select("doc_id", "text"))
    return D.ingest_summary(docs, chunks)


def q_ingest_summary(spark, root):
    return D.run_totals(_run(spark, root), ["source"])


def q_ingest_write(spark, root):
    """The totals of the run, counted while its chunks are written, and how many are there."""
    path = f"{checkpoint_dir(spark)}/chunks-{uuid.uuid4().hex}"
    docs = _run_docs(spark, root).select("doc_id", "text")
    totals = D.write_counted(docs, C.chunk_sliding, path, F.col("chunk_index") == 0)
    names = ["documents", "chunks", "succeeded", "errors"]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored")).select(
        "stored", *(F.lit(totals[n]).cast("bigint").alias(n) for n in names))


def q_ingest_status(spark, root):
    return _run(spark, root).select(
        "doc_id", "chunks_created", F.array_join("errors", "|").alias("errors"))


def q_convert_summary(spark, root):
    return D.conversion_summary(_markdown(spark, root)).select(
        "page_id", "status", F.col("size").cast("bigint").alias("size"), "preview")


def q_convert_totals(spark, root):
    done = D.conversion_summary(_markdown(spark, root))
    return done.agg(
        F.count_if(F.col("status") == "success").alias("converted"),
        F.count(F.lit(1)).alias("documents"), F.sum("size").alias("characters"))


def _chunks(spark, root):
    return C.chunk_sliding(_docs(spark, root).select("doc_id", "lang", "source", "text"))


def q_chunk_sliding(spark, root):
    return _chunks(spark, root).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("start_char").cast("bigint").alias("start_char"),
        F.col("end_char").cast("bigint").alias("end_char"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"),
        F.md5("content").alias("content_md5"))


def q_token_count(spark, root):
    return _chunks(spark, root).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("token_count").cast("bigint").alias("token_count"))


def q_chunk_stats(spark, root):
    return C.chunk_stats(_chunks(spark, root), by=["lang"]).select(
        "lang", "chunks", "total_tokens", "avg_tokens",
        F.col("min_tokens").cast("bigint").alias("min_tokens"),
        F.col("max_tokens").cast("bigint").alias("max_tokens"),
        *[f"tokens_{lo}_{hi}" for lo, hi in C.TOKEN_BUCKETS])


def q_chunk_offsets(spark, root):
    rows = C.chunk_offsets(_chunks(spark, root), "chunk_index")
    return rows.select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunks_in_doc",
        "offset_start", "offset_end")


def q_chunk_structured(spark, root):
    pages = _markdown(spark, root).select("page_id", F.col("markdown").alias("text"))
    return C.chunk_structured(pages, id_col="page_id").select(
        "page_id", "chunk_index", "total_chunks", "heading_path", "token_count",
        F.md5("content").alias("content_md5"))


def q_chunk_tokens(spark, root):
    """Markdown pages packed by counted words."""
    pages = _markdown(spark, root).select("page_id", F.col("markdown").alias("text"))
    return C.chunk_tokens(pages, C.word_counter, max_tokens=40).select(
        "page_id", "chunk_index", "total_chunks", "heading_path", "body_tokens", F.md5("content").alias("content_md5"))


def q_export_chunks(spark, root):
    return C.export_text(_chunks(spark, root)).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("value").alias("value_md5"))


def q_page_range(spark, root):
    """Orders as chunks and their lines as items; open lines have no page, urgent orders name
    their own."""
    items = tables.load(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("chunk"),
        F.when(F.col("l_linestatus") == "F", (F.col("l_partkey") % 90).cast("int")).alias("page_no"))
    own = tables.load(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("chunk"), (F.col("o_custkey") % 90).cast("int").alias("meta_page"))
    return C.with_page_range(items.join(own, "chunk", "left"), ["chunk"])


def _toc_texts(spark, root):
    """Every order as a text: one line per item, some shaped like contents entries."""
    line = (
        F.when(F.col("l_returnflag") == "A", F.concat(
            F.lit("Section "), F.col("l_partkey").cast("string"), F.lit(" ..... "), F.col("l_linenumber").cast("string")))
        .when(F.col("l_returnflag") == "R", F.concat(
            F.lit("item of supplier "), F.col("l_suppkey").cast("string"), F.lit(" and more")))
        .otherwise(F.concat(F.lit("Number "), F.col("l_partkey").cast("string")))
    )
    rows = tables.load(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line")))
    return rows.groupBy("l_orderkey").agg(
        F.array_join(F.transform(order, lambda x: x["line"]), "\n").alias("content"))


def q_toc_flag(spark, root):
    return _toc_texts(spark, root).select("l_orderkey", T.is_toc(F.col("content")).alias("is_toc"))


def q_embed_truncate(spark, root):
    return _docs(spark, root).select("doc_id", E.embedding_text(F.col("text")).alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("size"), F.md5("t").alias("text_md5"))


class _Picky(E.HashedWords):
    """A model that refuses texts with a quotation mark or an exclamation mark."""

    name = "picky"

    def __call__(self, texts):
        if any("!" in text or '"' in text for text in texts):
            raise ValueError("refused")
        return super().__call__(texts)


def q_embed_errors(spark, root):
    """Whole texts sent to a model that fails on some: those alone get an error and a zero vector."""
    rows = E.embed(_docs(spark, root).select("doc_id", "text"), "text", _Picky(), delay=0.0)
    return rows.select(
        "doc_id", F.col("embedding_error").alias("error"),
        F.forall("embedding", lambda x: x == 0).alias("is_zero"))


def q_embed_chunks(spark, root):
    # dealt without a key, so that texts with one id, or without it, are no one task
    docs = tables.spread(tables.load(spark, root, "documents").select("doc_id", "text"))
    rows = E.embed(C.chunk_sliding(docs).select("doc_id", "chunk_index", "content"))
    x = F.col("embedding")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    place = F.aggregate(
        F.transform(x, lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.size(x).cast("bigint").alias("dim"),
        F.size(F.filter(x, lambda v: v > 0)).cast("bigint").alias("filled"),
        F.round(total, 4).alias("total"), F.round(place, 3).alias("weighted"),
        F.round(F.array_max(x).cast("double"), 5).alias("largest"),
        "embedding_model")


def q_url_to_filename(spark, root):
    return tables.load(spark, root, "pages").select(
        "page_id", T.url_to_filename(F.col("url")).alias("filename"))


def q_render_markdown(spark, root):
    pages = _markdown(spark, root)
    fields = {
        "url": F.col("url"),
        "source": T.url_authority(F.col("url")),
        "category": F.lit("general"),
        "language": F.lit("fr"),
        "crawled_at": F.lit("2024-01-01T00:00:00"),
        "title": T.html_title(F.col("html")),
        "depth": F.lit(None).cast("string"),
    }
    done = ST.render_markdown(pages, fields, F.col("markdown"))
    return done.select("page_id", F.md5("document").alias("document_md5"),
                       F.length("document").cast("bigint").alias("size"))


def _stored(spark, root):
    docs = tables.load(spark, root, "documents").select(
        F.col("doc_id").alias("document_id"), "source")
    chunks = _chunks(spark, root).select(
        F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"))
    doomed = tables.load(spark, root, "labels").where("toxic = 1 or quality = 0").select(
        F.col("doc_id").alias("document_id"))
    return ST.cascade_delete(docs, chunks, doomed)


def q_cascade_delete(spark, root):
    docs, chunks = _stored(spark, root)
    kept = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.join(kept, "document_id", "left").select(
        "document_id", "source", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def q_union_counts(spark, root):
    return ST.table_counts(*_stored(spark, root))


def q_corpus_roundtrip(spark, root):
    """Texts and their chunks stored, the chunks with a vector appended once more, read back."""
    vectors = tables.load(spark, root, "embeddings").select(
        F.col("vec_id").alias("document_id"), "embedding")
    docs = tables.load(spark, root, "documents").select(F.col("doc_id").alias("document_id"), "source")
    chunks = _chunks(spark, root).select(
        F.col("doc_id").alias("document_id"), "chunk_index", "content", "token_count"
    ).join(vectors, "document_id", "left")
    path = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    ST.write_corpus(docs, chunks, path)
    ST.write_corpus(docs, chunks, path, mode="append", keep_null_embeddings=False)
    saved_docs, saved = ST.read_corpus(spark, path)
    per_doc = saved.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"),
        F.count("embedding").alias("vectors"))
    return saved_docs.groupBy("document_id").agg(F.count(F.lit(1)).alias("copies")).join(
        per_doc, "document_id", "left")


def q_store_changes(spark, root):
    """A stored corpus replaced by another one, documents deleted, others upserted: what it holds
    then, and which buckets still have the files of before the deletion."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    old, now = (F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp") for m in (1, 2))
    docs = tables.load(spark, root, "documents").select(
        F.col("doc_id").alias("document_id"), "source", F.md5("text").alias("content"),
        old.alias("created_at"), old.alias("updated_at"))
    chunks = _chunks(spark, root).select(F.col("doc_id").alias("document_id"), "chunk_index", "content")
    ST.write_bucketed(docs.withColumn("source", F.lit("old")), chunks.limit(0), path, _STORE_BUCKETS)
    ST.write_bucketed(docs, chunks, path, _STORE_BUCKETS)
    names = ["documents", "chunks"]
    before = {n: spark.createDataFrame(ST.bucket_versions(spark, path, n).collect(), "bucket int, version decimal(38,0)")
              for n in names}
    labels = tables.load(spark, root, "labels").withColumn("bucket", ST.bucket_of(F.col("doc_id"), _STORE_BUCKETS))
    doomed = labels.where("bucket % 4 = 0 and (toxic = 1 or quality = 0)").select(F.col("doc_id").alias("document_id"))
    emptied = docs.where(ST.bucket_of(F.col("document_id"), _STORE_BUCKETS) == 4).select("document_id")
    ST.delete_bucketed(spark, path, doomed.unionAll(emptied))
    moved = labels.select(
        (F.col("doc_id") + 50).alias("document_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"))
    ST.upsert_bucketed(
        spark, path, moved.where(ST.bucket_of(F.col("document_id"), _STORE_BUCKETS) % 4 == 1), now)
    found = ST.read_bucketed(spark, path, "documents").select(
        "document_id", "source", "content", "bucket",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
    kept = ST.read_bucketed(spark, path, "chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    found = found.join(kept, "document_id", "left")
    for name in names:
        same = before[name].join(ST.bucket_versions(spark, path, name), ["bucket", "version"])
        same = same.select("bucket", F.lit(True).alias(f"{name}_unchanged"))
        found = found.join(F.broadcast(same), "bucket", "left")  # a row per bucket
    flags = [F.coalesce(f"{n}_unchanged", F.lit(False)).alias(f"{n}_unchanged") for n in names]
    return found.select(
        "document_id", "source", "content", "created", "updated", F.coalesce("chunks", F.lit(0)).alias("chunks"), *flags)


_STORE_BUCKETS = 16


def q_upsert_documents(spark, root):
    """Labels as new versions of documents; shifted numbers make some of them new."""
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stored = tables.load(spark, root, "documents").select(
        F.col("doc_id").alias("document_id"), "source", F.md5("text").alias("content"),
        old.alias("created_at"), old.alias("updated_at"))
    incoming = tables.load(spark, root, "labels").select(
        (F.col("doc_id") + 50).alias("document_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return ST.upsert_documents(stored, incoming, now).select(
        "document_id", "source", "content",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


QUERIES = {
    "format_route": q_format_route,
    "text_decode": q_text_decode,
    "html_to_text": q_html_to_text,
    "html_to_markdown": q_html_to_markdown,
    "page_title": q_page_title,
    "transcript_segments": q_transcript_segments,
    "golden_load": q_golden_load,
    "doc_lookup": q_doc_lookup,
    "extract_title": q_extract_title,
    "frontmatter": q_frontmatter,
    "doc_stats": q_doc_stats,
    "ingest_summary": q_ingest_summary,
    "ingest_write": q_ingest_write,
    "ingest_status": q_ingest_status,
    "convert_summary": q_convert_summary,
    "convert_totals": q_convert_totals,
    "chunk_sliding": q_chunk_sliding,
    "chunk_structured": q_chunk_structured,
    "chunk_tokens": q_chunk_tokens,
    "export_chunks": q_export_chunks,
    "page_range": q_page_range,
    "toc_flag": q_toc_flag,
    "token_count": q_token_count,
    "chunk_offsets": q_chunk_offsets,
    "chunk_stats": q_chunk_stats,
    "embed_truncate": q_embed_truncate,
    "embed_chunks": q_embed_chunks,
    "embed_errors": q_embed_errors,
    "url_to_filename": q_url_to_filename,
    "render_markdown": q_render_markdown,
    "cascade_delete": q_cascade_delete,
    "union_counts": q_union_counts,
    "corpus_roundtrip": q_corpus_roundtrip,
    "upsert_documents": q_upsert_documents,
    "store_changes": q_store_changes,
}


def sliding(docs: str = "documents") -> str:
    """CTEs up to ``chunks``: windows walked one by one from the previous one's end."""
    return rf"""
walk AS (
  SELECT doc_id, text, length(text) AS n, 0::BIGINT AS s,
         CASE WHEN 1000 >= length(text) THEN 1000 ELSE 0 END AS e0
  FROM {docs} WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, e - 200, CASE WHEN e - 200 + 1000 >= n THEN e - 200 + 1000 ELSE 0 END
  FROM (SELECT *, CASE WHEN e0 > 0 THEN e0 ELSE
          coalesce(s + 801 + nullif(length(regexp_extract(substr(text, s + 802, 200),
                   '^(?s:.*)[.!?\n]')), 0), s + 1000) END AS e FROM walk)
  WHERE e - 200 < n),
ends AS (
  SELECT doc_id, s, CASE WHEN e0 > 0 THEN e0 ELSE
           coalesce(s + 801 + nullif(length(regexp_extract(substr(text, s + 802, 200),
                    '^(?s:.*)[.!?\n]')), 0), s + 1000) END AS e, text
  FROM walk),
cut AS (
  SELECT doc_id, s AS start_char, e AS end_char, {Q.strip('substr(text, s + 1, e - s)')} AS content
  FROM ends),
chunks AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS chunk_index,
         count(*) OVER (PARTITION BY doc_id) AS total_chunks
  FROM cut WHERE content <> '')
"""


_BLANKED = """
run_docs AS (
  SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NOT NULL THEN '  ' || chr(10) || ' ' ELSE d.text END AS text
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id))
"""
_RUN = f"""
status AS (SELECT d.doc_id, d.source, count(c.doc_id) AS chunks_created
           FROM run_docs d LEFT JOIN chunks c USING (doc_id) GROUP BY ALL)
"""
_MARKDOWN = f"md AS (SELECT page_id, url, html, {Q.html_to_text('html')} AS markdown FROM pages)"
_KEPT = """
doomed AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 OR quality = 0),
kept_docs AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doomed)),
kept_chunks AS (SELECT doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM doomed))
"""
_BUCKETS = ", ".join(
    f"count(*) FILTER (t >= {lo} AND t < {hi}) AS tokens_{lo}_{hi}" for lo, hi in C.TOKEN_BUCKETS
)

_UNDER = rf"""spaced AS (SELECT page_id, regexp_replace(markdown, '(?m)^(#{{1,6}}[\t-\r\x20]+.*)$',
             chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g') AS t FROM md),
split_up AS (SELECT page_id, string_split_regex(t, '\n[\t\x20]*\n\s*') AS bs FROM spaced),
blocks AS (SELECT page_id, no, {Q.strip('b')} AS b FROM (
             SELECT page_id, unnest(bs) AS b, unnest(range(len(bs))) AS no FROM split_up) WHERE {Q.strip('b')} <> ''),
leveled AS (SELECT *, length(regexp_extract(b, '^(#{{1,6}})[\t-\r\x20]', 1)) AS level FROM blocks),
heads AS (SELECT page_id, no, level, {Q.strip("regexp_replace(b, '^#{1,6}[\t-\r\x20]+', '')")} AS name FROM leveled WHERE level > 0),
under AS (SELECT p.page_id, p.no, any_value(p.b) AS b, coalesce(string_agg(h.name, chr(10) ORDER BY h.no), '') AS full_path
          FROM leveled p LEFT JOIN heads h ON h.page_id = p.page_id AND h.no < p.no AND NOT EXISTS (
            SELECT 1 FROM heads k WHERE k.page_id = h.page_id AND k.no > h.no AND k.no < p.no AND k.level <= h.level)
          WHERE p.level = 0 GROUP BY p.page_id, p.no)"""


def _bucket(key: str) -> str:
    return f"('0x' || substr(md5(({key})::VARCHAR), 1, 8))::BIGINT % {_STORE_BUCKETS}"


ORACLES = {
    "embed_errors": f"""
WITH t AS (SELECT doc_id, substr(text, 1, 32764) AS t FROM documents),
f AS (SELECT doc_id, t, contains(t, '!') OR contains(t, '"') AS bad FROM t)
SELECT doc_id, CASE WHEN bad THEN 'refused' END AS error,
       bad OR NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AS is_zero FROM f""",
    "format_route": rf"""WITH {PATHS},
named AS (SELECT doc_id, path, split_part(path, '/', -1) AS name FROM paths),
dotted AS (SELECT *, CASE WHEN contains(name, '.') THEN '.' || lower(split_part(name, '.', -1)) ELSE '' END AS ext
           FROM named)
SELECT doc_id, path, ext AS extension,
       CASE WHEN ext IN ('.mp3', '.wav', '.m4a', '.flac') THEN 'audio'
            WHEN ext IN ('.pdf', '.docx', '.doc', '.pptx', '.ppt', '.xlsx', '.xls', '.html', '.htm')
            THEN 'structured' ELSE 'text' END AS format,
       substr(name, 1, length(name) - length(ext)) AS stem
FROM dotted""",
    "text_decode": "SELECT doc_id, length(text) AS size, md5(text) AS text_md5 FROM documents",
    "html_to_text": f"""WITH {_MARKDOWN}
SELECT page_id, length(markdown) AS size, md5(markdown) AS text_md5 FROM md""",
    "page_title": rf"""WITH {_MARKDOWN},
t AS (SELECT page_id,
        nullif({Q.strip(r"regexp_extract(markdown, '(?m)^#[ \t\n\r]+(.+)$', 1)")}, '') AS heading,
        nullif({Q.strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS named FROM md)
SELECT page_id, heading, coalesce(named, heading) AS title FROM t""",
    "transcript_segments": f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                      unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, round(i * 6 + (doc_id % 10) / 10.0::DOUBLE, 2) AS start_s, round(i * 6 + 5.96::DOUBLE, 2) AS end_s,
       md5({Q.strip('line')}) AS text_md5 FROM lines""",
    "golden_load": f"""
WITH asked AS (SELECT item_id, replace(text, chr(10), ' ') AS t, {Q.tokens('text')} AS w FROM benchmark),
uniq AS (SELECT item_id, string_agg(x, '|' ORDER BY place) AS keywords, count(*) AS n FROM (
           SELECT item_id, x, min(place) AS place FROM (
             SELECT item_id, unnest(w) AS x, unnest(range(len(w))) AS place FROM asked) GROUP BY ALL)
         GROUP BY item_id)
SELECT item_id, md5(t) AS query_md5, 'data/raw/' AS expected_doc_path, keywords,
       (item_id % 20 + 60) / 100.0::DOUBLE AS min_similarity,
       CASE WHEN n > 20 THEN 'semantic' ELSE 'keyword' END AS query_type
FROM asked JOIN uniq USING (item_id)""",
    "doc_lookup": """
WITH named AS (SELECT *, 'doc_' || doc_id || '.md' AS name FROM documents),
files AS (SELECT CASE lang WHEN 'en' THEN 'raw/' WHEN 'fr' THEN 'processed/' ELSE 'archive/' END
                 || source || '/' || name AS path, name FROM named
          UNION ALL SELECT 'processed/copies/' || name, name FROM named WHERE lang = 'en'),
asked AS (SELECT doc_id, name, CASE n_chars % 4
            WHEN 0 THEN 'documents/data/raw/' || source || '/' || name
            WHEN 1 THEN 'data/lost/' || name
            WHEN 2 THEN 'processed/' || source || '/' || name
            ELSE '/raw/' || name END AS requested,
          CASE n_chars % 4 WHEN 0 THEN 'raw/' || source || '/' || name WHEN 1 THEN 'lost/' || name
            WHEN 2 THEN 'processed/' || source || '/' || name END AS clean FROM named),
found AS (SELECT a.doc_id, a.requested, a.clean,
            (SELECT count(*) FROM files f WHERE f.path = a.clean) > 0 AS exact,
            coalesce((SELECT min(path) FROM files f WHERE f.name = a.name AND path LIKE 'raw/%'),
                     (SELECT min(path) FROM files f WHERE f.name = a.name AND path LIKE 'processed/%')) AS near
          FROM asked a)
SELECT doc_id, requested,
       CASE WHEN clean IS NULL THEN NULL WHEN exact THEN clean ELSE near END AS path,
       CASE WHEN clean IS NULL THEN 'invalid' WHEN exact THEN 'exact' WHEN near IS NOT NULL THEN 'name'
            ELSE 'not_found' END AS match FROM found""",
    "extract_title": f"""WITH {HEADED}
SELECT doc_id, CASE kind WHEN 0 THEN 'About ' || first WHEN 1 THEN 'Heading of ' || first
         WHEN 2 THEN 'Top ' || lang ELSE 'doc.' || doc_id END AS title,
       substr(path, 11) AS source FROM built""",
    "frontmatter": rf"""WITH {HEADED},
facts AS (SELECT doc_id, unnest(CASE kind
    WHEN 0 THEN ['title=About ' || first, 'lang=' || lang, 'source=' || source, 'file_path=from header',
                 'tags=- a' || chr(10) || '  - b']
    WHEN 1 THEN ['title=', 'number=' || n_chars, 'file_path=' || path]
    ELSE ['file_path=' || path] END || ['file_size=' || length(content),
      'line_count=' || len(string_split(content, chr(10))),
      'word_count=' || len(regexp_extract_all(content, '[^{Q.WS}]+'))]) AS f FROM built)
SELECT doc_id, string_agg(f, '|' ORDER BY f) AS metadata FROM facts GROUP BY doc_id""",
    "doc_stats": f"""
SELECT doc_id, length(text) AS file_size, len(string_split(text, chr(10))) AS line_count,
       len(list_filter(string_split_regex(text, '[{Q.WS}]+'), lambda w: w <> '')) AS word_count
FROM documents""",
    "ingest_summary": f"""WITH RECURSIVE {_BLANKED}, {sliding('run_docs')}, {_RUN}
SELECT source, count(*) AS documents, sum(chunks_created)::BIGINT AS chunks,
       count(*) FILTER (chunks_created = 0) AS errors,
       count(*) FILTER (chunks_created > 0) AS succeeded FROM status GROUP BY source""",
    "ingest_write": f"""WITH RECURSIVE {_BLANKED}, {sliding('run_docs')}, {_RUN}
SELECT sum(chunks_created)::BIGINT AS stored, count(*) AS documents, sum(chunks_created)::BIGINT AS chunks,
       count(*) FILTER (chunks_created > 0) AS succeeded, count(*) FILTER (chunks_created = 0) AS errors FROM status""",
    "ingest_status": f"""WITH RECURSIVE {_BLANKED}, {sliding('run_docs')}, {_RUN}
SELECT doc_id, chunks_created, CASE WHEN chunks_created = 0 THEN 'No chunks created' ELSE '' END AS errors
FROM status""",
    "convert_summary": f"""WITH {_MARKDOWN}
SELECT page_id, CASE WHEN markdown <> '' THEN 'success' ELSE 'failed' END AS status,
       length(markdown) AS size, replace(substr(markdown, 1, 200), chr(10), ' ') AS preview FROM md""",
    "convert_totals": f"""WITH {_MARKDOWN}
SELECT count(*) FILTER (markdown <> '') AS converted, count(*) AS documents,
       sum(length(markdown))::BIGINT AS characters FROM md""",
    "chunk_sliding": f"""WITH RECURSIVE {sliding()}
SELECT doc_id, chunk_index, start_char, end_char, total_chunks, md5(content) AS content_md5 FROM chunks""",
    "chunk_structured": rf"""WITH RECURSIVE {_MARKDOWN},
{_UNDER},
paths AS (SELECT *, CASE WHEN length(full_path) > 1024 THEN {Q.strip('right(full_path, 1024)')} ELSE full_path END AS path FROM under),
roomy AS (SELECT *, 2048 - CASE WHEN path = '' THEN 0 ELSE length(path) + 1 END AS room FROM paths),
cuts AS (
  SELECT page_id, no, path, room, b AS rest, 0 AS part, NULL::VARCHAR AS piece FROM roomy
  UNION ALL
  SELECT page_id, no, path, room, {Q.strip('substr(rest, n + 1)')}, part + 1, {Q.strip('substr(rest, 1, n)')}
  FROM (SELECT *, CASE WHEN length(rest) <= room THEN length(rest)
          ELSE coalesce(nullif(length(regexp_extract(substr(rest, 1, room + 1), '^((?s:.*))\s', 1)), 0), room) END AS n
        FROM cuts WHERE rest <> '')),
pieces AS (SELECT page_id, path, room, piece, row_number() OVER (PARTITION BY page_id ORDER BY no, part) AS i
           FROM cuts WHERE part > 0),
packed AS (
  SELECT page_id, i, path, piece AS body, 0 AS c FROM pieces WHERE i = 1
  UNION ALL
  SELECT n.page_id, n.i, n.path,
         CASE WHEN n.path = p.path AND length(p.body) + 1 + length(n.piece) <= n.room
              THEN p.body || chr(10) || n.piece ELSE n.piece END,
         CASE WHEN n.path = p.path AND length(p.body) + 1 + length(n.piece) <= n.room THEN p.c ELSE p.c + 1 END
  FROM packed p JOIN pieces n ON n.page_id = p.page_id AND n.i = p.i + 1),
chunks AS (SELECT page_id, c, any_value(path) AS path, arg_max(body, i) AS body FROM packed GROUP BY page_id, c),
whole AS (SELECT *, CASE WHEN path = '' THEN body ELSE path || chr(10) || body END AS content FROM chunks)
SELECT page_id, c::INT AS chunk_index, (count(*) OVER (PARTITION BY page_id))::INT AS total_chunks, path AS heading_path,
       (length(content) // 4)::INT AS token_count, md5(content) AS content_md5 FROM whole""",
    "chunk_tokens": rf"""WITH RECURSIVE {_MARKDOWN},
{_UNDER},
sized AS (SELECT *, len(regexp_extract_all(full_path, '\S+')) AS np, regexp_extract_all(b, '\s*\S+') AS ws FROM under),
paths AS (SELECT page_id, no, CASE WHEN 2 * np <= 40 THEN full_path ELSE '' END AS path,
            40 - CASE WHEN 2 * np <= 40 THEN np ELSE 0 END AS room, ws FROM sized WHERE len(ws) > 0),
pieces AS (SELECT page_id, path, room, row_number() OVER (PARTITION BY page_id ORDER BY no, part) AS i, part,
             ws[part * room + 1:least(len(ws), part * room + room)] AS ws, len(ws) AS whole
           FROM (SELECT *, unnest(range((len(ws) + room - 1) // room)) AS part FROM paths)),
packed AS (
  SELECT page_id, i, path, {Q.strip("array_to_string(ws, '')")} AS body, len(ws) AS n, 0 AS c FROM pieces WHERE i = 1
  UNION ALL
  SELECT x.page_id, x.i, x.path,
         CASE WHEN x.part = 0 AND x.path = p.path AND p.n + x.whole <= x.room
              THEN p.body || chr(10) || array_to_string(x.ws, '') ELSE {Q.strip("array_to_string(x.ws, '')")} END,
         CASE WHEN x.part = 0 AND x.path = p.path AND p.n + x.whole <= x.room THEN p.n + len(x.ws) ELSE len(x.ws) END,
         CASE WHEN x.part = 0 AND x.path = p.path AND p.n + x.whole <= x.room THEN p.c ELSE p.c + 1 END
  FROM packed p JOIN pieces x ON x.page_id = p.page_id AND x.i = p.i + 1),
chunks AS (SELECT page_id, c, any_value(path) AS path, arg_max(body, i) AS body, max(n) AS n FROM packed GROUP BY page_id, c)
SELECT page_id, c::INT AS chunk_index, (count(*) OVER (PARTITION BY page_id))::INT AS total_chunks, path AS heading_path,
       n::INT AS body_tokens, md5(CASE WHEN path = '' THEN body ELSE path || chr(10) || body END) AS content_md5 FROM chunks""",
    "export_chunks": f"""WITH RECURSIVE {sliding()}
SELECT doc_id, chunk_index, md5(concat_ws(chr(10), repeat('=', 60), 'CHUNK ' || chunk_index,
       repeat('=', 60), content, '')) AS value_md5 FROM chunks""",
    "token_count": f"""WITH RECURSIVE {sliding()}
SELECT doc_id, chunk_index, length(content) // 4 AS token_count FROM chunks""",
    "chunk_stats": f"""WITH RECURSIVE {sliding()},
sized AS (SELECT d.lang, length(c.content) // 4 AS t FROM chunks c JOIN documents d USING (doc_id))
SELECT lang, count(*) AS chunks, sum(t)::BIGINT AS total_tokens, round(avg(t), 9) AS avg_tokens,
       min(t) AS min_tokens, max(t) AS max_tokens, {_BUCKETS} FROM sized GROUP BY lang""",
    "chunk_offsets": f"""WITH RECURSIVE {sliding()}
SELECT doc_id, chunk_index AS chunk_no, total_chunks AS chunks_in_doc,
       (sum(length(content)) OVER w - length(content))::BIGINT AS offset_start,
       (sum(length(content)) OVER w)::BIGINT AS offset_end
FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
    "page_range": """
WITH items AS (SELECT l_orderkey AS chunk, CASE WHEN l_linestatus = 'F' THEN l_partkey % 90 END AS page_no
               FROM lineitem),
own AS (SELECT o_orderkey AS chunk, o_custkey % 90 AS p FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT i.chunk, coalesce(max(o.p), min(i.page_no))::INT AS page_start,
       coalesce(max(o.p), max(i.page_no))::INT AS page_end
FROM items i LEFT JOIN own o USING (chunk) GROUP BY i.chunk""",
    "toc_flag": f"""
WITH texts AS (SELECT l_orderkey, string_agg(CASE l_returnflag
    WHEN 'A' THEN 'Section ' || l_partkey || ' ..... ' || l_linenumber
    WHEN 'R' THEN 'item of supplier ' || l_suppkey || ' and more'
    ELSE 'Number ' || l_partkey END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS content
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, {Q.is_toc('content')} AS is_toc FROM texts""",
    "embed_truncate": f"""
SELECT doc_id, length(t) AS size, md5(t) AS text_md5 FROM (
  SELECT doc_id, CASE WHEN {Q.strip('text')} = '' THEN '' ELSE substr(text, 1, 32764) END AS t
  FROM documents)""",
    "embed_chunks": f"""WITH RECURSIVE {sliding()},
words AS (SELECT doc_id, chunk_index, unnest({Q.tokens('content')}) AS w FROM chunks),
slots AS (SELECT doc_id, chunk_index, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n
          FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, chunk_index, sqrt(sum(n * n)) AS size FROM slots GROUP BY ALL),
parts AS (SELECT doc_id, chunk_index, slot, (n / size)::FLOAT::DOUBLE AS x FROM slots JOIN sizes USING (doc_id, chunk_index))
SELECT c.doc_id, c.chunk_index, 64::BIGINT AS dim, count(p.x) AS filled,
       round(coalesce(sum(p.x), 0), 4) AS total, round(coalesce(sum(p.x * p.slot), 0), 3) AS weighted,
       round(coalesce(max(p.x), 0), 5) AS largest, 'hashed-words' AS embedding_model
FROM chunks c LEFT JOIN parts p USING (doc_id, chunk_index) GROUP BY c.doc_id, c.chunk_index""",
    "url_to_filename": r"""
WITH parts AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
named AS (SELECT page_id, url, CASE WHEN len(segs) > 0
    THEN regexp_replace(segs[-1], '(?i)\.(html?|php|aspx?)$', '') ELSE replace(host, '.', '_') END AS name FROM parts)
SELECT page_id, substr(trim(regexp_replace(regexp_replace(name, '[^\p{L}\p{N}_\-]', '_', 'g'), '_+', '_', 'g'), '_'), 1, 50)
       || '_' || substr(md5(url), 1, 8) || '.md' AS filename FROM named""",
    "render_markdown": rf"""WITH {_MARKDOWN},
f AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
        nullif({Q.strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title FROM md),
q AS (SELECT *, CASE WHEN regexp_matches(title, $$: |:$| #|^[-?:] |^[\[\]{{}},#&*!|>'"%@`]$$)
               THEN '''' || replace(title, '''', '''''') || '''' ELSE title END AS quoted FROM f),
d AS (SELECT page_id, concat_ws(chr(10), '---', 'category: general', 'crawled_at: ''2024-01-01T00:00:00''',
        'language: fr', 'source: ' || host, 'title: ' || quoted, 'url: ' || url, '---', '', markdown) AS doc FROM q)
SELECT page_id, md5(doc) AS document_md5, length(doc) AS size FROM d""",
    "cascade_delete": f"""WITH RECURSIVE {sliding()}, {_KEPT}
SELECT d.doc_id AS document_id, d.source, count(c.doc_id) AS chunks
FROM kept_docs d LEFT JOIN kept_chunks c USING (doc_id) GROUP BY ALL""",
    "union_counts": f"""WITH RECURSIVE {sliding()}, {_KEPT}
SELECT 'documents' AS table_name, count(*) AS rows FROM kept_docs
UNION ALL SELECT 'chunks', count(*) FROM kept_chunks""",
    "corpus_roundtrip": f"""WITH RECURSIVE {sliding()},
c AS (SELECT c.doc_id, length(c.content) // 4 AS t, e.vec_id IS NOT NULL AS v
      FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id)
SELECT d.doc_id AS document_id, 2::BIGINT AS copies,
       nullif(count(c.doc_id) + count(*) FILTER (c.v), 0) AS chunks,
       (sum(c.t) + coalesce(sum(c.t) FILTER (c.v), 0))::BIGINT AS tokens,
       CASE WHEN count(c.doc_id) > 0 THEN 2 * count(*) FILTER (c.v) END AS vectors
FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
    "store_changes": f"""WITH RECURSIVE {sliding()},
d AS (SELECT doc_id AS document_id, source, md5(text) AS content, {_bucket('doc_id')} AS bucket FROM documents),
l AS (SELECT *, {_bucket('doc_id')} AS bucket, {_bucket('doc_id + 50')} AS next FROM labels),
doomed AS (SELECT doc_id AS document_id FROM l WHERE bucket % 4 = 0 AND (toxic = 1 OR quality = 0)
           UNION SELECT document_id FROM d WHERE bucket = 4),
incoming AS (SELECT doc_id + 50 AS document_id, 'quality ' || quality AS content, next AS bucket FROM l WHERE next % 4 = 1),
n AS (SELECT doc_id AS document_id, {_bucket('doc_id')} AS bucket, count(*) AS chunks FROM chunks GROUP BY ALL),
left_docs AS (SELECT * FROM d WHERE document_id NOT IN (SELECT document_id FROM doomed)),
docs_touched AS (SELECT bucket FROM d WHERE document_id IN (SELECT document_id FROM doomed) UNION SELECT bucket FROM incoming),
chunks_touched AS (SELECT bucket FROM n WHERE document_id IN (SELECT document_id FROM doomed)),
merged AS (
  SELECT document_id, s.source, coalesce(i.content, s.content) AS content, coalesce(s.bucket, i.bucket) AS bucket,
       CASE WHEN s.content IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created,
       CASE WHEN i.content IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS updated
  FROM left_docs s FULL JOIN incoming i USING (document_id))
SELECT document_id, source, content, created, updated, coalesce(chunks, 0) AS chunks,
  m.bucket NOT IN (SELECT bucket FROM docs_touched) AND m.bucket IN (SELECT bucket FROM d) AS documents_unchanged,
  m.bucket NOT IN (SELECT bucket FROM chunks_touched) AND m.bucket IN (SELECT bucket FROM n) AS chunks_unchanged
FROM merged m LEFT JOIN n USING (document_id)""",
    "upsert_documents": """
WITH stored AS (SELECT doc_id AS document_id, source, md5(text) AS content FROM documents),
incoming AS (SELECT doc_id + 50 AS document_id, 'quality ' || quality AS content FROM labels)
SELECT document_id, s.source, coalesce(i.content, s.content) AS content,
       CASE WHEN s.content IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created,
       CASE WHEN i.content IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS updated
FROM stored s FULL JOIN incoming i USING (document_id)""",
}
