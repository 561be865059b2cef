"""Reading documents, inventories, transcripts, golden questions and stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.arrays import explode_rows

# Patterns of files to ingest, and folders left out.
PATTERNS = [
    "*.md", "*.markdown", "*.txt", "*.pdf", "*.docx", "*.doc", "*.pptx", "*.ppt", "*.xlsx",
    "*.xls", "*.html", "*.htm", "*.mp3", "*.wav", "*.m4a", "*.flac",
]
LEFT_OUT = ["/examples/", "/web/"]

# File type by extension in the raw and the processed area.
RAW_TYPES = {
    ".pdf": "pdf", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html",
    ".txt": "text", ".text": "text", ".json": "json",
}
PROCESSED_TYPES = {
    ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".json": "json",
}

GOLDEN_SCHEMA = (
    "query string, expected_doc_path string, expected_keywords string, "
    "min_similarity double, query_type string"
)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root`` that can be ingested, as ``path, modificationTime, length,
    content``. Content is read only where a later step selects it."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(PATTERNS) + "}")
        .load(root)
    )
    for folder in LEFT_OUT:
        files = files.where(~F.contains("path", F.lit(folder)))
    return files


def decode_bytes(content: Column) -> Column:
    """Text of a byte column: UTF-8, or Latin-1 where the bytes are no valid UTF-8."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable file: path, source (path below ``root``), format, content, title.

    HTML is converted to markdown text. Other structured and audio files need an outside
    converter, so they keep NULL content and an entry in ``errors``.
    """
    files = scan_files(spark, root)
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    base = root.rstrip("/") + "/"
    rows = files.select(
        path.alias("path"),
        F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path)))
        .otherwise(path).alias("source"),
        T.format_class(path).alias("format"),
        T.extension(path).alias("extension"),
        decode_bytes(F.col("content")).alias("_text"),
    )
    html = F.col("extension").isin(".html", ".htm")
    content = F.when(html, T.html_to_text(F.col("_text"))).when(
        F.col("format") == "text", F.col("_text")
    )
    errors = F.when(
        content.isNull(), F.array(F.concat(F.lit("no converter for "), "extension"))
    ).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "path", "source", "format", content.alias("content"), errors.alias("errors")
    ).withColumn("title", T.extract_title(F.col("content"), F.col("path")))


def file_type(path: Column, types: dict[str, str]) -> Column:
    ext = T.extension(path)
    known = F.lit(None).cast("string")
    for suffix, name in types.items():
        known = F.when(ext == suffix, name).otherwise(known)
    return F.coalesce(known, F.lit("other"))


def clean_request(path: Column) -> Column:
    """Requested path without a leading ``documents/`` and then ``data/``."""
    return F.regexp_replace(F.regexp_replace(path, "^documents/", ""), "^data/", "")


def lookup_documents(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Find the file for each ``requested`` path: the exact path, else the first file of that
    name, ``raw/`` before ``processed/``. Empty and absolute requests are refused.

    Files are cut to the best one per name first, so a common name cannot multiply rows.
    """
    cleaned = F.col("clean")
    asked = requests.withColumn("clean", clean_request(F.col("requested"))).withColumn(
        "name", F.element_at(F.split("clean", "/"), -1)
    )
    names = files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name")
    ).withColumn(
        "area", F.when(F.col("path").startswith("raw/"), 0).when(
            F.col("path").startswith("processed/"), 1)
    ).where(F.col("area").isNotNull())
    by_name = names.groupBy("name").agg(F.min(F.struct("area", "path"))["path"].alias("_named"))
    exact = files.select(F.col("path").alias("clean"), F.lit(True).alias("_exact")).distinct()
    found = asked.join(exact, "clean", "left").join(by_name, "name", "left")
    bad = (F.col("requested") == "") | F.col("requested").startswith("/")
    return found.select(
        *requests.columns,
        F.when(bad, None).when(F.col("_exact"), cleaned).otherwise(F.col("_named")).alias("path"),
        F.when(bad, "invalid").when(F.col("_exact"), "exact")
        .when(F.col("_named").isNotNull(), "name").otherwise("not_found").alias("match"),
    )


def transcript_segments(
    transcripts: DataFrame, text_col: str = "text", keep: list[str] = ()
) -> DataFrame:
    """Lines ``[time: a-b] words`` as rows: start, end and text."""
    # Fixed value: the form of a transcript line.
    pattern = r"^\[time: ([0-9.]+)-([0-9.]+)\]\s*(.*)$"
    lines = explode_rows(transcripts, F.split(text_col, "\n"), keep, "line", "line_no")
    lines = lines.where(F.col("line").rlike(pattern))
    return lines.select(
        *keep,
        "line_no",
        F.regexp_extract("line", pattern, 1).cast("double").alias("start"),
        F.regexp_extract("line", pattern, 2).cast("double").alias("end"),
        T.strip(F.regexp_extract("line", pattern, 3)).alias("text"),
    )


def keyword_list(text: Column) -> Column:
    """``['a','b']`` as an array; an apostrophe between two letters belongs to the word."""
    return F.regexp_extract_all(
        text, F.lit(r"'([^']*+(?:(?<=\p{L})'(?=\p{L})[^']*+)*+)'"), F.lit(1)
    )


def parse_golden(lines: DataFrame, line_col: str = "value", keep: list[str] = ()) -> DataFrame:
    """Golden questions from CSV lines."""
    record = F.from_csv(F.col(line_col), F.lit(GOLDEN_SCHEMA), {"quote": '"', "escape": '"'})
    return lines.select(*keep, record.alias("r")).select(
        *keep, "r.*"
    ).withColumn("expected_keywords", keyword_list(F.col("expected_keywords")))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(
        path, schema=GOLDEN_SCHEMA, header=True, quote='"', escape='"', multiLine=True
    )
    return rows.withColumn("expected_keywords", keyword_list(F.col("expected_keywords")))


def read_stopwords(spark: SparkSession, path: str, language: str = "default") -> list[str]:
    """Stop words of a language from a JSON file; the ``default`` list stands in for an
    unknown language, and the built-in list for a missing one."""
    row = spark.read.json(path, multiLine=True).first()
    data = row.asDict() if row else {}
    found = data.get(language) or data.get("default")
    return list(found) if found else T.STOPWORDS


