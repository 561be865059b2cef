"""Corpus preparation: language filter, line dedup, near-dedup, decontamination, tokenization.

Every stage takes the documents that the one before kept, and all but the last return the columns
of ``documents``. Stages hand over Parquet files below the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm import op2_lines, op6_language, op8_decontaminate, op9_minhash, op10_sentencepiece
from docmill.llm.common import read_table, ship_package, stored
from docmill.llm.queries import language_model, vocabulary


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    ship_package(spark)
    made = tuple(f"_{len(docs.columns)}_{name}" for name in op6_language.MADE)
    found = op6_language.identify(docs, language_model(docs), made=made)
    return found.where(~F.col(made[-1])).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; one that loses all its lines goes."""
    ship_package(spark)
    kept = op2_lines.without_lines(docs, op2_lines.repeated_lines(docs))
    if "n_chars" not in kept.columns:
        return kept
    counted = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), counted).otherwise(F.col("n_chars")))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with one key for rows that are equal in id and text, and only those."""
    return docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))


def _except(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``keys``."""
    keys = keys.select(F.col("_key.doc_id").alias("_id"), F.col("_key.text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_hash"])
    return docs.join(keys, same, "leftanti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Of rows that
    are equal in id and text one stays, unless the text has no words."""
    ship_package(spark)
    groups = op9_minhash.near_duplicates(_keyed(docs), id_col="_key").withColumnRenamed("doc_id", "_key")
    groups = stored(groups)
    again = groups.where("kept and n_shingles > 0").groupBy("_key").count().where("count > 1")
    kept = _except(docs, groups.where(~F.col("kept")).select("_key"))
    if again.isEmpty():
        return kept
    several = again.select(F.col("_key.doc_id").alias("_id"), F.col("_key.text_hash").alias("_hash"))
    same = docs["doc_id"].eqNullSafe(several["_id"]) & (F.xxhash64(docs["text"]) == several["_hash"])
    one = docs.join(several, same, "leftsemi").dropDuplicates(["doc_id", "text"])
    return _except(kept, again.select("_key")).unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    benchmark = read_table(spark, sf_dir, "benchmark")
    leaks = op8_decontaminate.contaminated(_keyed(docs), benchmark, id_col="_key")
    return _except(docs, leaks.select(F.col("doc_id").alias("_key")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded text of every document kept."""
    ship_package(spark)
    return op10_sentencepiece.encode_digests(docs, vocabulary())


STAGES = [
    ("language", languages),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("sentencepiece", tokens),
]

#: No stage's rows can be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
