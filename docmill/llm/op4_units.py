"""Substring dedup by hashing units of text: keep the earliest occurrence, remove the others.

A unit is a sentence or the rest of a line: texts are cut at line ends and after sentence ends, so
that passages set into the middle of a line are found too. Units are lower-cased, their white space
is collapsed, and units of at least ``min_words`` words are hashed to 128 bits. Digests are counted
globally (combined on the map side) with their earliest occurrence, by document id and offset; only
digests that repeat are joined back.

The ends of a passage set into the middle of a sentence share a unit with the words around it.
``repeated_text`` therefore adds runs of at least ``min_run`` words that occur before, compared word
by word wherever they stand (``passages``).

Defined cases: null and empty texts have no units; a null id ranks before all others; rows with
equal ids are one document, so equal units at equal offsets in them are one occurrence; offsets and
lengths are in code points of the original text. Other columns of the input take no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docmill.llm.common import release, stored, text_batches
from docmill.llm.passages import repeated_passages

MIN_WORDS = 6
MIN_RUN = 12
_CUT = re.compile(r"[.!?][^\S\n]+|\n")


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """(start, length, normalised unit) of the units that are long enough."""
    out, at = [], 0
    ends = [(m.start() + (m[0] != "\n"), m.end()) for m in _CUT.finditer(text)]
    for stop, after in [*ends, (len(text), len(text))]:
        words = text[at:stop].lower().split()
        if len(words) >= min_words:
            out.append((at, stop - at, " ".join(words)))
        at = after
    return out


def hashed_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``digest`` of every unit of every whole text."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("digest", T.BinaryType()),
    ])

    def work(batches):
        import xxhash
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in text_batches(batches, 1_000, 4 << 20):
            counts, starts, lengths, digests = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = units(text, min_words) if text else []
                counts.append(len(found))
                for start, length, unit in found:
                    starts.append(start)
                    lengths.append(length)
                    digests.append(xxhash.xxh3_128_digest(unit.encode()))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([
                ids.cast(arrow.field(0).type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(digests, arrow.field(3).type),
            ], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(work, schema)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """Every occurrence to remove: ``doc_id``, ``start``, ``length``, and where its text is kept:
    ``kept_doc_id``, ``kept_start``."""
    # stored, so that the texts are cut once for both the grouping and the join
    found = stored(hashed_units(docs, id_col, text_col, min_words))
    first = found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "start")).alias("_kept")
    ).where("_n > 1")
    # read from a file, so that the join deals both its sides and a frequent digest can be split
    first = stored(first, tidy=True)
    again = found.join(first, "digest")
    same = F.col("doc_id").eqNullSafe(F.col("_kept.doc_id")) & (F.col("start") == F.col("_kept.start"))
    return again.where(~same).select(
        "doc_id", "start", "length", F.col("_kept.doc_id").alias("kept_doc_id"),
        F.col("_kept.start").alias("kept_start"),
    )


def repeated_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """``repeated_units`` and, in the same columns, all runs of ``min_run`` words or more that occur
    before. Spans may overlap."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    runs = repeated_passages(named, ["doc_id"], min_run, fold=True, lines=False).select(
        "doc_id", "start", "length", F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.start").cast("long").alias("kept_start"),
    )
    repeated = repeated_units(docs, id_col, text_col, min_words)
    whole = stored(repeated, tidy=True)
    release(repeated)
    return whole.unionByName(runs).distinct()


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of their texts; all columns stay as they are."""
    cuts = spans.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_cuts")
    )
    joined = docs.join(cuts, docs[id_col].eqNullSafe(cuts["_id"]), "left")
    piece = F.aggregate(
        "_cuts", F.struct(F.lit("").alias("text"), F.lit(1).cast("long").alias("at")),
        lambda s, c: F.struct(
            F.concat(s["text"], F.substring(docs[text_col], s["at"], F.greatest(c["start"] + 1 - s["at"], F.lit(0)))),
            F.greatest(s["at"], c["start"] + c["length"] + 1),
        ),
    )
    rest = F.concat(piece["text"], F.substring(docs[text_col], piece["at"], F.length(docs[text_col])))
    text = F.when(F.col("_cuts").isNull(), docs[text_col]).otherwise(rest)
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
