"""Line dedup with a suffix array over line-id sequences, made by distributed prefix doubling.

Every document is the sequence of its non-blank lines. Prefix doubling ranks the suffixes by their
first 1, 2, 4, ... lines: the rank of 2n lines orders the pairs of ranks n lines apart, by a range
sort of the distinct pairs and a running count. Suffixes that no other one shares its lines with
leave at once, so that later rounds only see what repeats. Suffixes with the same L first lines form
an LCP interval of the array; two overlapping ranks, of the first and of the last 2^k of the L lines,
name it. The interval's earliest member stays, and the run is deleted from the others.

A run is deleted if it has ``min_words`` words or more and occurs before. Every longer run consists
of shortest such runs from each line on and up to each line, so looking at those intervals finds the
lines of all maximal runs. Runs do not cross documents; a copy may overlap its original.

Documents rank by id (null first), then by a hash of the text. Defined cases: rows with equal id and
text are one document and get one result; null and empty texts have no lines; lines are compared
without white space at their ends, blank lines are neither compared nor deleted. Other columns of
the input take no part.

A passage inside a line gives other lines in each document. ``repeated_runs`` therefore adds the runs
of ``min_words`` words that occur before, compared word by word (``passages``); a copy that overlaps
its own original is no such run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from docmill.llm.common import numbered, release, stored, text_batches
from docmill.llm.passages import repeated_passages

MIN_WORDS = 50
PLACE = ["doc_id", "text_hash"]


def shortest_runs(words: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines of the shortest run of ``least`` words that starts there,
    and of the one that ends there; 0 where there is none."""
    total = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    lines = np.arange(len(words))
    ahead = np.searchsorted(total, total[:-1] + least, side="left") - lines
    ahead[ahead + lines > len(words)] = 0
    behind = lines + 1 - (np.searchsorted(total, total[1:] - least, side="right") - 1)
    behind[total[1:] < least] = 0
    return ahead, behind


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, line (from 0), digest, ahead, behind, start and length (code points) of
    every non-blank line of every whole text."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
        T.StructField("line", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("ahead", T.LongType()), T.StructField("behind", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    ])

    def work(batches):
        import xxhash
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in text_batches(batches, 1_000, 4 << 20, column=2):
            counts, columns = [], [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                words, at, n = [], 0, 0
                for line in (text or "").split("\n"):
                    bare = line.strip()
                    if bare:
                        columns[0].append(n)
                        columns[1].append(xxhash.xxh3_128_digest(bare.encode()))
                        columns[4].append(at)
                        columns[5].append(len(line))
                        words.append(len(bare.split()))
                        n += 1
                    at += len(line) + 1
                ahead, behind = shortest_runs(words, min_words)
                columns[2].extend(ahead.tolist())
                columns[3].extend(behind.tolist())
                counts.append(n)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            arrays = [batch.column(i).take(row).cast(arrow.field(i).type) for i in (0, 1)]
            arrays += [pa.array(c, type=arrow.field(i + 2).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return _source(docs, id_col, text_col).mapInArrow(work, schema)


def _same(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash")
    )


def _first_ranks(found: DataFrame) -> DataFrame:
    """Rank of every line that occurs at two places or more, by its digest."""
    found = stored(found, tidy=True)
    place = F.struct(*PLACE, "line")
    groups = found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("_first"), F.max(place).alias("_last")
    ).where("not (_first <=> _last)").select("digest", "n")
    order = numbered(groups, ["digest"], "n", "rank")
    ranked = stored(order.select("digest", "rank"), tidy=True)
    release(order)
    again = found.select(*PLACE, "line", "digest", "ahead", "behind", "start", "length").join(ranked, "digest")
    first = stored(again.drop("digest").dropDuplicates([*PLACE, "line"]), tidy=True)
    release(again)
    return first


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks by the first 2 * ``step`` lines from the ranks by the first ``step``, of the suffixes
    that share them with another."""
    a, b = ranks.alias("a"), ranks.alias("b")
    ahead = F.col("b.line") == F.col("a.line") + step
    pairs = stored(a.join(b, _same("a", "b") & ahead).select(
        "a.doc_id", "a.text_hash", "a.line", F.col("a.rank").alias("r1"), F.col("b.rank").alias("r2")
    ), tidy=True)
    groups = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = numbered(groups, ["r1", "r2"], "n", "rank").select("r1", "r2", "rank")
    doubled = stored(pairs.join(ranked, ["r1", "r2"]).select(*PLACE, "line", "rank"), tidy=True)
    release(pairs)
    release(ranked)
    return doubled


def suffix_ranks(first: DataFrame, longest: int) -> DataFrame:
    """``level`` k, place and rank by the first 2^k lines, for all levels up to ``longest`` lines."""
    level, k = first.select(*PLACE, "line", "rank"), 0
    levels = [level.withColumn("level", F.lit(0))]
    while 2 ** (k + 1) <= longest:
        level = _doubled(level, 2**k)
        k += 1
        if level.isEmpty():
            break
        levels.append(level.withColumn("level", F.lit(k)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """Every line to delete: doc_id, text_hash, line, start, length, and the document that holds
    the earliest copy of a run with it (kept_doc_id, kept_line: the line's place there)."""
    first = _first_ranks(lines(docs, id_col, text_col, min_words))
    runs = first.select(*PLACE, "line", F.col("ahead").alias("n")).unionAll(
        first.select(*PLACE, F.col("line") - F.col("behind") + 1, F.col("behind"))
    ).where("n > 0").distinct()
    longest = runs.agg(F.max("n")).first()[0] or 1
    ranks = suffix_ranks(first, min(longest, first.count()))
    level = F.floor(F.log2("n") + 1e-9).cast("int")
    runs = runs.withColumn("level", level).withColumn(
        "tail", F.col("line") + F.col("n") - F.pow(F.lit(2.0), "level").cast("long")
    ).alias("w")
    head, tail = ranks.alias("h"), ranks.alias("t")
    named = (
        runs.join(head, _same("w", "h") & (F.col("w.line") == F.col("h.line")) & (F.col("w.level") == F.col("h.level")))
        .join(tail, _same("w", "t") & (F.col("w.tail") == F.col("t.line")) & (F.col("w.level") == F.col("t.level")))
        .select("w.doc_id", "w.text_hash", "w.line", "w.n", F.col("h.rank").alias("head"), F.col("t.rank").alias("tail"))
    )
    named = stored(named, tidy=True)
    release(ranks, keep=first)
    intervals = named.groupBy("n", "head", "tail").agg(
        F.min(F.struct(*PLACE, "line")).alias("kept"), F.count(F.lit(1)).alias("_members")
    ).where("_members > 1").drop("_members")
    intervals = stored(intervals, tidy=True)  # so that the join deals both its sides and splits a large interval
    copies = named.join(intervals, ["n", "head", "tail"]).where(
        ~F.struct(*PLACE, "line").eqNullSafe(F.col("kept"))
    )
    covered = copies.select(
        *PLACE, F.posexplode(F.sequence(F.col("line"), F.col("line") + F.col("n") - 1)).alias("_at", "line"), "kept"
    )
    covered = covered.groupBy(*PLACE, "line").agg(F.min(F.struct(
        F.col("kept.doc_id").alias("doc_id"), F.col("kept.text_hash").alias("text_hash"),
        (F.col("kept.line") + F.col("_at")).alias("line"),
    )).alias("kept"))
    a, b = covered.alias("a"), first.alias("b")
    return a.join(b, _same("a", "b") & (F.col("a.line") == F.col("b.line"))).select(
        "a.doc_id", "a.text_hash", "a.line", "b.start", "b.length",
        F.col("a.kept.doc_id").alias("kept_doc_id"), F.col("a.kept.line").alias("kept_line"),
    )


def _runs(repeated: DataFrame) -> DataFrame:
    inside = Window.partitionBy(*PLACE).orderBy("line")
    rows = repeated.withColumn("_run", F.col("line") - F.row_number().over(inside))
    return rows.groupBy(*PLACE, "_run").agg(
        F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.min("start").alias("start"),
        F.max(F.col("start") + F.col("length")).alias("_end"),
        F.min(F.struct("line", "kept_doc_id", "kept_line")).alias("_kept"),
    ).select(
        *PLACE, "first_line", "n_lines", "start", (F.col("_end") - F.col("start")).alias("length"),
        F.col("_kept.kept_doc_id").alias("kept_doc_id"), F.col("_kept.kept_line").alias("kept_line"),
    )


def deleted_runs(repeated: DataFrame) -> DataFrame:
    """Neighbouring lines to delete as runs: doc_id, first_line, n_lines, start, length (code
    points of the original text, white space between included), kept_doc_id, kept_line."""
    return _runs(repeated).drop("text_hash")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``deleted_runs`` and, in the same columns, the repeated runs of words that do not lie inside
    one of them. ``first_line`` and ``n_lines`` tell the lines that such a run touches, ``kept_line``
    the line in which its copy begins; spans may overlap."""
    repeated = repeated_lines(docs, id_col, text_col, min_words)
    whole = stored(_runs(repeated), tidy=True)
    release(repeated)
    inner = repeated_passages(_source(docs, id_col, text_col), PLACE, min_words, fold=False).select(
        *PLACE, F.col("line").alias("first_line"), (F.col("last_line") - F.col("line") + 1).alias("n_lines"),
        "start", "length", F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.line").cast("long").alias("kept_line"),
    ).alias("a")
    end = "{0}.start + {0}.length"
    covered = F.expr(f"a.start >= b.start and {end.format('a')} <= {end.format('b')}")
    inner = inner.join(whole.alias("b"), _same("a", "b") & covered, "leftanti")
    return whole.unionByName(inner).drop("text_hash")


def without_lines(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines to delete. A document that loses all its non-blank lines goes;
    all others stay, with all their columns."""
    cuts = repeated.groupBy(*PLACE).agg(F.collect_set("line").alias("_cut"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_cut")
    joined = docs.join(cuts, docs[id_col].eqNullSafe(cuts["_id"]) & (F.xxhash64(docs[text_col]) == cuts["_hash"]), "left")
    schema = T.StructType(docs.schema.fields)
    at = docs.columns.index(text_col)

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in text_batches(batches, 1_000, 8 << 20, column=at):
            texts, kept = [], []
            cut = batch.column(len(schema)).to_pylist()
            for row, text in enumerate(batch.column(at).to_pylist()):
                if cut[row]:
                    text, some = _cut(text, set(cut[row]))
                    if not some:
                        continue
                kept.append(row)
                texts.append(text)
            rows = batch.take(pa.array(kept, pa.int64()))
            arrays = [rows.column(i).cast(f.type) for i, f in enumerate(arrow)]
            arrays[at] = pa.array(texts, type=arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return joined.select(*[docs[c] for c in docs.columns], cuts["_cut"].alias("_lines_to_cut")).mapInArrow(work, schema)


def _cut(text: str, gone: set[int]) -> tuple[str, bool]:
    out, n, some = [], 0, False
    for line in text.split("\n"):
        if line.strip():
            n += 1
            if n - 1 in gone:
                continue
            some = True
        out.append(line)
    return "\n".join(out), some
