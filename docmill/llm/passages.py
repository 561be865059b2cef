"""Passages that occur before, wherever they stand: runs of at least ``least`` words, word by word.

A window of ``least`` words is a copy if an equal one stands at an earlier place; the copies of one
original that follow each other are one passage. So lines, sentences and what surrounds a passage
play no part. Two steps leave out windows that cannot add anything:

* Texts are cut into pieces where a hash of the next words says so. A later copy of a piece is a
  passage by itself, and its windows also stand in the earliest copy; only those that cross a cut are
  still needed. The earliest places of all pieces are sent to the workers as a bitmap of fixed size.
* Of the word groups in a needed window the one with the smallest hash stands for it (winnowing), so
  equal windows have equal ones. Groups are counted, those that repeat are sent as a second bitmap,
  and only windows whose group is marked are hashed to 128 bits and compared.

A mark too many in either bitmap costs time and changes nothing.

Words are what stands between white space, compared letter by letter, in lower case with ``fold``. A
copy that overlaps its own original stays. Rows with equal ``key`` values are one document.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from docmill.llm.common import release, stored, text_batches

SLOTS = 1 << 28
BATCH = 1 << 18  # bytes of text at a time: some thirty times as much is held while its words are hashed
_BUCKET = 1 << 15  # bits in one value of bitmap_construct_agg
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _letters(fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A random number for every code point, and which are white space."""
    codes = np.arange(0x110000, dtype=np.uint64)
    if fold:
        for c in range(0x20000):
            low = chr(c).lower()
            if len(low) == 1:
                codes[c] = ord(low)
        codes[ord("ς")] = ord("σ")
    space = np.zeros(0x110000, bool)
    space[[c for c in range(0x4000) if chr(c).isspace()]] = True
    return _mixed(codes), space


class Words:
    """The words of some texts: hash, text, start and stop (code points) of each."""

    def __init__(self, texts: list[str], fold: bool):
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        letters, blank = _letters(fold)
        bases = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        inside = np.concatenate([[False], ~blank[codes], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        self.codes, self.n, self.sums = codes, len(starts), {}
        self.text = np.searchsorted(bases, starts, side="right") - 1
        self.first = np.searchsorted(starts, bases[:-1])
        self.start, self.stop = starts - bases[self.text], stops - bases[self.text]
        if not self.n:
            self.hash = np.zeros(0, np.uint64)
            return
        sizes = stops - starts
        offsets = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(offsets, sizes)
        factors = _mixed(np.arange(int(sizes.max()), dtype=np.uint64) + np.uint64(0x110000)) | np.uint64(1)
        self.hash = _mixed(np.add.reduceat(letters[codes[inside[1:-1]]] * factors[at], offsets))
        self.bases, self.place = bases, starts

    def groups(self, size: int, base: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on, over all texts."""
        starts = np.arange(max(self.n - size + 1, 0))
        return self.spans(starts, np.full(len(starts), size), base)

    def spans(self, starts: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
        """Hash of each stretch of ``sizes`` words from ``starts`` on."""
        total, back = self._sums(base)
        return _mixed((total[starts + sizes] - total[starts]) * back[starts] + sizes.astype(np.uint64))

    def _sums(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in self.sums:
            powers = np.repeat(np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64), self.n, axis=1)
            powers[:, :1] = 1
            powers = np.cumprod(powers, axis=1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * powers[0])])
            self.sums[base] = total, powers[1]
        return self.sums[base]

    def within(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each word on stand in one text."""
        return self.text[size - 1 :] == self.text[: max(self.n - size + 1, 0)]


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    done = 1
    while done < size:
        step = min(done, size - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def _pieces(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the pieces that have ``least`` words or more."""
    share = np.uint64((1 << (8 * least).bit_length()) - 1)
    cut = np.zeros(words.n, bool)
    some = words.groups(4, _BASES[1])
    cut[: len(some)] = (some & share == 0) & words.within(4)
    cut[words.first[words.first < words.n]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, words.n))
    return starts[sizes >= least], sizes[sizes >= least]


def _spots(words: Words, keys: np.ndarray, starts: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Hash of a piece and its place."""
    text = words.text[starts]
    return _mixed(_mixed(keys[text] + (starts - words.first[text]).astype(np.uint64)) ^ digest)


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _needed(words: Words, keys: np.ndarray, least: int, firsts: np.ndarray) -> np.ndarray:
    """The windows in one text that do not stand inside a later copy of a piece."""
    starts, sizes = _pieces(words, least)
    later = ~_marked(firsts, _spots(words, keys, starts, words.spans(starts, sizes, _BASES[0])))
    change = np.zeros(words.n + 1, np.int64)
    change[starts[later]] += 1
    change[starts[later] + sizes[later] - least + 1] -= 1
    return words.within(least) & (np.cumsum(change)[: max(words.n - least + 1, 0)] == 0)


def _smallest(words: Words, least: int, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word groups that stand for some needed window, one for each place, and for each
    window the hash of its smallest group."""
    size = (3 * least + 3) // 4
    width = least - size + 1
    if words.n < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    groups = np.where(words.within(size), words.groups(size, _BASES[0]), _NONE)
    window = _sliding(groups, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([edge, np.where(needed, window, np.uint64(0)), edge]), width, np.maximum)
    return groups[groups == most], window


def _bitmap(hashes: DataFrame) -> bytes:
    """Bits of the values of the one column of ``hashes``, packed: every worker host keeps a file of them."""
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit(SLOTS - 1))
    parts = hashes.select(
        F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(F.lit(_BUCKET - 1)).alias("bit")
    ).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    parts = stored(parts, tidy=True)
    marks = np.zeros((SLOTS // _BUCKET, _BUCKET // 8), np.uint8)
    for bucket, bits in parts.toLocalIterator():
        marks[bucket] = np.frombuffer(bytes(bits), np.uint8)
    release(parts)
    return zlib.compress(marks, 1)


@lru_cache(2)
def _bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _batches(batches, fold: bool):
    """Batches with the words of their texts and the hashes of their keys."""
    for batch in text_batches(batches, 1_000, BATCH, column=-1):
        keys = batch.column(batch.num_columns - 2).to_numpy().view(np.uint64)
        yield batch, Words([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], fold), keys


def _placed(docs: DataFrame, key: list[str], names: list[str], more: dict[str, T.DataType], fold: bool, found) -> DataFrame:
    """``key``, ``names`` (of word, words, start, stop: code points, line, last_line: non-blank lines
    before) and ``more`` of the stretches that ``found`` gives for the words of a batch: first words,
    numbers of words, and arrays for ``more``."""
    schema = T.StructType([
        *[docs.schema[c] for c in key],
        *[T.StructField(c, T.IntegerType()) for c in names],
        *[T.StructField(c, kind) for c, kind in more.items()],
    ])

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch, words, keys in _batches(batches, fold):
            at, sizes, others = found(words, keys)
            if not len(at):
                continue
            text, stop = words.text[at], at + sizes - 1
            columns = {"word": at - words.first[text], "words": sizes, "start": words.start[at], "stop": words.stop[stop]}
            if "line" in names:
                line = _line_numbers(words)
                columns |= {"line": line[at], "last_line": line[stop]}
            rows = pa.array(text)
            arrays = [batch.column(i).take(rows).cast(arrow.field(i).type) for i in range(len(key))]
            arrays += [pa.array(columns[n].astype(np.int32)) for n in names]
            arrays += [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in others]
            for i in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([a.slice(i, 50_000) for a in arrays], schema=arrow)

    return docs.mapInArrow(work, schema)


def _line_numbers(words: Words) -> np.ndarray:
    """For every word the number of non-blank lines of its text that end before it."""
    breaks = np.cumsum(words.codes == 10)[words.place]
    line = np.cumsum(np.concatenate([[True], breaks[1:] != breaks[:-1]])) - 1
    return line - line[words.first[words.text]]


def _copies(found: DataFrame, key: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """The earliest place of every digest, and the others with it. Places that overlap their
    earliest one stay out."""
    place = [c for c in found.columns if c not in ("h1", "h2", "words", "stop", "last_line")]
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("kept"))
    first = stored(first, tidy=True)  # read from a file, so that the join can split a frequent digest
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"kept.{c}"))
    ahead = F.col("word") - F.col("kept.word")
    copies = found.join(first.where("n > 1"), ["h1", "h2"]).where(~same | (ahead >= least)).select(
        *[c for c in found.columns if c not in ("h1", "h2")], ahead.alias("_ahead"),
        F.struct(*[f"kept.{c}" for c in place if c != "spot"]).alias("kept"),
    )
    return first, copies


def repeated_passages(docs: DataFrame, key: list[str], least: int, fold: bool, lines: bool = True) -> DataFrame:
    """Every passage to remove: ``key``, start, length (code points), line, last_line (with ``lines``),
    and ``kept``: ``key``, word, start and line of the earliest place of its words. ``docs`` holds
    ``key`` and text."""
    docs = docs.select(*key, F.xxhash64(*key).alias("_hash"), "text")
    numbers = ["line", "last_line"] if lines else []
    long, short = T.LongType(), T.IntegerType()
    context = docs.sparkSession.sparkContext

    def pieces(words, keys):
        starts, sizes = _pieces(words, least)
        h1, h2 = (words.spans(starts, sizes, base) for base in _BASES)
        return starts, sizes, [h1, h2, _spots(words, keys, starts, h1)]

    names = ["word", "words", "start", "stop", *numbers]
    found = stored(_placed(docs, key, names, {"h1": long, "h2": long, "spot": long}, fold, pieces), tidy=True)
    first, copies = _copies(found, key, least)
    pieces_found, pieces_first, copies = found, first, stored(copies.drop("spot"), tidy=True)
    firsts = context.broadcast(_bitmap(first.select("kept.spot")))
    release(pieces_found)
    release(pieces_first)

    def groups(batches):
        bits = _bits(firsts.value)
        for _, words, keys in _batches(batches, fold):
            digests, _ = _smallest(words, least, _needed(words, keys, least, bits))
            yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64))], ["digest"])

    counted = docs.mapInArrow(groups, "digest long").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = context.broadcast(_bitmap(counted.where("n > 1").select("digest")))

    def windows(words, keys):
        needed = _needed(words, keys, least, _bits(firsts.value))
        _, small = _smallest(words, least, needed)
        at = np.flatnonzero(needed & _marked(_bits(repeated.value), small))
        h1, h2 = (words.groups(least, base)[at] for base in _BASES)
        # 96 bits are enough to tell windows apart
        return at, np.full(len(at), least), [h1, (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)]

    names = ["word", "start", "stop", *numbers]
    found = stored(_placed(docs, key, names, {"h1": long, "h2": short}, fold, windows), tidy=True)
    first, later = _copies(found, key, least)
    early, copies = copies, copies.unionByName(later.withColumn("words", F.lit(least)))
    copies = copies.withColumn("_from", F.struct(*[f"kept.{c}" for c in key]))
    inside = Window.partitionBy(*key, "_from", "_ahead").orderBy("word")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    runs = copies.withColumn("_end", F.max(F.col("word") + F.col("words")).over(before))
    opens = F.when(F.col("word") <= F.col("_end"), 0).otherwise(1)
    runs = runs.withColumn("_run", F.sum(opens).over(inside))
    touched = [F.min("line").cast("long").alias("line"), F.max("last_line").cast("long").alias("last_line")]
    passages = runs.groupBy(*key, "_from", "_ahead", "_run").agg(
        F.min("start").cast("long").alias("start"), (F.max("stop") - F.min("start")).cast("long").alias("length"),
        *(touched if lines else []), F.min("kept").alias("kept"),
    ).drop("_from", "_ahead", "_run")
    passages = stored(passages, tidy=True)
    for table in (found, first, early):
        release(table)
    for marks in (firsts, repeated):
        marks.destroy()
    return passages
