"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k * q q-grams with it, all on at most k + 1 neighbouring diagonals. So the shared q-grams
are counted by item, then in overlapping diagonal bands twice that wide, and a band that reaches the
bound is aligned: semi-global edit distance within the band's diagonals. Long items use longer
q-grams. Items of fewer than ``SHORT`` characters match without edits and as whole words only, by the
same bound with k = 0. A text is searched in overlapping stretches, its shared q-grams in bounded slices.

Items come in blocks of bounded size, each sent to the workers while all texts are scanned once;
no text is shuffled. Texts and items are compared lower-cased with white space collapsed; spans are
reported in code points of the original text.

Defined cases: null and empty texts and items match nothing; repeated texts are each reported;
items with equal texts are each reported; without items there are no rows. Other columns take no
part.
"""

from __future__ import annotations

from bisect import bisect
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docmill.llm.common import text_batches

ERROR = 0.1  # edits allowed for each character of an item
SHORT = 25  # items below this length match exactly
LONG = 60  # items from this length on use q-grams of 8 characters, others of 5, below 5 single ones
BLOCK_CHARS = 2_000_000  # characters of items in one pass
STRETCH = 1 << 16  # characters of a text searched at a time, besides the overlap
PAIRS = 1 << 21  # shared q-grams counted at a time
_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """q-grams as numbers, a byte for each character. Different characters may share a byte, which
    can only add shared q-grams."""
    folded = (codes ^ (codes >> 8)).astype(np.uint8)
    if q == 1:
        return folded.astype(np.uint64)
    size = max(0, len(codes) - q + 1)
    pairs = _joined(folded, folded[1:], np.uint16, 8)
    fours = _joined(pairs, pairs[2:], np.uint32, 16)
    if q == 8:
        return _joined(fours, fours[4:], np.uint64, 32)[:size]
    return _joined(fours, folded[4:], np.uint64, 8)[:size]


def _joined(left: np.ndarray, right: np.ndarray, kind, bits: int) -> np.ndarray:
    out = left[: len(right)].astype(kind)
    out <<= kind(bits)
    out |= right
    return out


class Items:
    """q-grams of items: where each occurs."""

    def __init__(self, items: list[tuple[object, str]], q: int, error: float):
        self.q, self.ids = q, [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.codes = [_codes(t) for t in self.texts]
        sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.sizes, self.edits = sizes, np.where(sizes < SHORT, 0, np.floor(sizes * error).astype(np.int64))
        self.least = np.maximum(sizes - q + 1 - self.edits * q, 1)
        grams = [_grams(c, q) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        counts = [len(g) for g in grams]
        item = np.repeat(np.arange(len(items)), counts)
        place = np.concatenate([np.arange(n) for n in counts]) if grams else np.empty(0, dtype=np.int64)
        turn = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(flat[turn], return_index=True, return_counts=True)
        self.item, self.place = item[turn], place[turn]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * _ODD) >> np.uint64(64 - _BITS)

    def search(self, text: str, codes: np.ndarray):
        """(item, start, end, edits) of the regions of a normalised text that match."""
        grams = _grams(codes, self.q)
        reach = int((self.sizes + self.edits).max())  # a region lies whole in one of the stretches
        found: set[tuple[int, int, int]] = set()
        for base in range(0, len(grams), STRETCH):
            found.update(self._bands(grams[base : base + STRETCH + reach], base, len(codes)))
        return self._verified(text, codes, sorted(found)) if found else []

    def _slices(self, hits: np.ndarray, at: np.ndarray):
        """Item, place in it and place in the text of every shared q-gram, about ``PAIRS`` at a time."""
        counts = self.count[at]
        ends = np.cumsum(counts)
        start = 0
        while start < len(hits):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
            some = counts[start:stop]
            inner = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            entry = np.repeat(self.first[at[start:stop]], some) + inner
            yield self.item[entry], self.place[entry], np.repeat(hits[start:stop], some)
            start = stop

    def _bands(self, grams: np.ndarray, base: int, length: int) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of the bands that reach the bound, for the q-grams from
        ``base`` on of a text of ``length`` characters."""
        hits = np.flatnonzero(self.seen[self._slot(grams)])
        if not len(hits):
            return []
        at = np.minimum(np.searchsorted(self.keys, grams[hits]), len(self.keys) - 1)
        same = self.keys[at] == grams[hits]
        hits, at = hits[same] + base, at[same]
        total = int(self.count[at].sum())
        if total < self.least.min():
            return []
        slices = list(self._slices(hits, at)) if total <= PAIRS else None
        shared = np.zeros(len(self.ids), dtype=np.int64)
        for item, _, _ in slices or self._slices(hits, at):
            shared += np.bincount(item, minlength=len(shared))
        enough = shared >= self.least
        if not enough.any():
            return []
        longest = int(self.sizes.max())
        cells = length + 2 * longest + 3

        def banded():
            for item, place, position in slices or self._slices(hits, at):
                keep = enough[item]
                item, place, position = item[keep], place[keep], position[keep]
                # a band is two neighbouring cells
                cell = item * cells + (position - place + longest) // (self.edits[item] + 1)
                yield np.concatenate([cell, cell + 1]), np.concatenate([place, place])

        keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for found, _ in banded():
            some, more = np.unique(found, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, more]), minlength=len(keys)).astype(np.int64)
        keys = keys[counts >= self.least[keys // cells]]
        if not len(keys):
            return []
        # of repetitive texts: a place in the item counts once in a band
        once = np.empty(0, dtype=np.int64)
        for found, place in banded():
            near = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            keep = keys[near] == found
            once = np.union1d(once, near[keep] * longest + place[keep])
        counts = np.bincount(once // longest, minlength=len(keys))
        out = []
        for key in keys[counts >= self.least[keys // cells]].tolist():
            which, cell = divmod(key, cells)
            wide = int(self.edits[which]) + 1
            low = (cell - 1) * wide - longest
            out.append((which, low, low + 2 * wide - 1))
        return out

    def _verified(self, text, codes, bands):
        best: dict[int, list[tuple[int, int, int]]] = {}
        for which, low, high in bands:
            if match := self._align(text, codes, which, low, high):
                best.setdefault(which, []).append(match)
        out = []
        for which, matches in best.items():
            taken: list[tuple[int, int, int]] = []  # by place; none overlaps another
            for edits, start, end in sorted(set(matches)):
                at = bisect(taken, (start, end, edits))
                if (not at or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end, edits))
            out += [(which, *match) for match in taken]
        return out

    def _align(self, text, codes, which, low, high):
        """(edits, start, end) of the best alignment whose diagonals lie in the band widened by the
        edits, or None."""
        item, k = self.texts[which], int(self.edits[which])
        begin, until = max(0, low - k), min(len(text), high + k + len(item))
        if len(item) < SHORT:
            starts = (at for at in range(begin, high + 1) if text.startswith(item, at) and _alone(text, at, at + len(item)))
            return next(((0, at, at + len(item)) for at in starts), None)
        exact = text.find(item, begin, until)
        if exact >= 0:
            return 0, exact, exact + len(item)
        return banded(self.codes[which], codes, low - k, high + k, k)


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on at the ends of a stretch."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not before and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int):
    """Least edits between ``item`` and any stretch of ``text``, over the diagonals low to high
    (text place minus item place): (edits, start, end), None above ``limit``."""
    width = high - low + 1
    diagonals = np.arange(low, high + 1)
    far = limit + 1
    inside = (diagonals >= 0) & (diagonals <= len(text))
    cost = np.where(inside, 0, far).astype(np.int64)
    start = diagonals.copy()
    steps = np.arange(width)
    padded = np.concatenate([text, np.zeros(1, dtype=text.dtype)])
    for i, character in enumerate(item):
        place = diagonals + i  # text place before this character
        valid = (place >= 0) & (place < len(text))
        letter = padded[np.where(valid, place, len(text))]
        match = cost + np.where(valid, letter != character, far)
        drop = np.concatenate([cost[1:], [far]]) + 1  # the item's character is missing in the text
        from_drop = drop < match
        now = np.where(from_drop, drop, match)
        origin = np.where(from_drop, np.concatenate([start[1:], [0]]), start)
        # further characters of the text: cost grows by one for each diagonal
        lead = now - steps
        least = np.minimum.accumulate(lead)
        fresh = np.concatenate([[True], lead[1:] < least[:-1]])
        source = np.maximum.accumulate(np.where(fresh, steps, 0))
        cost, start = np.minimum(now[source] + steps - source, far), origin[source]
        past = diagonals + i + 1
        cost = np.where((past < 0) | (past > len(text)), far, cost)
        if cost.min() > limit:
            return None
    at = int(np.argmin(cost))
    if cost[at] > limit:
        return None
    return int(cost[at]), int(max(start[at], 0)), int(diagonals[at] + len(item))


def _offsets(text: str) -> tuple[list[int], int]:
    """For each character of the normalised text, its place in the original."""
    out: list[int] = []
    gap = None
    for at, character in enumerate(text):
        low = character.lower()
        if not low.strip():
            gap = at if gap is None and out else gap
            continue
        if gap is not None:
            out.append(gap)
            gap = None
        out.extend([at] * len(low))
    return out, len(text)


def _searches(items: list[tuple[object, str]], error: float) -> list[Items]:
    groups: dict[int, list[tuple[object, str]]] = {}
    for item in items:
        groups.setdefault(8 if len(item[1]) >= LONG else 5 if len(item[1]) >= 5 else 1, []).append(item)
    return [Items(group, q, error) for q, group in groups.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", error: float = ERROR,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each region of a text that matches an item: ``doc_id``, ``item_id``, ``start``,
    ``end`` (code points of the original text) and ``edits``."""
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("item_id", benchmark.schema[item_col].dataType),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("edits", T.LongType()),
    ])
    source = docs.select(id_col, text_col)
    parts = []
    rows = benchmark.where(F.col(item_text_col) != "").select(item_col, item_text_col)
    for block in _blocks(rows.toLocalIterator(), block_chars):
        sent = spark.sparkContext.broadcast(block)

        def work(batches, sent=sent):
            from pyspark.sql.pandas.types import to_arrow_schema

            return _scan(batches, _searches(sent.value, error), to_arrow_schema(schema))

        parts.append(source.mapInArrow(work, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _blocks(rows, size: int):
    """Items with a text, in lists of about ``size`` characters."""
    block, held = [], 0
    for row in rows:
        text = normalised(row[1])
        if not text:
            continue
        block.append((row[0], text))
        held += len(text)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def _scan(batches, searches: list[Items], arrow):
    for batch in text_batches(batches, 1_000, 8 << 20):
        docs, found = [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            clean = normalised(text)
            codes = _codes(clean)
            matches = [(s.ids[m[0]], *m[1:]) for s in searches for m in s.search(clean, codes)]
            if matches:
                places, length = _offsets(text)
                for item, start, end, edits in matches:
                    last = places[end - 1] + 1 if 0 < end <= len(places) else length
                    docs.append(row)
                    found.append((item, places[start] if start < len(places) else length, last, edits))
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(docs, pa.int64())).cast(arrow.field(0).type)]
            + [pa.array(c, type=arrow.field(i + 1).type) for i, c in enumerate(columns)],
            schema=arrow,
        )
