"""Hard-negative mining: exact searches with coordinate pruning in length buckets.

A search asks for the best scores (integer inner products) of every anchor inside a range of scores.
Candidates come in buckets of vectors of similar length, longest first, and a bucket has one sorted
list of the unit vectors' values per coordinate. The threshold of an anchor is the smallest score that
can still enter one of its results: the lower end of the range, or the last of its k best so far. Over
the lengths it bounds the cosine from below, and with it the values that a candidate can have in one
coordinate, given the anchor's. The ranges of the anchor's largest coordinates (its focus) are cut out
of the sorted lists, their candidate sets are intersected, and only what is left is scored.

First the positives are searched (the nearest rows of the anchor's label), then, with their scores as
ranges, the negatives among the other labels.

Anchors are dealt into blocks and candidates into lanes by hashes of row numbers, so that no label or
id weighs on one task. Every block meets every lane through a shuffle on (block, lane) and streams its
rows from there: a task holds one block of anchors and one bucket, whatever the size of a lane, and
hands on k rows per search and lane. Nothing is broadcast or collected.

Defined cases: rows with a null id or label, or a vector that is null or holds a null or non-finite
component, take no part; only vectors of equal length have a score; rows with the anchor's id are its own
and neither positives nor negatives; of several anchor rows with one id that of the smallest label, then
vector, asks; other repeated rows are candidates each; ties go to the smaller id; an anchor without
others of its label has no positives and gives no rows. Scores that may not fit a long raise an error.
Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docmill.llm.common import stored

SCALE = 256
ANCHOR_ROWS = 4096  # anchors in one block
LANE_ROWS = 8192  # candidates in one lane, until there are MOST_LANES
MOST_LANES = 4096
BUCKET_ROWS = 2048
FOCUS = 4  # coordinates looked at per anchor
SALTS = 64
_FREE = np.iinfo(np.int64).min


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as double; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(broken, F.lit(False)), whole)


class Search:
    """One result list: the k best (score, smaller id first) with low <= score <= high."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = self.ids = np.empty(0, dtype=np.int64)

    @property
    def threshold(self) -> int:
        """The smallest score that can still enter."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` fall; equal ones are in the order of their ids."""
        begin = np.searchsorted(-scores, -self.high)
        end = np.searchsorted(-scores, -self.threshold, side="right")
        scores, ids = scores[begin:end][: self.k], ids[begin:end][: self.k]
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Anchor:
    def __init__(self, name: int, label: int, vector: np.ndarray, searches: list[Search]):
        self.name, self.label, self.vector, self.searches = name, label, vector, searches
        self.size = float(np.sqrt((vector.astype(float) ** 2).sum()))
        unit = vector / self.size if self.size else vector.astype(float)
        self.focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        self.angles = np.arccos(np.clip(unit[self.focus], -1, 1))

    @property
    def threshold(self) -> int:
        return min((s.threshold for s in self.searches), default=_FREE)

    @property
    def high(self) -> int:
        return max((s.high for s in self.searches), default=_FREE)


class Bucket:
    """Rows of similar length with the sorted list of every coordinate that is asked for."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.rows, self.ids, self.labels = rows, ids, labels
        sizes = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        self.longest, self.shortest = float(sizes.max()), float(sizes.min())
        self.unit = rows / np.where(sizes > 0, sizes, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self.lists:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self.lists[coordinate] = order, self.unit[order, coordinate]
        return self.lists[coordinate]

    def candidates(self, anchor: Anchor) -> np.ndarray | None:
        """Rows that may reach the anchor's threshold; None if all may."""
        threshold = anchor.threshold
        if threshold == _FREE or not anchor.size:
            return None if threshold <= 0 else np.empty(0, dtype=np.int64)
        length = self.longest if threshold > 0 else self.shortest
        if threshold > anchor.size * length * (1 + 1e-9):
            return np.empty(0, dtype=np.int64)
        if not length:  # rows of length 0 score 0, whatever their direction
            return None
        widest = np.arccos(np.clip(threshold / (anchor.size * length) - 1e-9, -1, 1))
        least = np.cos(np.minimum(np.pi, anchor.angles + widest)) - 1e-9
        most = np.where(anchor.angles <= widest, 1.0, np.cos(anchor.angles - widest)) + 1e-9
        ranges = []
        for coordinate, a, z in zip(anchor.focus.tolist(), least, most, strict=True):
            order, values = self.sorted_list(coordinate)
            found = order[np.searchsorted(values, a) : np.searchsorted(values, z, side="right")]
            if len(found) < len(order):
                ranges.append(found)
        if not ranges:
            return None
        met = np.zeros(len(self.rows), dtype=np.uint8)
        for found in ranges:
            met[found] += 1
        return np.flatnonzero(met == len(ranges))


def scored(bucket: Bucket, anchor: Anchor, scores: np.ndarray, rows: np.ndarray | None, same: bool) -> None:
    """Add exact ``scores`` of the bucket's ``rows`` (None: all) to the anchor's searches."""
    labels, ids = bucket.labels, bucket.ids
    if rows is not None:
        labels, ids = labels[rows], ids[rows]
    fits = (scores >= anchor.threshold) & (scores <= anchor.high) & (ids != anchor.name)
    fits &= (labels == anchor.label) == same
    at = np.flatnonzero(fits)
    if not len(at):
        return
    scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    for search in anchor.searches:
        search.add(scores, ids)


def search_bucket(bucket: Bucket, anchors: list[Anchor], same: bool) -> int:
    """Search one bucket for all anchors of its vector length; returns how many scores were taken."""
    count, whole = 0, []
    peak = int(np.abs(bucket.rows).max(initial=0))
    for anchor in anchors:
        rows = bucket.candidates(anchor)
        if rows is None:
            whole.append(anchor)
        elif len(rows):
            scored(bucket, anchor, _products(bucket.rows[rows], peak, anchor.vector[:, None])[:, 0], rows, same)
            count += len(rows)
    for at in range(0, len(whole), 256):
        part = whole[at : at + 256]
        products = _products(bucket.rows, peak, np.stack([a.vector for a in part], axis=1))
        for column, anchor in enumerate(part):
            scored(bucket, anchor, np.ascontiguousarray(products[:, column]), None, same)
        count += len(bucket.rows) * len(part)
    return count


def _products(rows: np.ndarray, peak: int, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point, which is faster, where every sum is exact."""
    most = peak * int(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if most >= 2**63:
        raise ValueError("scores may not fit a long")
    if most < 2**53:
        return (rows.astype(float) @ anchors.astype(float)).astype(np.int64)
    return rows @ anchors


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Rows of one kind in order, with (block, lane, kind): anchors (kind 0) whole, candidates in
    parts of at most BUCKET_ROWS."""
    held, key, rows = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in ("block", "lane", "kind")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(keys[start].tolist())
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held, rows = [], 0
            key = now
            while start < stop:
                take = stop - start if key[2] == 0 else min(stop - start, BUCKET_ROWS - rows)
                held.append(batch.slice(start, take))
                start, rows = start + take, rows + take
                if key[2] and rows == BUCKET_ROWS:
                    yield key, pa.Table.from_batches(held)
                    held, rows = [], 0
    if held:
        yield key, pa.Table.from_batches(held)


def _matrices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors for each vector length."""
    vectors = table["v"].combine_chunks()
    lengths = vectors.value_lengths().to_numpy()
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, np.asarray(values, dtype=np.int64).reshape(len(at), length)


def _scan(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    for _, parts in groupby(_buckets(batches), key=lambda part: part[0][:2]):
        anchors: dict[int, list[Anchor]] = {}
        for (_, _, kind), table in parts:
            ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
            for at, rows in _matrices(table):
                if kind == 0:
                    ranges = table["ranges"].take(pa.array(at)).to_pylist()
                    anchors[rows.shape[1]] = [
                        Anchor(name, label, row, [Search(r["low"], r["high"], k) for r in asked])
                        for name, label, row, asked in zip(ids[at].tolist(), labels[at].tolist(), rows, ranges, strict=True)
                    ]
                elif asking := anchors.get(rows.shape[1]):
                    search_bucket(Bucket(rows, ids[at], labels[at]), asking, same)
        for found in anchors.values():
            results = [(a.name, slot, s) for a in found for slot, s in enumerate(a.searches)]
            counts = [len(s.ids) for _, _, s in results]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([name for name, _, _ in results], dtype=np.int64), counts)),
                    pa.array(np.repeat(np.array([slot for _, slot, _ in results], dtype=np.int32), counts)),
                    pa.array(np.concatenate([s.ids for _, _, s in results])),
                    pa.array(np.concatenate([s.scores for _, _, s in results])),
                ], names=["anchor_id", "slot", "id", "score"])


def best_in_ranges(candidates: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``anchor_id``, ``slot``, ``rank``, ``id``, ``score``: for every range of an anchor the k best
    candidates inside it, of the anchor's label or of the others.

    ``candidates``: id, label, v (array of long). ``anchors``: the same, ids unique, and ``ranges``
    (array of low, high). Both have to be stored tables.
    """
    blocks = max(1, -(-anchors.count() // ANCHOR_ROWS))
    lanes = max(1, min(MOST_LANES, -(-candidates.count() // LANE_ROWS)))
    size = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    no_ranges = F.lit(None).cast("array<struct<low: long, high: long>>")

    def every(count: int, column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(column)

    def part(count: int, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    row = F.monotonically_increasing_id()
    asked = anchors.select("id", "label", "v", "ranges", part(blocks, F.col("id")).alias("block"), every(lanes, "lane"))
    pool = candidates.select("id", "label", "v", no_ranges.alias("ranges"), part(lanes, row).alias("lane"), size.alias("size"))
    pool = pool.select("id", "label", "v", "ranges", every(blocks, "block"), "lane", "size")
    met = (
        asked.withColumn("size", F.lit(0.0)).withColumn("kind", F.lit(0))
        .unionByName(pool.withColumn("kind", F.lit(1)))
        .repartition("block", "lane")
        .sortWithinPartitions("block", "lane", "kind", F.desc("size"))
        .select("block", "lane", "kind", "id", "label", "v", "ranges")
    )
    found = met.mapInArrow(
        lambda batches: _scan(batches, k, same_label), "anchor_id long, slot int, id long, score long"
    )
    order = [F.desc("score"), F.asc("id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy("anchor_id", "slot", "_salt").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(*order))
    kept = salted.withColumn("_near", first).where(F.col("_near") <= k)
    return kept.withColumn("rank", last).where(F.col("rank") <= k).drop("_salt", "_near")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   least: int = 30, most: int = 90, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | str = "label", scale: int = SCALE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``: for each anchor and each of its ``positives`` nearest rows of the same label,
    the ``negatives`` nearest rows of other labels whose score is from ``least`` to ``most`` per cent of
    the positive's. Labels are whole numbers."""
    label = F.col(label) if isinstance(label, str) else label
    usable = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        quantized(F.col(vector_col), scale).alias("v"), is_anchor.alias("asks"),
    )
    rows = stored(usable.where("id is not null and label is not null and v is not null"))
    pool = rows.select("id", "label", "v")
    asking = rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*")
    free = F.array(F.struct(F.lit(int(_FREE)).alias("low"), F.lit(int(np.iinfo(np.int64).max)).alias("high")))
    asking = stored(asking.withColumn("ranges", free))
    near = best_in_ranges(pool, asking, positives, same_label=True)
    near = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), "score"))).alias("near")
    )
    # low <= score <= high in whole numbers: the per cents of the positive's score rounded inwards
    low = lambda p: F.ceil(p["score"].cast("decimal(20,0)") * least / 100).cast("long")
    high = lambda p: F.floor(p["score"].cast("decimal(20,0)") * most / 100).cast("long")
    ranges = F.transform("near", lambda p: F.struct(low(p).alias("low"), high(p).alias("high")))
    asking = stored(asking.drop("ranges").join(near, "id").withColumn("ranges", ranges))
    found = best_in_ranges(pool, asking.drop("near"), negatives, same_label=False)
    slots = asking.select(F.col("id").alias("anchor_id"), F.posexplode("near").alias("slot", "positive"))
    return found.join(slots, ["anchor_id", "slot"]).select(
        "anchor_id", F.col("positive.positive_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
