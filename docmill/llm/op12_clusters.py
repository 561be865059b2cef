"""Centroid clustering of integer vectors with Shallot search: exact rounds that skip most distances.

Every vector remembers its centroid and the second nearest one, an upper bound of the distance to the
first and a lower bound of the distance to all others. When centroids move, the bounds are widened
by how far. A vector whose upper bound stays below the lower one, or below half the way from its
centroid to the next, keeps its centroid without any distance. Otherwise the distances to the two
remembered centroids are taken, and the other centroids are looked through from the closer of the two,
in the order of their distance to it: none outside the ball of radius d1 + d2 around it can come
before the second nearest, and the ball shrinks whenever a closer second is found. What lies in the
ball is compared by squared distances in integers, equal ones by number.

One job a round scans the vectors, which stay where they are, and writes them with their new bounds;
the file of the round before is then removed. Only the componentwise sums of each cluster are shuffled, added up on
the map side; k centroids pass through the driver, whatever the size of the table.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take
no part; a null id counts as the empty text in the draw of the first centroids; of equal ids the
smaller vector is drawn first; repeated rows are vectors each; fewer vectors than ``k`` are centroids
all; an empty table gives no rows. Components of 2**27 or more in size raise an error, as a squared
distance has to fit a long. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill.llm.common import release, stored

SCALE = 256
LARGEST = 1 << 27
MOST_CENTROIDS = 4096
BLOCK = 4096  # vectors compared at once
_WIDER = 1 + 1e-12  # room for rounding in bounds
_STATE = "cluster int, second int, upper double, lower double, distance long"


def quantized(vector: Column, length: int, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as double; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) == length) & ~F.coalesce(broken, F.lit(False)), whole)


@dataclass
class Centroids:
    """``points`` (k x d), how far each moved since the round before, and the others of each
    centroid by distance."""

    points: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.points)
        square = np.array([squared(self.points, p) for p in self.points], dtype=np.int64).reshape(k, k)
        self.near = np.argsort(square, axis=1, kind="stable")
        itself = self.near == np.arange(k)[:, None]
        self.near = self.near[~itself].reshape(k, k - 1)
        self.gap = np.sqrt(np.take_along_axis(square, self.near, axis=1).astype(float))
        self.half = self.gap[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        rank = np.argsort(-self.moved, kind="stable")
        # the farthest move among the other centroids
        self.others = np.full(k, self.moved[rank[0]])
        self.others[rank[0]] = self.moved[rank[1]] if k > 1 else 0.0


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances in integers; ``point`` is one vector or one per row."""
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


class Assignment:
    """State of the vectors of a batch: centroid, second nearest, bounds."""

    def __init__(self, rows: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.rows, self.cluster, self.second, self.upper, self.lower = rows, cluster, second, upper, lower
        self.compared = 0

    @classmethod
    def unknown(cls, rows: np.ndarray, k: int) -> Assignment:
        n = len(rows)
        zero = np.zeros(n, dtype=np.int64)
        return cls(rows, zero, zero + min(1, k - 1), np.full(n, np.inf), np.zeros(n))

    def update(self, to: Centroids) -> None:
        """Nearest centroid of every vector after the centroids have moved."""
        self.upper = (self.upper + to.moved[self.cluster]) * _WIDER
        self.lower = np.maximum(0.0, self.lower - to.others[self.cluster]) / _WIDER
        bound = np.maximum(self.lower, to.half[self.cluster] / _WIDER)
        open_ = np.flatnonzero(self.upper >= bound)
        if not len(open_):
            return
        exact = np.sqrt(squared(self.rows[open_], to.points[self.cluster[open_]]).astype(float)) * _WIDER
        self.upper[open_] = exact
        self.compared += len(open_)
        open_ = open_[exact >= bound[open_]]
        if not len(open_) or len(to.points) == 1:
            return
        self._search(open_, to)

    def _search(self, which: np.ndarray, to: Centroids) -> None:
        rows = self.rows[which]
        first, second = self.cluster[which], self.second[which]
        d1, d2 = squared(rows, to.points[first]), squared(rows, to.points[second])
        self.compared += len(which)
        swap = (d2 < d1) | ((d2 == d1) & (second < first))
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, known = first.copy(), second.copy()
        origin = np.sqrt(d1.astype(float))
        for centre in np.unique(start):
            group = np.flatnonzero(start == centre)
            for other, gap in zip(to.near[centre], to.gap[centre], strict=True):
                ball = (origin[group] + np.sqrt(d2[group].astype(float))) * _WIDER
                group = group[gap <= ball]
                if not len(group):
                    break
                ask = group[known[group] != other]
                found = squared(rows[ask], to.points[other])
                self.compared += len(ask)
                best = (found < d1[ask]) | ((found == d1[ask]) & (other < first[ask]))
                next_ = ~best & ((found < d2[ask]) | ((found == d2[ask]) & (other < second[ask])))
                won = ask[best]
                second[won], d2[won] = first[won], d1[won]
                first[won], d1[won] = other, found[best]
                second[ask[next_]], d2[ask[next_]] = other, found[next_]
        self.cluster[which], self.second[which] = first, second
        self.upper[which] = np.sqrt(d1.astype(float)) * _WIDER
        self.lower[which] = np.sqrt(d2.astype(float)) / _WIDER


def _matrix(values: pa.Array, length: int) -> np.ndarray:
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, length)


def _assigned(vectors: DataFrame, to: Centroids, length: int, known: bool) -> DataFrame:
    """``vectors`` with the state after a round; without ``known`` there is none before it."""
    sent = vectors.sparkSession.sparkContext.broadcast(to)
    names = [f.strip().split()[0] for f in _STATE.split(",")]
    schema = T.StructType([f for f in vectors.schema if f.name not in names] + list(T._parse_datatype_string(_STATE)))

    def work(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                rows = _matrix(batch.column("v"), length)
                if known:
                    parts = [batch.column(n).to_numpy(zero_copy_only=False) for n in names[:4]]
                    state = Assignment(rows, *(p.astype(t) for p, t in zip(parts, ["i8", "i8", "f8", "f8"], strict=True)))
                else:
                    state = Assignment.unknown(rows, len(sent.value.points))
                state.update(sent.value)
                apart = squared(rows, sent.value.points[state.cluster])
                made = [state.cluster, state.second, state.upper, state.lower, apart]
                kept = [batch.column(f.name) for f in schema if f.name not in names]
                arrays = [a.cast(f.type) for a, f in zip(kept, arrow, strict=False)]
                arrays += [pa.array(m).cast(f.type) for m, f in zip(made, list(arrow)[len(kept):], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return vectors.mapInArrow(work, schema)


def _summary(assigned: DataFrame, length: int) -> dict[int, tuple[int, int, list[int]]]:
    """Rows, summed distance and summed components of each cluster: at most k rows."""
    sums = [F.sum(F.col("v")[i]) for i in range(length)]
    found = assigned.groupBy("cluster").agg(F.count(F.lit(1)), F.sum("distance"), F.array(*sums))
    return {row[0]: (row[1], row[2], list(row[3])) for row in found.collect()}


def cluster(vectors: DataFrame, k: int, rounds: int, length: int, id_col: str = "vec_id",
            vector_col: str = "embedding", scale: int = SCALE, seed: str = "2") -> DataFrame:
    """``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` (array
    of long) of every vector that takes part, after ``rounds`` rounds and a last assignment.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k has to be from 1 to {MOST_CENTROIDS}")
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col), quantized(F.col(vector_col), length, scale).alias("v"))
    state = stored(usable.where("v is not null"))
    outside = F.exists("v", lambda x: (x >= LARGEST) | (x <= -LARGEST))
    if not state.where(outside).isEmpty():
        raise ValueError(f"components have to stay below {LARGEST} in size")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = state.select("v", F.sha2(text, 256).alias("_hash")).orderBy("_hash", "v").limit(k).collect()
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, " \
             "cluster_inertia long, inertia long, centroid array<long>"
    if not drawn:
        return spark.createDataFrame([], schema)
    points = np.array([row.v for row in drawn], dtype=np.int64).reshape(-1, length)
    moved = np.zeros(len(points))
    for number in range(rounds + 1):
        after = stored(_assigned(state, Centroids(points, moved), length, known=number > 0))
        release(state)
        state = after
        sums = _summary(state, length)
        if number < rounds:
            new = points.copy()
            for c, (rows, _, total) in sums.items():
                new[c] = [x // rows for x in total]
            moved = np.sqrt(squared(new, points).astype(float)) * _WIDER
            points = new
    whole = sum(distance for _, distance, _ in sums.values())
    rows = [(c, distance, whole, points[c].tolist()) for c, (_, distance, _) in sums.items()]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    found = state.join(F.broadcast(totals), "cluster")
    return found.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
