"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

The candidates come in blocks; each block has one sorted list per dimension. A query walks its lists
in step, from the end that its sign prefers, scores every vector that it meets (random access) and
keeps its k best. The sum over the lists of what they yield at the present depth bounds all vectors
not met yet; once that bound is below the k-th result, the walk stops. The k best go on to the
task's next block, which a query often leaves at depth 0.

Queries come in batches of bounded size, each sent to the workers while the candidates are scanned
once; no vectors are shuffled, only k rows per query and task.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows with a null
id take no part; a candidate of another length than the query's has no score; rows with the query's
id are the query's own and no candidates; repeated query rows count once (by id); repeated candidate
rows are candidates each; ties go to the smaller id. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

SCALE = 1024
QUERY_VALUES = 2 << 20  # components of the queries in one batch: 16 MB
BLOCK_VALUES = 1 << 19  # components of one candidate block
FIRST_DEPTH = 16
SALTS = 64


def quantized(vector: Column) -> Column:
    """floor(1024 * x) of each component x as double; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(broken, F.lit(False)), whole)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0, dtype=np.int64)] * queries
        self.ids = [np.empty(0, dtype=np.int64)] * queries

    def floor(self, query: int):
        """Score of the k-th result, None before there are k."""
        return self.scores[query][-1] if len(self.scores[query]) == self.k else None

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[query], scores])
        ids = np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


def search_block(queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, best: Best,
                 slots: np.ndarray) -> int:
    """Threshold algorithm for every query over one block; returns how many scores were computed.
    ``slots`` are the queries' places in ``best``."""
    n, dims = block.shape
    order = np.argsort(block, axis=0, kind="stable")
    rising = np.take_along_axis(block, order, axis=0)
    depths = []
    depth = 0
    while depth < n:
        depths.append(depth)
        depth = depth * 4 if depth else FIRST_DEPTH
    # bound of all vectors not met after `depth` entries of each list, for each query
    highs, lows = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = rising[[n - 1 - d for d in depths]] @ highs.T + rising[depths] @ lows.T
    scored = 0
    for q in range(len(queries)):
        query, slot = queries[q], slots[q]
        used = np.flatnonzero(query)  # a list of weight 0 adds nothing to any score
        up, down = used[query[used] > 0], used[query[used] < 0]
        met = np.zeros(n, dtype=bool)
        for step, depth in enumerate(depths):
            floor = best.floor(slot)
            if floor is not None and bounds[step, q] < floor:
                break
            until = depths[step + 1] if step + 1 < len(depths) else n
            new = np.zeros(n, dtype=bool)
            if until == n or not len(used):
                new[:] = True
            else:
                new[order[n - until : n - depth, up].ravel()] = True
                new[order[depth:until, down].ravel()] = True
            new &= ~met
            met |= new
            found = np.flatnonzero(new)
            found = found[ids[found] != own[q]]
            scored += len(found)
            best.add(slot, block[found] @ query, ids[found])
            if new.all() or until == n:
                break
    return scored


def _numbers(rows: pa.Array, length: int) -> np.ndarray:
    return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, length)


def _exact(block: np.ndarray, queries: np.ndarray) -> bool:
    """Whether inner products are exact in floating point, where multiplication is much faster."""
    most = int(np.abs(block).max(initial=0)) * int(np.abs(queries).max(initial=0))
    return 0 <= most and most * max(1, block.shape[1]) < 2**53


def _scan(batches: Iterator[pa.RecordBatch], query_ids, vectors, k: int):
    lengths = {}
    for slot, vector in enumerate(vectors):
        lengths.setdefault(len(vector), []).append(slot)
    groups = {
        length: (np.array(slots), np.array([vectors[s] for s in slots], dtype=np.int64).reshape(-1, length))
        for length, slots in lengths.items()
    }
    best = Best(len(vectors), k)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        values = batch.column(1)
        sizes = values.value_lengths().to_numpy(zero_copy_only=False)
        for length, (slots, queries) in groups.items():
            rows = np.flatnonzero(sizes == length)
            if not len(rows):
                continue
            block = _numbers(values.take(pa.array(rows)), length)
            step = max(1, BLOCK_VALUES // max(1, length))
            for at in range(0, len(rows), step):
                part, own = block[at : at + step], query_ids[slots]
                if _exact(part, queries):
                    search_block(queries.astype(float), own, part.astype(float), ids[rows[at : at + step]], best, slots)
                else:
                    search_block(queries, own, part, ids[rows[at : at + step]], best, slots)
    counts = [len(x) for x in best.ids]
    if sum(counts):
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(query_ids, counts)),
            pa.array(np.concatenate(best.ids)),
            pa.array(np.concatenate(best.scores).astype(np.int64)),
        ], names=["query_id", "vec_id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", query_values: int = QUERY_VALUES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best candidates but its own row."""
    spark = candidates.sparkSession

    def usable(df):
        made = df.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col)).alias("v"))
        return made.where("id is not null and v is not null")

    pool = usable(candidates)
    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v")).toLocalIterator(prefetchPartitions=False)
    parts = []
    while batch := _batch(asked, query_values):
        sent = spark.sparkContext.broadcast(
            (np.array([row[0] for row in batch], dtype=np.int64), [row[1] for row in batch])
        )

        def scan(batches, sent=sent):
            return _scan(batches, *sent.value, k)

        parts.append(pool.mapInArrow(scan, "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.unionAll, parts)
    order = [F.desc("score"), F.asc("vec_id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    kept = salted.withColumn("_near", first).where(F.col("_near") <= k)
    ranked = kept.withColumn("rank", last).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _batch(rows, values: int) -> list:
    """The next rows whose vectors have about ``values`` components, at least one."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[1]) + 1
        if held >= values:
            break
    return out
