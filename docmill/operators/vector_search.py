"""Exact nearest chunks by cosine similarity for a whole batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.ranking import top_per_key

QUERY_ROWS = 4096  # most queries sent to every executor: 48 MiB at 1,536 components
QUERY_BLOCK = 512  # queries multiplied at a time inside a task
CHUNK_BLOCK = 50_000  # chunks per group on the shuffled path
DIGITS = 12  # similarities are rounded so that ranks do not depend on batch boundaries


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.full_like(rows, np.nan), where=size > 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(sims: np.ndarray, ids: np.ndarray, k: int, threshold: float):
    """(row, query) pairs that can be among the ``k`` best of their query, ties included."""
    floor = np.full(sims.shape[1], threshold)
    if len(sims) > k:
        ranked = np.where(np.isnan(sims), -np.inf, sims)
        kth = np.partition(ranked, len(sims) - k, axis=0)[len(sims) - k]
        floor = np.maximum(floor, kth)
    return np.nonzero(sims >= floor)  # NaN compares false


def _prune(query: np.ndarray, sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows per query: similarity down, then id up."""
    order = np.lexsort((ids, -sim, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[place < k]


def _sortable(ids) -> np.ndarray:
    values = np.asarray(ids)
    return values.astype(str) if values.dtype == object else values


def vector_candidates(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    threshold: float = 0.0,
    carry: list[str] = (),
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``(query_id, chunk_id, *carry, similarity)``: at most ``k`` rows per query and task,
    always holding the overall first ``k``.

    Up to ``query_rows`` query vectors are sent to the executors; chunks
    are then only scanned, never shuffled. A larger batch is cut into blocks of queries and
    blocks of chunks that meet in groups of bounded size, which sends every chunk once for each
    block of queries. Both ways give the same rows.
    """
    wanted = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    rows = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", *carry, "embedding")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    query_type = wanted.schema["query_id"].dataType.simpleString()
    schema = ", ".join(
        [f"query_id {query_type}"]
        + [f"{c} {fields[c]}" for c in ("chunk_id", *carry)]
        + ["similarity double"]
    )
    kept = ["chunk_id", *carry]

    head = wanted.limit(query_rows + 1).toPandas()
    if len(head) <= query_rows:
        matrix = (
            _unit(np.stack(head["embedding"]).astype(np.float64))
            if len(head) else np.zeros((0, 1))
        )
        shared = queries.sparkSession.sparkContext.broadcast((head["query_id"].to_numpy(), matrix))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            held = None
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                table = pa.Table.from_batches([batch])
                unit = _unit(_matrix(table["embedding"]))
                ids = _sortable(table["chunk_id"].to_numpy())
                for at in range(0, len(names), QUERY_BLOCK):
                    sims = np.round(unit @ vectors[at : at + QUERY_BLOCK].T, DIGITS)
                    row, query = _best(sims, ids, k, threshold)
                    part = (query + at, sims[row, query], table.select(kept).take(row))
                    held = part if held is None else (
                        np.concatenate([held[0], part[0]]),
                        np.concatenate([held[1], part[1]]),
                        pa.concat_tables([held[2], part[2]]),
                    )
                if len(held[0]) > 2 * k * len(names):
                    held = shrink(held)
            if held is not None and len(held[0]):
                query, sim, table = shrink(held)
                table = table.combine_chunks()
                arrays = [pa.array(names[query])] + [table[c].combine_chunks() for c in kept]
                arrays.append(pa.array(sim))
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", *kept, "similarity"])

        def shrink(held):
            keep = _prune(held[0], held[1], _sortable(held[2]["chunk_id"].to_numpy()), k)
            return held[0][keep], held[1][keep], held[2].take(keep)

        return rows.mapInArrow(scan, schema)

    query_count, chunk_count = wanted.count(), rows.count()
    query_blocks = -(-query_count // query_rows)
    chunk_blocks = max(1, -(-chunk_count // CHUNK_BLOCK))

    def blocked(df: DataFrame, id_col: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))
        )

    left = blocked(wanted, "query_id", "_q", query_blocks, "_c", chunk_blocks)
    right = blocked(rows, "chunk_id", "_c", chunk_blocks, "_q", query_blocks)

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            unit = _unit(np.stack(c["embedding"]).astype(np.float64))
            ids = _sortable(c["chunk_id"].to_numpy())
            for at in range(0, len(q), QUERY_BLOCK):
                block = q.iloc[at : at + QUERY_BLOCK]
                vectors = _unit(np.stack(block["embedding"]).astype(np.float64))
                sims = np.round(unit @ vectors.T, DIGITS)
                row, query = _best(sims, ids, k, threshold)
                sim = sims[row, query]
                keep = _prune(query, sim, ids[row], k)
                part = c.iloc[row[keep]][kept].reset_index(drop=True)
                part.insert(0, "query_id", block["query_id"].to_numpy()[query[keep]])
                part["similarity"] = sim[keep]
                found.append(part)
        if not found:
            return pd.DataFrame(columns=["query_id", *kept, "similarity"])
        return pd.concat(found)

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInPandas(meet, schema)


def vector_leg(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    threshold: float = 0.0,
    carry: list[str] = (),
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` nearest chunks per query with their rank; ties go to the smaller id."""
    near = vector_candidates(queries, chunks, k, threshold, carry, query_rows)
    return top_per_key(
        near,
        ["query_id"],
        [F.col("similarity").desc(), F.col("chunk_id")],
        k,
        salt=F.col("chunk_id"),
    )


def vector_search(
    queries: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    k: int = 10,
    threshold: float = 0.0,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Nearest chunks with their text and document, best first per query. ``vectors`` (chunk_id,
    document_id, embedding) are the chunks' vectors if ``chunks`` does not hold them."""
    from docmill.operators.search import attach_chunks, is_small

    found = vector_leg(queries, chunks if vectors is None else vectors, k, threshold, ["document_id"])
    return attach_chunks(found, chunks, docs, is_small(queries, k))
