"""Sharding by Karmarkar-Karp differencing: groups that must stay together, near-equal bytes.

A partial partition has one sum for each shard. The two of largest spread are joined again and again,
the largest part of one with the smallest of the other, until one is left.

Groups are dealt into bundles by the bits of their hash. The bundles' sums, a bounded number, are
differenced as if each bundle were one group; groups larger than a usual bundle are taken out of
theirs and differenced for themselves. Only the lightest bundles, one for each shard, are held back.
Those are opened: the smaller bundles in them are differenced together with the partition so far,
which they even out, and so on until what is held back is few enough to be differenced group by
group. No level handles more than ``2 * shards * 2 ** BITS`` sums. Rows find their shard by their hash
in tables of that size; texts are not shuffled.

Defined cases: texts are one group if they are equal; null texts are one group of their own; a
row's size is the UTF-8 bytes of its text (a null has none) plus one; the checksum of a null text
is null; repeated rows are rows like any other and each gets a slot; an empty table gives no rows.
Other columns of the input take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docmill.llm.common import stored

BITS = 11  # bundles in a bundle: 2 ** BITS
LEVELS = 5
FEW = 8_192  # groups that are differenced one by one
SLICE = 20_000  # rows that are numbered in one task


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions (one row each, ``k`` part sums): for every row the
    part of the whole that each of its parts went to, and the sums of the whole."""
    count, k = sums.shape
    parent: list[int] = []
    turn: list[np.ndarray] = []  # where a node's parts went in its parent

    def add(parts):
        parent.append(-1)
        turn.append(None)
        return [-int(parts.max() - parts.min()), len(parent) - 1, parts]

    heap = [add(row) for row in sums.astype(np.int64)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        falling, rising = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        node = add(a[falling] + b[rising])
        for child, order in ((left, falling), (right, rising)):
            place = np.empty(k, dtype=np.int64)
            place[order] = np.arange(k)
            parent[child], turn[child] = node[1], place
        heapq.heappush(heap, node)
    final: list[np.ndarray] = [np.arange(k)] * len(parent)
    for node in range(len(parent) - 2, -1, -1):  # parents come after their children
        final[node] = final[parent[node]][turn[node]]
    return np.array(final[:count]).reshape(count, k), heap[0][2]


def _bundle(level: int, bits: int) -> Column:
    """The bundle of a group at a level, from 1 on: the low bits of its hash."""
    return F.xxhash64("group").bitwiseAND(F.lit((1 << (bits * level)) - 1).cast("long"))


class Plan:
    """Parts of the bundles of each level and of the groups differenced one by one."""

    def __init__(self, shards: int):
        self.shards = shards
        self.sums = np.zeros(shards, dtype=np.int64)
        self.levels: list[tuple[Column, list, np.ndarray]] = []

    def place(self, *items: tuple[Column, list, list[int]]) -> None:
        """Difference items, given as (key, names, sizes), together with the partition so far. Where
        a row fits items of two keys, the first counts."""
        sizes = [n for _, _, part in items for n in part]
        rows = np.zeros((len(sizes) + 1, self.shards), dtype=np.int64)
        rows[0], rows[1:, 0] = self.sums, sizes
        places, self.sums = difference(rows)
        self.levels = [(k, n, places[0][parts]) for k, n, parts in self.levels]
        at = 1
        for key, names, _ in items:
            self.levels.append((key, names, places[at : at + len(names), 0]))
            at += len(names)

    def apply(self, rows: DataFrame) -> DataFrame:
        """Add ``shard``. The tables have a bounded number of rows."""
        found = []
        for at, (key, names, parts) in enumerate(self.levels):
            if not names:
                continue
            kind = "string" if isinstance(names[0], str) else "long"
            table = [(name, int(part)) for name, part in zip(names, parts, strict=True)]
            table = rows.sparkSession.createDataFrame(table, f"_key{at} {kind}, _part{at} int")
            rows = rows.withColumn(f"_key{at}", key).join(F.broadcast(table), f"_key{at}", "left").drop(f"_key{at}")
            found.append(f"_part{at}")
        return rows.withColumn("shard", F.coalesce(*found) if found else F.lit(0)).drop(*found)


def plan(rows: DataFrame, shards: int, bits: int = BITS, few: int = FEW) -> Plan:
    """Plan for rows with ``group`` (string) and ``size`` (long)."""
    made, open_, level = Plan(shards), rows, 0
    groups = rows.count()
    while groups > few and level < LEVELS:
        level += 1
        key = _bundle(level, bits)
        sums = {r["bundle"]: r["bytes"] for r in
                open_.groupBy(key.alias("bundle")).agg(F.sum("size").alias("bytes")).collect()}
        usual = sum(sums.values()) / len(sums)
        heavy = {bundle for bundle, n in sums.items() if n > 1.5 * usual}
        inside = open_.where(key.isin(list(heavy))).groupBy("group", key.alias("bundle")).agg(F.sum("size").alias("bytes"))
        large = inside.where(F.col("bytes") > usual).orderBy("group").collect()  # at most a bundle's number
        for row in large:
            sums[row["bundle"]] -= row["bytes"]
        light = sorted((n, bundle) for bundle, n in sums.items() if bundle not in heavy)
        held = [bundle for _, bundle in light[:shards]]
        rest = sorted(set(sums) - set(held))
        made.place(
            (F.col("group"), [r["group"] for r in large], [r["bytes"] for r in large]),
            (key, rest, [sums[b] for b in rest]),
        )
        open_ = open_.where(key.isin(held))
        groups = open_.select("group").distinct().count()
    last = open_.groupBy("group").agg(F.sum("size").alias("bytes")).orderBy("group").collect()
    made.place((F.col("group"), [r["group"] for r in last], [r["bytes"] for r in last]))
    return made


def shard(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    bits: int = BITS, few: int = FEW, rows_per_slice: int = SLICE,
) -> DataFrame:
    """Every row with its ``shard`` and its ``slot``, gapless from 0 in each shard. Rows of equal
    text share a shard, and the shards' bytes are near equal. Slots are numbered in slices dealt by
    row, not by group, so that a frequent text is not numbered in one task."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("group"),
    )
    rows = stored(rows)
    slices = max(1, -(-rows.count() // rows_per_slice))
    spread = F.pmod(F.xxhash64("doc_id", "group"), F.lit(slices))
    placed = stored(plan(rows, shards, bits, few).apply(rows).withColumn("_slice", spread))
    sizes = placed.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_slice").orderBy("doc_id", "group")
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(bases, ["shard", "_slice"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_base") + F.col("_at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
