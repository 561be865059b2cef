"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set of five-word shingles is sketched in rounds: in round i every shingle falls into
one hashed bin with value i plus a hash fraction, and a bin keeps its smallest value. After the
first half of the rounds any bin still empty gets a round in which all shingles fall into it, so
every coordinate fills and the share of equal coordinates concentrates around the similarity. Four
coordinates make a band; 32 bands miss a pair at the threshold with probability below 1e-5.

Equal sets are one node from the start. Within a bucket of equal bands no pairs are listed: every
member is compared with the bucket's first one, in large buckets with further pivots, and verified
links join components. What is left are members outside their bucket's largest component; these meet
the members of other components, chunk by block, in tasks of bounded size that give only the links
that join components. Every link is confirmed on the full sets, which are made again from the texts
of documents that share a bucket.

Defined cases: null and empty texts, and texts without words, have an empty set and link with
nothing; fewer than five words are one shingle; rows with equal ids and different texts are separate
nodes; a component's id is its smallest non-null doc_id; equal rows are one node and get equal
results. Other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docmill.llm.common import stored, text_batches
from docmill.llm.components import components

WORDS = 5
COORDINATES = 128
ROWS = 4  # coordinates in a band
PERCENT = 75
#: A pair at the threshold is below this share of equal coordinates with probability 1e-7.
LEAST_AGREEMENT = 0.55
BLOCK = 512  # members of a bucket that are compared with each other in one task
PIVOT_ROUNDS = 2
BATCH = 1 << 19  # bytes of text sketched at a time
KNOWN = 1 << 18  # words whose hashes a task remembers
_VALUE_BITS = 40
_M1, _M2, _GOLDEN = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit shingle hashes of a text given as bytes."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words = words
        digest = xxhash.xxh3_64_intdigest

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= KNOWN:
                    self.clear()
                value = digest(word)
                if len(word) <= 64:
                    self[word] = value
                return value

        self.known = Known()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.words, len(h))
        count = len(h) - size + 1
        shingle = np.full(count, size, dtype=np.uint64)
        for i in range(size):
            shingle = _mix(shingle * _GOLDEN + h[i : i + count])
        return np.unique(shingle)


def sketches(sets: list[np.ndarray], size: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of each non-empty set: one row of ``size`` coordinates."""
    full = np.uint64(2**64 - 1)
    if not sets:
        return np.empty((0, size), dtype=np.uint64)
    out = np.full(len(sets) * size, full, dtype=np.uint64)
    todo = np.arange(len(sets))
    lengths = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    owner = np.repeat(todo, lengths)
    for turn in range(2 * size):
        x = _mix(items + np.uint64((turn + 1) * int(_GOLDEN) % 2**64))
        value = (x & np.uint64(2**_VALUE_BITS - 1)) | (np.uint64(turn) << np.uint64(_VALUE_BITS))
        if turn < size:
            place = ((x >> np.uint64(_VALUE_BITS)) * np.uint64(size)) >> np.uint64(64 - _VALUE_BITS)
            place = place.astype(np.int64)
        else:
            place = turn - size
        np.minimum.at(out, owner * size + place, value)
        open_ = (out.reshape(-1, size)[todo] == full).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            todo = todo[open_]
            still = np.zeros(len(sets), dtype=bool)
            still[todo] = True
            keep = still[owner]
            items, owner = items[keep], owner[keep]
    return out.reshape(-1, size)


def _sketch_rows(batches, arrow):
    shingler = Shingler()
    for batch in text_batches(batches, 2_000, BATCH):
        sets = [shingler(text.as_py()) for text in batch.column(1)]
        some = [i for i, s in enumerate(sets) if len(s)]
        sketch = sketches([sets[i] for i in some])
        key = np.arange(COORDINATES // ROWS, dtype=np.uint64)[None, :] * _GOLDEN
        for i in range(ROWS):
            key = _mix(key + sketch[:, i::ROWS]) if i else _mix(key + sketch[:, ::ROWS])
        short = sketch.astype(np.uint16)
        rows = {i: at for at, i in enumerate(some)}
        yield pa.RecordBatch.from_arrays([
            batch.column(0).cast(arrow.field(0).type),
            pa.array([len(s) for s in sets], type=pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                     type=arrow.field(2).type),
            pa.array([key[rows[i]].view(np.int64) if i in rows else None for i in range(len(sets))],
                     type=arrow.field(3).type),
            pa.array([short[rows[i]].tobytes() if i in rows else None for i in range(len(sets))],
                     type=arrow.field(4).type),
        ], schema=arrow)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and short coordinates of every row."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("short", T.BinaryType()),
    ])
    return _python(docs, id_col, text_col, schema, _sketch_rows)


def _set_rows(batches, arrow):
    shingler = Shingler()
    for batch in text_batches(batches, 2_000, BATCH):
        sets = [shingler(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                     type=arrow.field(0).type),
            pa.array([s.view(np.int64) for s in sets], type=arrow.field(1).type),
        ], schema=arrow)


def _python(docs, id_col, text_col, schema, rows) -> DataFrame:
    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return rows(batches, to_arrow_schema(schema))

    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    return source.mapInArrow(work, schema)


@F.pandas_udf(T.DoubleType())
def _agreement(a, b):
    import pandas as pd

    left = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), -1)
    right = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), -1)
    return pd.Series((left == right).mean(axis=1) if len(a) else [], dtype=float)


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    short = nodes.select("node", "short")
    return (
        pairs.join(short.toDF("a", "short_a"), "a").join(short.toDF("b", "short_b"), "b")
        .where(_agreement("short_a", "short_b") >= LEAST_AGREEMENT).select("a", "b")
    )


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and shingles of the ``wanted`` nodes (node, doc_id, digest), made again from the texts of
    their documents only."""
    ids = wanted.select(F.col("doc_id").alias("_wanted")).distinct()
    texts = docs.join(ids, docs[id_col].eqNullSafe(ids["_wanted"]), "leftsemi")
    schema = T.StructType([T.StructField("digest", T.BinaryType()),
                           T.StructField("shingles", T.ArrayType(T.LongType()))])
    made = _python(texts, id_col, text_col, schema, _set_rows)
    made = made.join(wanted.select("digest", "node"), "digest")
    return stored(made.select("node", "shingles").dropDuplicates(["node"]))


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with enough in common, compared on the full sets."""
    both = _promising(pairs, nodes).join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - F.col("_common")
    return stored(
        both.withColumn("_common", common).where(100 * F.col("_common") >= percent * union).select("a", "b")
    )


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the labels that the links connect."""
    if labels is None:
        return stored(components(links))
    old = labels.select("node", "label")
    ends = links
    for end in ("a", "b"):
        ends = ends.join(old.toDF(end, f"_{end}"), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    step = stored(components(ends).select(F.col("node").alias("label"), F.col("label").alias("_to")))
    moved = old.join(step, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    fresh = step.select(F.col("label").alias("node"), F.col("_to").alias("label"))
    return stored(moved.unionAll(fresh.join(old, "node", "leftanti")))


def _open(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that lie in several components, with the bucket's size ``n``, the number
    ``rest`` of members outside its largest component, and the pivot and label of that and of the
    rest."""
    placed = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    parts = placed.groupBy("bucket", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("one")
    )
    buckets = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"),
        F.max(F.struct("n", "label", F.col("one.node").alias("node"))).alias("top"),
    ).where("parts > 1")
    second = parts.join(buckets.select("bucket", F.col("top.label").alias("major")), "bucket")
    second = second.where("label <> major").groupBy("bucket").agg(
        F.min(F.struct("one.h", "one.node", "label")).alias("two")
    )
    buckets = buckets.join(second, "bucket").select(
        "bucket", "n", (F.col("n") - F.col("top.n")).alias("rest"), F.col("top.node").alias("p1"),
        F.col("top.label").alias("l1"), F.col("two.node").alias("p2"), F.col("two.label").alias("l2"),
    )
    return stored(placed.join(buckets, "bucket"))


def _pivot_pairs(open_: DataFrame) -> DataFrame:
    first = open_.where("label <> l1").select("p1", "node").toDF("a", "b")
    rest = open_.where("label <> l2").select("p2", "node").toDF("a", "b")
    return first.unionAll(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(open_: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between members of different components of a bucket. The members outside the largest
    component, in chunks, meet all members, in blocks; a task holds one chunk and one block. It gives
    links that join components, at most one for each member."""
    rows = open_.withColumn("_chunks", F.ceil(F.col("rest") / block)).withColumn("_blocks", F.ceil(F.col("n") / block))
    minor = F.col("label") != F.col("l1")
    several = (F.col("_chunks") > 1) | (F.col("_blocks") > 1)
    columns = ["bucket", "_chunk", "_block", "_left", "node", "label"]
    right = rows.withColumn("_block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks")))
    right = right.withColumn("_left", minor & ~several).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))
    )
    left = rows.where(minor & several).withColumn("_chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("_chunks")))
    left = left.withColumn("_left", F.lit(True)).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    )
    sent = right.select(*columns, F.lit(True).alias("_right")).unionAll(left.select(*columns, F.lit(False)))
    sent = sent.join(sets, "node")

    def work(table: pa.Table) -> pa.Table:
        a, b = _compare(
            table.column("node").to_numpy(), table.column("label").to_numpy(),
            table.column("_left").to_numpy(), table.column("_right").to_numpy(),
            table.column("shingles").combine_chunks(), percent,
        )
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(sent.groupBy("bucket", "_chunk", "_block").applyInArrow(work, "a long, b long").distinct())


def _compare(nodes, labels, left, right, sets, percent) -> tuple[list, list]:
    """Links from the left rows to right rows of other labels, while labels are joined."""
    if isinstance(sets, pa.ChunkedArray):
        sets = pa.concat_arrays(sets.chunks)
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, flat = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label = labels.copy()
    rows = np.flatnonzero(right)
    ends = np.concatenate([flat[starts[r] : starts[r] + sizes[r]] for r in rows])
    begins = np.cumsum(sizes[rows]) - sizes[rows]
    seen = np.zeros(len(flat) + 1, dtype=np.int32)
    a, b = [], []
    for i in np.flatnonzero(left):
        open_ = label[rows] != label[i]
        if not open_.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        seen[own] = 1
        common = np.add.reduceat(seen[ends], begins)
        seen[own] = 0
        near = open_ & (100 * common >= percent * (sizes[i] + sizes[rows] - common))
        for j in rows[near]:
            if label[j] != label[i]:
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
                label[label == label[j]] = label[i]
    return a, b


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable), ``kept``."""
    rows = stored(sketched(docs, id_col, text_col))
    filled = rows.where("digest is not null")
    nodes = stored(
        filled.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("bands", "short")).alias("_one"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "doc_id", "_one.*")
    )
    labels = _labels(docs, nodes, id_col, text_col, percent, block)
    ids = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").select(
        "digest", "doc_id", F.coalesce("label", "node").alias("label")
    )
    smallest = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(smallest, "label").select("digest", "component_id")
    found = filled.select("doc_id", "n_shingles", "digest").join(ids, "digest").drop("digest")
    alone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labels(docs, nodes, id_col, text_col, percent, block) -> DataFrame:
    """node, label of the nodes that have links."""
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("pivot"))
    members = stored(banded.join(crowded.where("_n > 1").drop("_n"), "bucket"))
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    members = members.select("bucket", "node")
    wanted = nodes.select("node", "doc_id", "digest").join(members.select("node").distinct(), "node")
    sets = _sets(docs, stored(wanted), id_col, text_col)
    labels = _relabel(None, _links(stars, nodes, sets, percent))
    open_ = _open(members, labels, 0)
    for turn in range(1, PIVOT_ROUNDS + 1):
        large = open_.where(F.col("n") > block)
        if large.isEmpty():
            break
        links = _links(_pivot_pairs(large), nodes, sets, percent)
        if links.isEmpty():
            break
        labels = _relabel(labels, links)
        open_ = _open(open_.select("bucket", "node"), labels, turn)
    links = _block_links(open_, sets, percent, block)
    return labels if links.isEmpty() else _relabel(labels, links)
