import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import op12_clusters as C
from docmill.llm.queries import clusters_query


def plain(vectors, k, rounds, seed="2"):
    """vectors: (id, list of int). Every distance of every round."""
    drawn = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in drawn[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in vectors:
            members.setdefault(nearest(v)[1], []).append(v)
        for c, found in members.items():
            centroids[c] = [sum(x) // len(found) for x in zip(*found)]
    made = [(i, nearest(v)) for i, v in vectors]
    inertia = {}
    for _, (d, c) in made:
        inertia[c] = inertia.get(c, 0) + d
    return [(i, c, d, inertia[c], sum(inertia.values()), centroids[c]) for i, (d, c) in made]


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("k, rounds, spread", [(1, 2, 3), (2, 3, 1), (9, 6, 2), (40, 4, 30)])
def test_equals_plain_rounds(spark, k, rounds, spread):
    random = np.random.default_rng(k)
    rows = [(i, [float(x) / 8 for x in random.integers(-spread, spread + 1, 5)]) for i in range(700)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    expected = plain([(i, whole(v)) for i, v in rows], k, rounds)
    assert rows_of(C.cluster(table, k, rounds, 5)) == sorted(expected, key=repr)


def test_bounds_save_distances():
    random = np.random.default_rng(5)
    middle = random.integers(-2_000, 2_000, (30, 8))
    rows = (middle[random.integers(0, 30, 4_000)] + random.integers(-60, 61, (4_000, 8))).astype(np.int64)
    points = rows[:30].copy()
    state = C.Assignment.unknown(rows, 30)
    moved = np.zeros(30)
    for _ in range(6):
        state.compared = 0
        state.update(C.Centroids(points, moved))
        square = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (state.cluster == square.argmin(axis=1)).all()
        exact = np.sort(np.sqrt(square), axis=1)
        assert (state.upper >= exact[:, 0]).all() and (state.lower <= exact[:, 1]).all()
        new = points.copy()
        for c in np.unique(state.cluster):
            new[c] = rows[state.cluster == c].sum(axis=0) // (state.cluster == c).sum()
        moved = np.sqrt(((new - points) ** 2).sum(axis=1)) * (1 + 1e-12)
        points = new
    assert state.compared < 4_000 * 30 / 4


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, None, "a"), (3, [nan, 0.0], "a"),
        (4, [inf, 0.0], "a"), (5, [None, 0.0], "a"), (6, [1.0], "a"), (7, [], "a"), (None, [0.5, 0.5], "a"),
        (8, [0.5, 0.5], "a"), (9, [-0.001, 0.0], None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v)]
    for k in (1, 3, 40):
        assert rows_of(C.cluster(table, k, 2, 2)) == sorted(plain(kept, k, 2), key=repr)
    empty = C.cluster(table.where("1 = 0"), 3, 2, 2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(ValueError):
        C.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 1, 1, 2)


def test_query_has_all_vectors(spark, root):
    found = clusters_query(spark, root)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found.agg(F.count_distinct("vec_id")).first()[0] == spark.read.parquet(f"{root}/embeddings.parquet").count()
