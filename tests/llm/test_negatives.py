import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import op11_negatives as N


def plain(rows, positives=5, negatives=10):
    """rows: (id, label, list of int)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, label, v in sorted(rows):
        if i % 100 == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scores = [(-dot(v, w), i, other) for i, other, w in rows if i != a and len(w) == len(v)]
        same = sorted((s, i) for s, i, other in scores if other == label)[:positives]
        for ps, p in same:
            fits = [(s, i) for s, i, other in scores if other != label and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, rank, i, -ps, -s) for rank, (s, i) in enumerate(sorted(fits)[:negatives], 1)]
    return sorted(out)


def mined(table, **options):
    return sorted(tuple(r) for r in N.hard_negatives(table, F.col("vec_id") % 100 == 0, **options).collect())


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


@pytest.mark.parametrize("dims, spread, labels", [(3, 2, 2), (6, 5, 3), (2, 400, 5), (8, 1, 4)])
def test_equals_brute_force(spark, monkeypatch, dims, spread, labels):
    monkeypatch.setattr(N, "LANE_ROWS", 300)
    monkeypatch.setattr(N, "ANCHOR_ROWS", 4)
    random = np.random.default_rng(dims)
    rows = [(i, int(random.integers(labels)), [float(x) / 16 for x in random.integers(-spread, spread + 1, dims)])
            for i in range(1_100)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    assert mined(table) == plain([(i, label, whole(v)) for i, label, v in rows])


def test_pruning_leaves_few_and_right_rows(monkeypatch):
    random = np.random.default_rng(3)
    rows = random.integers(-300, 300, (4_000, 4))
    rows = rows[np.argsort(-np.linalg.norm(rows, axis=1))]
    ids, labels = random.permutation(4_000), random.integers(0, 3, 4_000)
    anchors = [N.Anchor(10_000 + i, int(labels[i]), rows[i], [N.Search(40_000, 200_000, 5), N.Search(-50, 90_000, 5)])
               for i in range(0, 200, 10)]
    taken = sum(
        N.search_bucket(N.Bucket(rows[at : at + 500], ids[at : at + 500], labels[at : at + 500]), anchors, False)
        for at in range(0, 4_000, 500)
    )
    for a in anchors:
        scores = rows @ a.vector
        for search in a.searches:
            fits = (labels != a.label) & (scores >= search.low) & (scores <= search.high)
            best = sorted(zip((-scores[fits]).tolist(), ids[fits].tolist()))[:5]
            assert best == list(zip((-search.scores).tolist(), search.ids.tolist()))
    assert taken < 4_000 * len(anchors) / 2


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]),
        (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (4, 2, [0.9, 0.0]), (5, 3, [0.91, 0.0]), (6, 1, [0.0, 1.0]),
        (7, 2, [0.0, 0.0]), (8, 2, [-1.0, 0.0]), (100, 1, [0.0, 0.0]), (200, 9, [1.0, 1.0]), (300, 1, [1.0]),
        (9, 1, [-0.5, 0.0]), (400, 4, []), (10, 4, []), (11, 5, []),
    ]
    broken = [
        (12, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (13, 2, None), (14, 2, [nan, 1.0]), (15, 2, [inf, 1.0]),
        (16, 2, [None, 1.0]), (500, None, [1.0, 0.0]), (600, 1, [nan, 0.0]),
    ]
    schema = "vec_id long, label int, embedding array<double>, slot string, rank string"
    table = spark.createDataFrame([(*r, "x", "y") for r in data + broken], schema)
    assert mined(table) == plain([(i, label, whole(v)) for i, label, v in data])
    assert mined(table.where("1 = 0")) == [] and mined(table.where("vec_id = 1")) == []
    assert mined(table.where("vec_id = 0 or vec_id > 3 and label <> 1")) == plain(
        [(i, label, whole(v)) for i, label, v in data if i == 0 or i > 3 and label != 1])


def test_scores_beyond_a_long_raise(spark):
    table = spark.createDataFrame([(0, 1, [1e15]), (1, 1, [1e15])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="may not fit"):
        mined(table)
