import numpy as np

from docmill.llm.op3_topk import Best, search_block, top_k
from docmill.llm.queries import TOPK_SQL


def brute(vectors, asked, k):
    out = []
    for q, v in asked:
        scores = [(-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def whole(v):
    return [int(np.floor(1024 * float(np.float32(x)))) for x in v]


def test_random_vectors_in_blocks(spark, monkeypatch):
    import docmill.llm.op3_topk as module

    random = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in random.integers(-3, 4, 6) / 4]) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = top_k(table, table.where("vec_id % 100 = 0"), 10, query_values=20)
    vectors = [(i, whole(v)) for i, v in rows]
    expected = brute(vectors, [x for x in vectors if x[0] % 100 == 0], 10)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_walk_stops_early():
    random = np.random.default_rng(4)
    block = random.integers(0, 100, (5_000, 4))
    block[17] = 1_000
    best = Best(1, 1)
    scored = search_block(np.array([[1, 2, 3, 4]]), np.array([-1]), block, np.arange(5_000), best, np.array([0]))
    assert best.ids[0].tolist() == [17] and scored < 500


def test_huge_components_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [1.0, 2.0**8]), (2, [-1.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute([(i, [int(1024 * x) for x in v]) for i, v in rows], [(0, [int(1024 * x) for x in rows[0][1]])], 10)
    assert sorted(tuple(r) for r in top_k(table, table.where("vec_id = 0")).collect()) == expected


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, None, "a"), (2, [nan, 1.0], "a"), (3, [inf, 1.0], "a"),
        (4, [None, 1.0], "a"), (5, [1.0, 0.0], "a"), (6, [1.0, 0.0], "a"), (7, [1.0, 0.0, 0.0], "a"),
        (None, [9.0, 9.0], "a"), (8, [0.0, 0.0], "a"), (8, [0.0, 0.0], "a"), (9, [], "a"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    found = top_k(table, table.where("vec_id % 100 = 0"))
    unit = 1024 * 1024
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 5, unit), (0, 2, 6, unit), (0, 3, 8, 0), (0, 4, 8, 0)]
    assert top_k(table, table.where("1 = 0")).count() == 0
    assert top_k(table.where("1 = 0"), table.where("vec_id = 0")).count() == 0


def test_sql_agrees(spark, duck, root):
    table = spark.read.parquet(f"{root}/embeddings.parquet")
    found = top_k(table, table.where("vec_id % 100 = 0"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(duck.execute(TOPK_SQL).fetchall())
