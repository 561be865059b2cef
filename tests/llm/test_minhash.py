import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from docmill.llm import op9_minhash
from docmill.llm.components import components
from docmill.llm.op9_minhash import Shingler, _compare, near_duplicates, sketches


def brute(rows):
    """doc_id -> (shingles, component) by counting common shingles of all pairs."""
    sets, parent = {}, {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
        parent[i] = i
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def edited(r, words, share):
    return [f"x{r.random()}" if r.random() < share else w for w in words]


def test_every_coordinate_fills_and_agrees_with_the_similarity():
    r = np.random.default_rng(1)
    sizes = [1, 2, 5, 40, 400, 3_000]
    rows = sketches([r.integers(0, 2**63, n).astype(np.uint64) for n in sizes])
    assert rows.shape == (6, 128) and (rows != 2**64 - 1).all()
    gaps = []
    for _ in range(40):
        shared, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (150, 25, 25))
        left, right = sketches([np.concatenate([shared, a]), np.concatenate([shared, b])])
        gaps.append((left == right).mean() - 0.75)
    assert abs(np.mean(gaps)) < 0.03 and np.max(np.abs(gaps)) < 0.2


def test_shingles():
    shingler = Shingler()
    assert len(shingler(b"a b c d e f")) == 2 and len(shingler(b"A b")) == 1 and len(shingler(b" \x0b\n")) == 0
    assert shingler(b"A B c").tolist() == shingler(b"a b C").tolist()
    assert len(shingler(b"x " * 500)) == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    labels = {r["node"]: r["label"] for r in found}
    assert len(found) == len(labels)
    assert all(labels[i] == 0 for i in range(21)) and all(labels[i] == 100 for i in range(100, 160))
    assert labels[300] == labels[200] == 200 and len(labels) == 21 + 60 + 2


def test_blocks_give_joining_links_only():
    import pyarrow as pa

    r = np.random.default_rng(3)
    base = r.integers(0, 10**9, 40)
    sets = [np.unique(np.concatenate([base, r.integers(0, 10**9, 4)])) for _ in range(6)] + [r.integers(0, 10**9, 30)]
    column = pa.array([np.unique(s) for s in sets], pa.list_(pa.int64()))
    nodes, labels = np.arange(7), np.array([0, 0, 2, 3, 4, 5, 6])
    a, b = _compare(nodes, labels, np.arange(7) > 1, np.ones(7, dtype=bool), column, 75)
    parent = dict(zip(nodes.tolist(), labels.tolist(), strict=True))
    assert len(a) == 4 and 6 not in a and 6 not in b and parent


def test_against_brute_force(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for r in near_duplicates(docs).collect():
        n, label = expected[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, label, label == r["doc_id"])


def test_large_groups_of_near_copies_in_small_blocks(spark):
    """Families around and below the threshold, so that pivots miss links that blocks must find."""
    r = random.Random(8)
    rows = []
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(120)]
        rows += [(1_000 * family + i, " ".join(edited(r, words, 0.02 + 0.008 * family))) for i in range(60)]
    rows += [(9_000 + i, rows[i][1]) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(table, block=8).collect()}
    assert found == {i: label for i, (_, label) in expected.items()}
    assert len(set(found.values())) < len(rows) - 60


def test_awkward_rows(awkward, nothing):
    found = near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in found)
    assert (2, 0, 2, True) in rows and (3, 0, 3, True) in rows and (4, 0, 4, True) in rows
    assert rows.count((6, 3, 1, False)) == 2 and (1, 3, 1, True) in rows
    assert [r for r in rows if r[0] == 7] == [(7, 3, 7, True), (7, 4, 7, True)] and (8, 1, 8, True) in rows
    assert near_duplicates(nothing).count() == 0


def test_sketching_many_words_takes_little_memory(spark):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randint(0, 10**9)}" for _ in range(800)).encode() for _ in range(1_000)]
    schema = to_arrow_schema(op9_minhash.sketched(spark.createDataFrame([], "doc_id long, text string")).schema)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(found.num_rows for found in op9_minhash._sketch_rows(iter([batch]), schema))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_000 and peak < 70 << 20
