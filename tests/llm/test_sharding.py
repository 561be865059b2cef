import numpy as np

from docmill.llm.op1_sharding import difference, shard


def test_differencing_of_known_numbers():
    """8 7 6 5 4 in two parts: differencing ends with a spread of 2."""
    places, sums = difference(np.array([[n, 0] for n in (8, 7, 6, 5, 4)]))
    assert sorted(sums) == [14, 16]
    for part in (0, 1):
        assert sum(n for n, p in zip((8, 7, 6, 5, 4), places[:, 0], strict=True) if p == part) == sums[part]


def test_partial_partitions_keep_their_parts_apart():
    rows = np.random.default_rng(1).integers(0, 50, (40, 4))
    places, sums = difference(rows)
    back = np.zeros(4, dtype=int)
    for row, place in zip(rows, places, strict=True):
        assert sorted(place) == [0, 1, 2, 3]
        back[place] += row
    assert back.tolist() == sums.tolist()


def test_shards_of_a_table(spark):
    """Bundles of 16 opened down to 40 groups, with one text in a third of all rows."""
    rows = [(i, "x" * (i * 37 % 211) + f" {i % 70}") for i in range(600)] + [(9000 + i, "hot " * 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = shard(docs, 8, bits=4, few=40, rows_per_slice=50).toPandas()
    assert len(found) == len(rows)
    assert found.groupby("text_crc32")["shard"].nunique().max() == 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sums = found.groupby("shard")["size"].sum()
    assert 300 * 21 < sums.sum() / 8 and sums.max() - sums.min() <= 40


def test_awkward_rows(awkward, nothing):
    found = shard(awkward).toPandas()
    assert len(found) == awkward.count()
    assert found[found["text_crc32"].isna()]["size"].tolist() == [1, 1]
    assert found[found["text_crc32"].isna()]["shard"].nunique() == 1
    assert found["law"].unique().tolist() == ["bytes"] and found["grown_shard"].isna().all()
    assert shard(nothing).count() == 0
