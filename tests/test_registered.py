"""Every registered query beside its check SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry_point
from docmill import plans

ORACLES = entry_point.oracle_sql()
# the training-data queries without SQL have tests of their own beside their operators
QUERIES = {n: q for n, q in entry_point.queries().items() if n in ORACLES or n in plans.all_queries()}


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, root, name):
    frame = QUERIES[name](spark, root)
    got = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert table(frame.columns, got) == table(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
