"""Every registered query against its SQL oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        assert compare(rows, df.columns, con, ORACLES[name]) == ""
    else:
        assert rows


def test_names_are_covered():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "reason", "n"]
