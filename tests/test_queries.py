"""Every registered query against its SQL in DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as entry
from catalog import stored_queries
from catalog.check import compare, connect, types

QUERIES, ORACLES = dict(stored_queries.QUERIES), dict(stored_queries.ORACLES)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = df.toPandas()
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        assert compare(got, rel.df()) == ""
        assert types(df, rel) == ""
    else:
        assert len(got) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "evidence" in df.columns
