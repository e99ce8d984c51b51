"""Every registered query with SQL is compared with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    assert compare(spark, duck, sf, QUERIES[name], ORACLES[name]) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
