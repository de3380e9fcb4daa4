"""Every registered query runs at the smallest scale; those with SQL must equal DuckDB."""

import pytest

from pollwarden import catalog
from tests.oracle import compare, connect

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    ok, note, _ = compare(spark, name, QUERIES[name], ORACLES[name], sf, con)
    spark.catalog.clearCache()
    assert ok, note


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and n[0] in "afms"))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
