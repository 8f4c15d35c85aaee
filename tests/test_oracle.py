"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from oracle import compare, connect

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), DIR)
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() == 8
