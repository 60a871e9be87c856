"""Every query with a SQL counterpart gives the same rows as DuckDB."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, sf, name):
    assert compare(spark, con, entry.queries()[name], ORACLE[name], sf) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
