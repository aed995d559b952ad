"""Every registered query next to its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
