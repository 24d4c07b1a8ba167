from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def connection(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, tables, connection, name):
    assert compare(spark, connection, tables, name, queries()[name], oracle_sql()[name]) == ""


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and {"lang", "precision", "recall"} <= set(rows[0].asDict())
