"""Every registered query with SQL gives DuckDB's rows, value for value."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import assert_same, connect

SQL = oracle_sql()


@pytest.fixture(scope="module")
def connection(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tables, connection, name):
    assert_same(queries()[name](spark, tables), connection, SQL[name])
