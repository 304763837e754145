"""The operators' queries with SQL give DuckDB's rows, value for value."""

import pytest

from tallyvine.llm import oracles, queries
from tests.compare import assert_same, connect

WITHOUT_SQL = {"op2_packing", "op4_token_files", "op7_byte_bpe", "op8_substring_dedup", "op9_secret_scan", "op10_quality_classifier"}


@pytest.fixture(scope="module")
def connection(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(oracles.registry()))
def test_same_as_sql(spark, tables, connection, name):
    assert_same(queries.registry()[name](spark, tables), connection, oracles.registry()[name])


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(queries.registry()) - set(oracles.registry()) == WITHOUT_SQL
