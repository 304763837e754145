"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def assert_same(frame, connection, sql):
    relation = connection.sql(sql)
    assert sorted(frame.columns) == sorted(relation.columns)
    ours = normal([tuple(row) for row in frame.collect()], frame.columns)
    theirs = normal(relation.fetchall(), relation.columns)
    assert len(ours) == len(theirs)
    assert ours == theirs
