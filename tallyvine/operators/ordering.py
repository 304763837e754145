"""Sorted and distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyvine.functions import as_text, follows, known


def distinct_campaigns(df: DataFrame) -> DataFrame:
    """The campaigns that occur, ascending."""
    return df.select("campaign").distinct().orderBy("campaign")


def sort_rows(
    df: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] | None = None
) -> DataFrame:
    """Rows sorted by a column, nulls and NaN last.

    ``ties`` (default: all other columns) order equal values, which also lets the
    range partitioning cut through a value that very many rows share.
    """
    if ties is None:
        ties = [name for name in df.columns if name != column]
    key = known(df.schema[column])
    first = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return df.orderBy(first, *ties)


def page_rows(
    df: DataFrame,
    column: str,
    size: int,
    ascending: bool = True,
    ties: Sequence[str] | None = None,
    after: Sequence[str | None] | None = None,
) -> DataFrame:
    """The ``size`` rows that follow ``after`` (default: the first ones) in the order of ``sort_rows``.

    ``after`` is the ``page_end`` of the page before. Each page is a top ``size`` of the rows behind
    it: no full sort, and no row of an earlier page. ``ties`` must make rows unique, or equal ones
    at the end of a page are passed over.
    """
    if ties is None:
        ties = [name for name in df.columns if name != column]
    if after is not None:
        df = df.where(follows(df.schema[column], ascending, [df.schema[name] for name in ties], after))
    return sort_rows(df, column, ascending, ties).limit(size)


def page_end(page: DataFrame, column: str, ties: Sequence[str] | None = None) -> list[str | None] | None:
    """Where a page of ``page_rows`` ends, as texts; None for an empty page. Only the last row is fetched."""
    if ties is None:
        ties = [name for name in page.columns if name != column]
    last = page.select(*[as_text(page.schema[name]).alias(name) for name in [column, *ties]]).tail(1)
    return list(last[0]) if last else None
