"""Choosing rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.functions import compare, parse_literal
from tallyvine.schema import COMPARISONS, choose


def catalogue(df: DataFrame) -> list[str]:
    """Columns a user may filter by."""
    return df.columns


def column_at(df: DataFrame, position: int) -> DataFrame:
    """The column at a position, counted from 0."""
    return df.select(df.columns[position])


def closed_campaigns(df: DataFrame, last_closed: int) -> DataFrame:
    """Rows of the campaigns up to ``last_closed``."""
    return df.where(F.col("campaign") <= last_closed)


def for_campaign(df: DataFrame, campaign: int | None = None) -> DataFrame:
    """Rows of one campaign, or of all when none is given."""
    return df if campaign is None else df.where(F.col("campaign") == campaign)


def filter_rows(df: DataFrame, column: str, comparison: str, text: str) -> DataFrame:
    """Whole rows whose ``column`` compares to the value typed in as ``text``.

    Raises ``ValueError`` where the text is no value of the column's type.
    """
    operator = choose(COMPARISONS, comparison)
    if column not in df.columns:
        raise ValueError(f"{column!r} is not one of {df.columns}")
    data_type = df.schema[column].dataType
    return df.where(compare(df[column], operator, parse_literal(text, data_type), data_type))
