"""Completing the measure of open rows from a table of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.operators.positions import number_ranges, row_total, sorted_ranges, split_at
from tallyvine.sources.scratch import store


def _replace(df: DataFrame, measure: str, value: Column) -> list[Column]:
    return [
        value.cast(df.schema[name].dataType).alias(name) if name == measure else F.col(name)
        for name in df.columns
    ]


def fill_by_position(
    df: DataFrame,
    position: int,
    order: Sequence[str],
    measure: str,
    values: DataFrame,
    value: str,
    value_order: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """Overwrite ``measure`` from row ``position`` on with the i-th ``value`` in the i-th such row.

    There must be one value per row, else ``ValueError``. Rows before ``position`` pass
    through without a shuffle. Rows are counted once (or not at all, where ``rows`` is given); how many
    are open follows from it, and the values are counted in the table that sorts them.
    """
    rows = df.count() if rows is None else rows
    position = max(0, position)
    wanted = max(0, rows - position)
    given = sorted_ranges(values.select(*value_order, F.col(value).alias("_value")), value_order, wanted)
    found = row_total(given)
    if wanted != found:
        raise ValueError(f"{wanted} rows to fill but {found} values")
    kept, open_rows = split_at(df, position, order, rows)
    targets = sorted_ranges(open_rows, order, wanted)
    numbered = number_ranges(given, "_position").select("_position", "_value")
    filled = (
        number_ranges(targets, "_position")
        .join(numbered, "_position")
        .select(*_replace(df, measure, F.col("_value")))
    )
    return kept.unionByName(filled)


def fill_by_key(
    df: DataFrame,
    last_closed: int,
    keys: Sequence[str],
    measure: str,
    values: DataFrame,
    value: str,
) -> DataFrame:
    """Overwrite ``measure`` of campaigns after ``last_closed`` with the value of equal ``keys``.

    Rows without a value keep what they have; a key with several values is a ``ValueError``. Closed
    rows pass through without a shuffle. The values are stored first, one row per key: the join
    then knows their size, and either broadcasts them or shuffles both sides, in which
    case adaptive execution can split a key that very many rows share.
    """
    campaign = F.col("campaign")
    closed = df.where(campaign.isNull() | (campaign <= last_closed))
    return fill_open_by_key(closed, df.where(campaign > last_closed), keys, measure, values, value)


def fill_open_by_key(
    closed: DataFrame, open_rows: DataFrame, keys: Sequence[str], measure: str, values: DataFrame, value: str
) -> DataFrame:
    """``fill_by_key`` on rows that were read apart, so that each scan reads its own campaigns only."""
    one_each = store(
        values.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_values"), F.first(value).alias("_value")
        )
    )
    repeated = one_each.where(F.col("_values") > 1).select(*keys).head()
    if repeated is not None:
        raise ValueError(f"several values for {repeated.asDict()}")
    filled = (
        open_rows.join(one_each.drop("_values"), list(keys), "left")
        .select(*_replace(open_rows, measure, F.coalesce(F.col("_value"), F.col(measure))))
    )
    return closed.unionByName(filled)
