"""Row positions, and splitting by them, without passing all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyvine.functions import as_text, precedes
from tallyvine.sources.scratch import store

# Rows per range of a sort, unless the session's setting asks for more ranges.
RANGE_ROWS = 2_000_000


def sorted_ranges(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` sorted over range partitions and stored, with each row's partition and number in it.

    ``rows`` is the number of rows, from which follows how many ranges are needed. Of rows that
    come out of a shuffle it need not be known: they get as many ranges as that has partitions.
    """
    ranges = max(ceil((rows or 0) / RANGE_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    arranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return store(
        arranged.select(
            "*",
            F.spark_partition_id().alias("_range"),
            F.monotonically_increasing_id().alias("_number"),
        )
    )


def number_ranges(ranged: DataFrame, name: str) -> DataFrame:
    """Positions from 0 across the partitions of ``sorted_ranges``.

    The offsets have one row per partition of the sort, which bounds both the window over
    them and their broadcast.
    """
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_number").alias("_first"))
        .select(
            "_range",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    kept = [column for column in ranged.columns if column not in ("_range", "_number")]
    return ranged.join(F.broadcast(offsets), "_range").select(
        *kept, (F.col("_number") + F.col("_shift")).alias(name)
    )


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the place (from 0) that each row takes when sorted by ``order``, unique and ascending.

    One range-partitioned sort, stored with each row's number inside its partition; the numbers
    are then shifted by the sizes of the partitions before.
    """
    return number_ranges(sorted_ranges(df, order, df.count()), name)


def row_total(ranged: DataFrame) -> int:
    """Rows of ``sorted_ranges``, from the stored files."""
    return ranged.count()


def _row_at(keys: DataFrame, position: int, rows: int) -> Row:
    """The keys at a position, as text; ``ValueError`` if the row before has the same."""
    numbered = number_ranges(sorted_ranges(keys, keys.columns, rows), "_position")
    near = numbered.where(F.col("_position").isin(position - 1, position)).orderBy("_position")
    before, found = near.select(*[as_text(field).alias(field.name) for field in keys.schema]).head(2)
    if before == found:
        raise ValueError(f"rows {position - 1} and {position} have the same {keys.columns}")
    return found


def split_at(
    df: DataFrame, position: int, order: Sequence[str], rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The first ``position`` rows in ``order``, and the rest; past the end the rest is empty.

    ``rows`` is the number of rows, counted if not given.

    Only order columns are sorted, to find the first row of the rest. Both parts are then plain
    filters on ``df``: its rows are not shuffled. Rows on either side of the boundary must
    differ in ``order``, else ``ValueError``.
    """
    if position <= 0:
        return df.where(F.lit(False)), df
    keys = df.select(*order)
    rows = keys.count() if rows is None else rows
    if position >= rows:
        return df, df.where(F.lit(False))
    boundary = _row_at(keys, position, rows)
    first = precedes([df.schema[name] for name in order], boundary)
    return df.where(first), df.where(~first)
