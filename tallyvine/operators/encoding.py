"""Dense codes of sorted category values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.functions import known
from tallyvine.operators.positions import number_ranges, sorted_ranges


def number_values(values: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Add to rows with different non-null values of ``column`` their rank from 0.

    Values are ranked by ranges, however few there are. The one write that sorts them is also
    the one time that they are computed; all else is read from it when asked for.
    """
    return number_ranges(sorted_ranges(values, [column]), name)


def ordered_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Add to every row the code of its value: sorted values count from 0, null and NaN are -1.

    The codes are joined without a hint; the size of their table decides how.
    """
    values = df.select(known(df.schema[column]).alias(column)).where(F.col(column).isNotNull()).distinct()
    codes = number_values(values, column, name)
    return df.join(codes, column, "left").select(
        *df.columns, F.coalesce(F.col(name), F.lit(-1)).alias(name)
    )
