"""Sums, means and shares that do not depend on the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 20
# Beyond this a double no longer holds every hundredth, so none are split off.
_EXACT_UP_TO = 2**52 // 100


def _clean(measure: str) -> str:
    """The measure as double, NaN as null."""
    return f"nanvl(cast(`{measure}` AS double), null)"


def _sum(measure: str) -> str:
    value = _clean(measure)
    hundredths = f"""cast(CASE WHEN abs({value}) < {_EXACT_UP_TO} THEN rint({value} * 100)
                               WHEN {value} IS NOT NULL THEN 0 END AS bigint)"""
    upper = f"cast(sum(shiftright({hundredths}, {_LOW_BITS})) AS decimal(20,0))"
    lower = f"cast(sum({hundredths} & {2**_LOW_BITS - 1}) AS decimal(20,0))"
    remainder = f"sum({value} - {hundredths} / 100)"
    return f"""coalesce(cast(({upper} * {2**_LOW_BITS}BD + {lower}) * 0.01BD AS double) + {remainder}, 0.0D)"""


def total(measure: str) -> Column:
    """Sum of a measure; 0.0 where a group has only nulls.

    Whole hundredths are added as integers, so for such data the sum is exact however rows are
    partitioned. What is left of other values is added as a plain double. The integers are
    kept in two halves: 2**43 rows fit before the lower sum overflows, and both sums stay in
    generated code on longs, several times faster than decimals.
    """
    return F.expr(_sum(measure))


def mean(measure: str) -> Column:
    """Mean of a measure; null where a group has only nulls."""
    return F.expr(f"{_sum(measure)} / nullif(count({_clean(measure)}), 0)")


def two_decimals(value: Column) -> Column:
    """Rounded to two decimals, halves to even."""
    return F.rint(value * 100) / 100


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals."""
    return two_decimals(part / whole * 100)
