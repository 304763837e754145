"""Totals, means, counts and shares. All are combined on the map side before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.functions import mean, percentage, total
from tallyvine.schema import DIMENSIONS, PROFILE_DIMENSIONS, STATISTICS, choose


def total_by_campaign(df: DataFrame, measure: str = "production") -> DataFrame:
    """Total of a measure per campaign, in ascending order."""
    return (
        df.where(F.col("campaign").isNotNull())
        .groupBy("campaign")
        .agg(total(measure).alias(measure))
        .orderBy("campaign")
    )


def production_by(
    df: DataFrame, dimension: str, statistic: str, measure: str = "production"
) -> DataFrame:
    """Mean or total of a measure per dimension value and campaign, unordered."""
    by = choose(DIMENSIONS, dimension)
    aggregate = {"mean": mean, "total": total}[choose(STATISTICS, statistic)]
    return (
        df.where(F.col(by).isNotNull() & F.col("campaign").isNotNull())
        .groupBy(by, "campaign")
        .agg(aggregate(measure).alias(measure))
    )


def _frequency(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def category_frequency(df: DataFrame, dimension: str) -> DataFrame:
    """Rows per dimension value, most frequent first, ties by value."""
    by = choose(PROFILE_DIMENSIONS, dimension)
    return _frequency(df, by).orderBy(F.desc("n"), by)


def grand_total(frequencies: DataFrame) -> DataFrame:
    """One row: the sum of the frequencies."""
    return frequencies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def category_shares(df: DataFrame, dimension: str) -> DataFrame:
    """Frequencies with their percentage of all counted rows.

    The total is a scalar subquery over the same frequencies, so it reuses their shuffle.
    """
    by = choose(PROFILE_DIMENSIONS, dimension)
    frequencies = _frequency(df, by)
    counted = grand_total(frequencies).scalar()
    return frequencies.withColumn("share", percentage(F.col("n"), counted)).orderBy(
        F.desc("n"), by
    )


def distinct_farms(df: DataFrame) -> DataFrame:
    """One row: the number of different farms, unknown farms counting as one."""
    return df.select("farm_id").distinct().agg(F.count(F.lit(1)).alias("farms"))


def row_count(df: DataFrame) -> DataFrame:
    """One row: the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"))
