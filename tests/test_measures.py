import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyvine.functions import mean, percentage, total, two_decimals


def value_of(df, column):
    return df.agg(column.alias("x")).head()["x"]


def measure(spark, values, partitions=1):
    return spark.createDataFrame([(v,) for v in values], "m double").repartition(partitions)


def test_null_keys_and_measures(spark):
    rows = [(2, 1.0), (1, None), (None, 5.0), (1, 2.0), (3, None)]
    df = spark.createDataFrame(rows, "k int, v double").where("k IS NOT NULL")
    found = df.groupBy("k").agg(total("v").alias("t"), mean("v").alias("m")).collect()
    assert {r.k: r.t for r in found} == {1: 2.0, 2: 1.0, 3: 0.0}
    assert {r.k: r.m for r in found} == {1: 2.0, 2: 1.0, 3: None}


def test_hundredths_add_up_exactly_in_any_partitioning(spark):
    draw = random.Random(7)
    cents = [draw.randint(-(10**9), 10**13) for _ in range(5000)]
    expected = float(Fraction(sum(cents), 100))
    for partitions in (1, 3, 17):
        df = measure(spark, [c / 100 for c in cents], partitions)
        assert value_of(df, total("m")) == expected
        assert value_of(df, mean("m")) == expected / len(cents)


def test_other_values_are_not_rounded(spark):
    values = [0.123456, 7.5e-9, -3.3333333, 2.0**60, -(2.0**60), 1e300]
    assert value_of(measure(spark, values[:3]), total("m")) == pytest.approx(
        math.fsum(values[:3]), rel=1e-15
    )
    assert value_of(measure(spark, values[3:]), total("m")) == 1e300


def test_nan_counts_as_null_and_infinity_remains(spark):
    assert value_of(measure(spark, [1.0, math.nan, 3.0]), total("m")) == 4.0
    assert value_of(measure(spark, [1.0, math.nan, 3.0]), mean("m")) == 2.0
    assert value_of(measure(spark, [math.nan]), mean("m")) is None
    assert value_of(measure(spark, [1.0, math.inf]), total("m")) == math.inf


def test_integer_measure(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "m bigint")
    assert value_of(df, total("m")) == 5.0
    assert value_of(df, mean("m")) == 2.5


@pytest.mark.parametrize("value, rounded", [(0.125, 0.12), (1.005, 1.0), (33.335, 33.34)])
def test_two_decimals_round_halves_to_even(spark, value, rounded):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(two_decimals(F.col("x"))).head()[0] == rounded


def test_percentage_of_counts(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 800), (3, 800)], "n bigint, of bigint")
    shares = [r[0] for r in df.select(percentage(F.col("n"), F.col("of"))).collect()]
    assert shares == [33.33, 66.67, 0.12, 0.38]
