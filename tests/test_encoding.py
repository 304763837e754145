import pytest

from tallyvine.operators import ordered_codes
from tallyvine.queries import registry


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_numbers_count_by_size(spark, partitions):
    df = spark.createDataFrame([(30,), (10,), (None,), (20,), (10,)], "v int").repartition(partitions)
    assert sorted((str(r.v), r.code) for r in ordered_codes(df, "v").collect()) == [
        ("10", 0), ("10", 0), ("20", 1), ("30", 2), ("None", -1),
    ]


def test_text_counts_by_code_point(spark):
    df = spark.createDataFrame([("9",), ("10",), ("B",), ("a",)], "v string")
    assert {r.v: r.code for r in ordered_codes(df, "v").collect()} == {"9": 1, "10": 0, "B": 2, "a": 3}


def test_many_values(spark):
    df = spark.range(2000).selectExpr("(id * 7919) % 1000 AS v")
    coded = ordered_codes(df, "v")
    assert coded.where("v <> code").count() == 0
    assert coded.count() == 2000


def test_nan_has_no_code(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (None,), (1.0,)], "v double")
    assert sorted((str(r.v), r.code) for r in ordered_codes(df, "v").collect()) == [
        ("1.0", 0), ("2.0", 1), ("None", -1), ("nan", -1),
    ]


def test_values_are_not_ranked_in_one_task(spark, tables):
    for name in ("categorical_codes", "sum_by_station"):
        text = registry()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text.split("BroadcastExchange")[0] or "SinglePartition" not in text.split("BroadcastExchange")[0]
