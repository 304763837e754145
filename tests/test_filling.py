import pytest

from tallyvine.operators import fill_by_key, fill_by_position
from tallyvine.plans import complete_by_key

FARMS = "campaign int, farm_id int, variety int, mode int, type int, color int, production double"


def test_positional_fill(spark):
    df = spark.createDataFrame([(i, 10.0 * i, "k") for i in range(6)], "id int, v double, s string")
    values = spark.createDataFrame([(2, -2.0), (1, -1.0)], "n int, p double")
    filled = fill_by_position(df.repartition(3), 4, ["id"], "v", values, "p", ["n"])
    assert filled.columns == df.columns
    assert sorted((r.id, r.v) for r in filled.collect()) == [
        (0, 0.0), (1, 10.0), (2, 20.0), (3, 30.0), (4, -1.0), (5, -2.0),
    ]


@pytest.mark.parametrize("count", [1, 3])
def test_positional_fill_needs_as_many_values_as_rows(spark, count):
    df = spark.createDataFrame([(i, 0.0) for i in range(5)], "id int, v double")
    values = spark.createDataFrame([(i, 1.0) for i in range(count)], "n int, p double")
    with pytest.raises(ValueError):
        fill_by_position(df, 3, ["id"], "v", values, "p", ["n"])


def test_keyed_fill(spark):
    rows = [
        (20, 1, 9, 1, 0, 1, 5.0),
        (21, 1, 9, 1, 0, 1, None),
        (21, 2, 9, 1, 0, 1, None),
        (None, 1, 9, 1, 0, 1, 7.0),
    ]
    given = spark.createDataFrame([(1, 9, 1, 0, 1, 2.0, -8.5)],
        "farm_id int, variety int, mode int, type int, color int, area double, production double")
    filled = complete_by_key(spark.createDataFrame(rows, FARMS), given, 20).collect()
    assert sorted((str(r.campaign), r.farm_id, r.production) for r in filled) == [
        ("20", 1, 5.0), ("21", 1, -8.5), ("21", 2, None), ("None", 1, 7.0),
    ]


def test_keyed_fill_refuses_ambiguous_values(spark):
    df = spark.createDataFrame([(21, 1, None)], "campaign int, farm_id int, production double")
    values = spark.createDataFrame([(1, 2.0), (1, 3.0)], "farm_id int, p double")
    with pytest.raises(ValueError, match="several values"):
        fill_by_key(df, 20, ["farm_id"], "production", values, "p")
