import pytest

from tallyvine.plans.prediction import fit_yield_model, predict_batch
from tallyvine.sources import read_batch

COLUMNS = "farm_id int, variety int, mode int, type int, color int, area double, production double"
FARMS = "1|7|1|0|1|2.5\n2|8|2|0|0|\n"


def test_line_mean_and_overall_mean(spark):
    closed = [
        (1, 1, 1, 1, 1, 1.0, 10.0),
        (2, 1, 1, 1, 1, 3.0, 14.0),
        (3, 1, 1, 1, 1, None, 90.0),
        (4, 2, 1, 1, 1, 5.0, 7.0),
        (5, 2, 1, 1, 1, 5.0, 9.0),
        (6, None, 1, 1, 1, None, 20.0),
        (7, 1, 1, 1, 1, 2.0, None),
        (8, 1, 1, 1, 1, 2.0, float("nan")),
    ]
    asked = [
        (1, 1, 1, 1, 1, 2.0, None),
        (2, 1, 1, 1, 1, None, None),
        (3, 2, 1, 1, 1, 6.0, None),
        (4, None, 1, 1, 1, 6.0, None),
        (5, 9, 9, 9, 9, 6.0, None),
        (6, 1, 1, 1, 1, float("nan"), None),
    ]
    expected = {1: 12.0, 2: 38.0, 3: 8.0, 4: 20.0, 5: 25.0, 6: 38.0}
    batch = spark.createDataFrame(asked, COLUMNS)
    for partitions in (1, 3, 17):
        model = fit_yield_model(spark.createDataFrame(closed, COLUMNS).repartition(partitions))
        assert {r.farm_id: r.production for r in predict_batch(model, batch).collect()} == expected


def test_products_beyond_64_bits(spark):
    """Hundredths of 1e9 hectares and 1e10 kg have products of 21 digits."""
    closed = [(i, 1, 1, 1, 1, 1e9 * i, 2e10 * i) for i in range(1, 5)]
    model = fit_yield_model(spark.createDataFrame(closed, COLUMNS))
    batch = spark.createDataFrame([(9, 1, 1, 1, 1, 2.5e9, None)], COLUMNS)
    assert predict_batch(model, batch).first().production == pytest.approx(5e10)


def test_nothing_to_learn_from(spark):
    model = fit_yield_model(spark.createDataFrame([], COLUMNS))
    found = predict_batch(model, spark.createDataFrame([(1, 1, 1, 1, 1, 2.0, None)], COLUMNS)).collect()
    assert [r.production for r in found] == [None]


@pytest.mark.parametrize(
    "text",
    [
        FARMS,
        "1|7|1|0|1|2.5|\n2|8|2|0|0||3.5\n",
        "SUPERFICIE|ID_FINCA|VARIEDAD|MODO|TIPO|COLOR\n2.5|1|7|1|0|1\n|2|8|2|0|0\n",
        "ID_FINCA|VARIEDAD|MODO|TIPO|COLOR|SUPERFICIE|PRODUCCION\n1|7|1|0|1|2.5|9\n2|8|2|0|0||\n",
    ],
)
def test_uploaded_batch(spark, tmp_path, text):
    (tmp_path / "batch.txt").write_text(text)
    found = read_batch(spark, str(tmp_path / "batch.txt")).orderBy("farm_id").collect()
    assert [tuple(r) for r in found] == [(1, 7, 1, 0, 1, 2.5, None), (2, 8, 2, 0, 0, None, None)]


@pytest.mark.parametrize("text", ["1|2|3\n", "ID_FINCA|VARIEDAD\n1|2\n", "1|2|3|4|5|6|7|8\n"])
def test_batch_of_other_columns(spark, tmp_path, text):
    (tmp_path / "batch.txt").write_text(text)
    with pytest.raises(ValueError):
        read_batch(spark, str(tmp_path / "batch.txt"))
