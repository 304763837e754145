import pytest

from tallyvine import plans
from tallyvine.operators import category_frequency, distinct_campaigns, distinct_farms, grand_total
from tallyvine.schema import HARVEST_HEADERS, HARVEST_SCHEMA
from tallyvine.sources import read_harvest, read_predictions

# campaign, farm, zone, station, altitude, variety, mode, type, color, area, production
ROWS = [
    (14, 1, 1, 30, "600", 9, 1, 0, 1, 1.0, 100.0),
    (14, 2, 1, 10, "600", 9, 2, 0, 1, 1.0, 50.5),
    (14, 2, 2, 10, None, 40, 2, 0, 0, 0.0, 49.5),
    (14, 3, None, None, None, 40, 2, 1, 0, 2.0, 7.25),
    (15, 1, 1, 20, "600", 9, 1, 0, 1, 1.0, None),
    (15, None, 1, 30, "610", 9, 1, 0, 1, 1.0, 80.0),
    (15, None, 1, 30, "610", 9, 1, 0, 1, 1.0, 20.0),
    (16, 1, 1, 30, "600", 9, 1, 0, 1, 1.0, None),
    (16, 2, 1, 10, "600", 9, 2, 0, 1, 1.0, None),
]


@pytest.fixture(scope="module")
def harvest(spark):
    return spark.createDataFrame(ROWS, HARVEST_SCHEMA).repartition(3)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_campaign_series(harvest):
    assert rows(plans.campaign_series(harvest, 15)) == [(14, 207.25), (15, 100.0)]


def test_production_report(harvest):
    total = plans.production_report(harvest, "Estación Meteorológica", 14, "Producción total")
    assert rows(total) == [(10, 14, 100.0, 0), (30, 14, 100.0, 1)]
    mean = plans.production_report(harvest, "Estación Meteorológica", 15, "Producción media")
    assert rows(mean) == [(20, 15, None, 0), (30, 15, 50.0, 1)]
    assert rows(plans.production_report(harvest, "Zona", 17, "Producción total")) == []
    with pytest.raises(ValueError):
        plans.production_report(harvest, "altitude", 14, "Producción total")


def test_farm_profile(harvest):
    everything = plans.farm_profile(harvest, "Modo")
    assert rows(everything.categories) == [(1, 5, 55.56), (2, 4, 44.44)]
    assert rows(everything.farms) == [(4,)]
    one = plans.farm_profile(harvest, "Estación Meteorológica", 14)
    assert rows(one.categories) == [(10, 2, 66.67), (30, 1, 33.33)]
    assert rows(one.farms) == [(3,)]
    assert rows(plans.farm_profile(harvest, "Tipo", 99).categories) == []
    with pytest.raises(ValueError):
        plans.farm_profile(harvest, "Zona")


def test_frequency_ties_and_nulls(spark):
    df = spark.createDataFrame([(c,) for c in ["b", "a", None, "a", "b", "c"]], "color string")
    frequencies = category_frequency(df, "color")
    assert rows(frequencies) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(grand_total(frequencies)) == [(5,)]
    assert rows(grand_total(frequencies.where("n > 9"))) == [(0,)]


def test_unknown_farms_count_as_one(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (2,)], "farm_id int")
    assert rows(distinct_farms(df)) == [(3,)]
    assert rows(distinct_farms(df.where("farm_id IS NOT NULL"))) == [(2,)]


def test_distinct_campaigns(harvest):
    assert rows(distinct_campaigns(harvest)) == [(14,), (15,), (16,)]


def test_explore(harvest):
    found = plans.explore(harvest, "production", "mayor o igual que", "50.5")
    assert rows(found.matches) == [(3,)]
    assert sorted(r.production for r in found.rows.collect()) == [50.5, 80.0, 100.0]
    assert found.rows.columns == HARVEST_SCHEMA.names
    with pytest.raises(ValueError):
        plans.explore(harvest, "variety", "igual a", "tinta")


def test_files_completed_in_file_order(spark, tmp_path):
    titles = [*list(HARVEST_HEADERS)[:9], "AREA", "PRODUCCION"]
    lines = ["|".join("" if v is None else str(v) for v in row) for row in ROWS]
    (tmp_path / "harvest.txt").write_text("\n".join(["|".join(titles), *lines]) + "\n", encoding="utf-8")
    (tmp_path / "predictions.txt").write_text("2|009|2|0|1|1.0|-4.5\n1|009|1|0|1|1.0|60.25\n")
    harvest = read_harvest(spark, str(tmp_path / "harvest.txt"))
    predictions = read_predictions(spark, str(tmp_path / "predictions.txt"))
    by_place = plans.complete_by_position(harvest, predictions, 7)
    assert by_place.columns == HARVEST_SCHEMA.names
    expected = ROWS[:7] + [(*ROWS[7][:-1], -4.5), (*ROWS[8][:-1], 60.25)]
    assert sorted(map(repr, rows(by_place))) == sorted(map(repr, expected))
    by_key = plans.complete_by_key(harvest, predictions, 15)
    expected = ROWS[:7] + [(*ROWS[7][:-1], 60.25), (*ROWS[8][:-1], -4.5)]
    assert sorted(map(repr, rows(by_key))) == sorted(map(repr, expected))
    with pytest.raises(ValueError):
        plans.complete_by_position(harvest, predictions, 6)
