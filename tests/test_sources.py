from datetime import date

import pytest
from pyspark.sql import types as T

from tallyvine.schema import HARVEST_SCHEMA, PREDICTION_SCHEMA
from tallyvine.sources import bad_cells, in_file_order, read_delimited, read_harvest, read_predictions, scratch_path
from tallyvine.sources.delimited import FILE_ORDER

TITLES = "CAMPAÑA|ID_FINCA|ID_ZONA|ID_ESTACION|ALTITUD|VARIEDAD|MODO|TIPO|COLOR|HECTAREAS|PRODUCCION"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_harvest_file(spark, tmp_path):
    path = write(
        tmp_path / "h.txt", TITLES,
        "14|812|1|4|600-620|014|2|0|1|2.35|1740.2",
        "21|447|2|4||040|1|0|1|0.5|",
    )
    df = read_harvest(spark, path)
    assert df.columns == HARVEST_SCHEMA.names
    assert df.schema == HARVEST_SCHEMA
    assert [tuple(r) for r in df.collect()] == [
        (14, 812, 1, 4, "600-620", 14, 2, 0, 1, 2.35, 1740.2),
        (21, 447, 2, 4, None, 40, 1, 0, 1, 0.5, None),
    ]


def test_harvest_columns_in_another_order(spark, tmp_path):
    titles = TITLES.split("|")
    values = dict(zip(titles, "14|812|1|4|600|014|2|0|1|2.35|1740.2".split("|")))
    path = write(tmp_path / "h.txt", "|".join(titles[::-1]), "|".join(values[t] for t in titles[::-1]))
    row = read_harvest(spark, path).head()
    assert (row.campaign, row.farm_id, row.variety, row.area, row.production) == (14, 812, 14, 2.35, 1740.2)


def test_unknown_titles_are_refused(spark, tmp_path):
    path = write(tmp_path / "h.txt", TITLES.replace("COLOR", "COLOUR"), "14|1|1|1|1|1|1|1|1|1|1")
    with pytest.raises(ValueError):
        read_harvest(spark, path)


def test_predictions_file(spark, tmp_path):
    path = write(tmp_path / "p.txt", "812|014|2|0|0|2.35|1740.2", "604|021|2|0|1|0|-87.4")
    df = read_predictions(spark, path)
    assert df.schema == PREDICTION_SCHEMA
    assert [tuple(r) for r in df.collect()] == [
        (812, 14, 2, 0, 0, 2.35, 1740.2), (604, 21, 2, 0, 1, 0.0, -87.4),
    ]


@pytest.mark.parametrize("marker", ["NA", "N/A", "NaN", "nan", "null", "NULL", "<NA>", "#N/A", ""])
def test_markers_of_missing_values_are_null_in_every_type(spark, tmp_path, marker):
    path = write(tmp_path / "p.txt", f"{marker}|{marker}|{marker}|{marker}|{marker}", " NA |1|2020-01-02|x NA|true")
    found = read_delimited(spark, path, T._parse_datatype_string("i int, d double, t date, s string, b boolean"), header=False)
    assert [tuple(r) for r in found.collect()] == [(None,) * 5, (None, 1.0, date(2020, 1, 2), "x NA", True)]
    kept = read_delimited(spark, path, T._parse_datatype_string("a string, b string, c string, d string, e string"), header=False, missing=())
    assert kept.head().a in (marker, None)


def test_markers_of_ones_own(spark, tmp_path):
    path = write(tmp_path / "p.txt", "-9|-9.0|inf", "1|NaN|2.5 ")
    found = read_delimited(spark, path, T._parse_datatype_string("i int, d double, e double"), header=False, missing=("-9", "-9.0"))
    assert [str(tuple(r)) for r in found.collect()] == ["(None, None, inf)", "(1, nan, 2.5)"]


@pytest.mark.parametrize("cell", ["nine", "1.5", "1e3", "1_000", "99999999999", "0x1"])
def test_cells_that_do_not_fit_fail_with_their_column(spark, tmp_path, cell):
    path = write(tmp_path / "p.txt", "812|14|2|0|0|2.35|1740.2", f"812|{cell}|2|0|0|2.35|1740.2")
    found = read_predictions(spark, path)
    with pytest.raises(Exception, match=f"cell '{cell}' in column 'variety' of .*p.txt is no int"):
        found.collect()
    assert found.select("farm_id").count() == 2


@pytest.mark.parametrize("cell", ["1.5d", "1f", "--1", "1,5"])
def test_cells_that_are_no_double_fail(spark, tmp_path, cell):
    path = write(tmp_path / "p.txt", f"812|14|2|0|0|2.35|{cell}")
    with pytest.raises(Exception, match="column 'production'"):
        read_predictions(spark, path).collect()


def test_rows_of_other_lengths_fail(spark, tmp_path):
    for row in ("812|14|2|0|0|2.35", "812|14|2|0|0|2.35|1|2"):
        path = write(tmp_path / f"{len(row)}.txt", row)
        with pytest.raises(Exception, match="MALFORMED"):
            read_predictions(spark, path).collect()


def test_report_of_bad_cells(spark, tmp_path):
    path = write(
        tmp_path / "p.txt", "3|14|2|0|0|2.35|1740.2", "2|nine|2|0|0|2.35|x", "1|ten|2|0|0|NA|", "4|NA|2|0|zero|y|1"
    )
    found = {tuple(r) for r in bad_cells(spark, path, PREDICTION_SCHEMA, header=False).collect()}
    assert found == {
        ("variety", 2, "1|ten|2|0|0|NA|", "ten"),
        ("production", 1, "2|nine|2|0|0|2.35|x", "x"),
        ("color", 1, "4|NA|2|0|zero|y|1", "zero"),
        ("area", 1, "4|NA|2|0|zero|y|1", "y"),
    }
    good = write(tmp_path / "good.txt", "3|14|2|0|0|2.35|NA")
    assert bad_cells(spark, good, PREDICTION_SCHEMA, header=False).collect() == []
    assert bad_cells(spark, good, T._parse_datatype_string("a string, b string, c string, d string, e string, f string, g string"), header=False).collect() == []


def test_inference_leaves_markers_out(spark, tmp_path):
    path = write(tmp_path / "p.txt", "a|b|c|d|e", "1|1.5|3000000000|NA|x", "NA|NaN|null||7")
    found = read_delimited(spark, path, infer=True)
    assert [kind for _, kind in found.dtypes] == ["int", "double", "bigint", "string", "string"]
    assert [tuple(r) for r in found.collect()] == [(1, 1.5, 3000000000, None, "x"), (None, None, None, None, "7")]


def test_without_schema(spark, tmp_path):
    path = write(tmp_path / "p.txt", "812|014|x", "|7|y")
    assert read_delimited(spark, path, header=False).columns == ["_c0", "_c1", "_c2"]
    inferred = read_delimited(spark, path, header=False, infer=True)
    assert [t for _, t in inferred.dtypes] == ["int", "int", "string"]
    assert tuple(inferred.collect()[1]) == (None, 7, "y")


def test_file_order_over_many_splits(spark, tmp_path):
    for part in range(3):
        write(tmp_path / f"part-{part}.txt", *[f"{part * 1000 + i}|{'x' * (i % 50)}" for i in range(1000)])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        tagged = in_file_order(read_delimited(spark, str(tmp_path), header=False))
        assert tagged.select("file_path", "file_block").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [int(r._c0) for r in tagged.orderBy(*FILE_ORDER).collect()] == list(range(3000))


def test_scratch_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert configured and scratch_path(spark).startswith(configured.rstrip("/"))
    assert scratch_path(spark) != scratch_path(spark)
