import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallyvine.queries import registry
from tallyvine.schema import PREDICTION_SCHEMA
from tallyvine.session import settings_for

ROWS_ONLY = set()


def test_flagship(spark):
    found = entry(spark)
    assert found.columns == ["station", "campaign", "production", "code"]
    assert [r.code for r in found.collect()] == list(range(found.count()))


def test_every_query_has_sql_or_is_known_not_to():
    own = registry()
    assert set(own) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries())


def test_components(spark, tables):
    found = queries()["pca_2d"](spark, tables)
    assert found.count() == spark.read.parquet(f"{tables}/embeddings.parquet").count()


def test_batch_prediction(spark, tables):
    found = queries()["batch_prediction"](spark, tables).cache()
    assert found.columns == PREDICTION_SCHEMA.names
    open_rows = spark.read.parquet(f"{tables}/lineitem.parquet").where("l_shipdate >= '2001-01-01'")
    assert found.count() == open_rows.count()
    assert found.where("production IS NULL OR isnan(production)").count() == 0


@pytest.mark.parametrize("name", ["explorer_sorted", "campaign_totals", "share_by_station"])
def test_order_of_results(spark, tables, name):
    rows = queries()[name](spark, tables).collect()
    key = {
        "explorer_sorted": lambda r: -r.production,
        "campaign_totals": lambda r: r.campaign,
        "share_by_station": lambda r: (-r.n, r.station),
    }[name]
    assert [key(r) for r in rows] == sorted(key(r) for r in rows)


def test_shuffle_size_follows_the_input():
    assert settings_for(10**9)["spark.sql.shuffle.partitions"] == "200"
    assert settings_for(100 * 10**12)["spark.sql.shuffle.partitions"] == "476838"
