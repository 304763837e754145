"""The registered queries. Each takes a session and a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine import operators as ops
from tallyvine import plans, sources
from tallyvine.functions import mean
from tallyvine.operators import learning
from tallyvine.operators.neighbours import knn_classify as classify
from tallyvine.operators.neighbours import knn_classify_up_to
from tallyvine.plans.prediction import fit_yield_model, predict_batch
from tallyvine.schema import (
    DIMENSIONS,
    HARVEST_SCHEMA,
    PREDICTION_KEY,
    PREDICTION_SCHEMA,
    PROFILE_DIMENSIONS,
)
from tallyvine.sources.star import ROW_IDENTITY, harvest_facts
from tallyvine.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

CAMPAIGN = 1998
LAST_CLOSED = 2000
NEIGHBOURS = 5
#: The most neighbours that a user may choose.
MOST_NEIGHBOURS = 15
PAGE_ROWS = 100
EVENTS_BEFORE = "2024-01-08 06:30:00.5"


def campaign_totals(spark: SparkSession, folder: str) -> DataFrame:
    return plans.campaign_series(
        harvest_facts(spark, folder, ["campaign", "production"], last=LAST_CLOSED), LAST_CLOSED
    )


def production_by(dimension: str, statistic: str, spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(
        spark, folder, [dimension, "campaign", "production"], first=CAMPAIGN, last=CAMPAIGN
    )
    return plans.production_report(facts, dimension, CAMPAIGN, statistic)


def each_campaign(statistic: str, spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(spark, folder, ["station", "campaign", "production"])
    produced = ops.production_by(facts, "Estación Meteorológica", statistic)
    return produced.orderBy("station", "campaign")


def share_by(dimension: str, spark: SparkSession, folder: str) -> DataFrame:
    return plans.farm_profile(harvest_facts(spark, folder, [dimension, "farm_id"]), dimension).categories


def share_by_mode_one_campaign(spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(
        spark, folder, ["mode", "farm_id", "campaign"], first=CAMPAIGN, last=CAMPAIGN
    )
    return plans.farm_profile(facts, "mode", CAMPAIGN).categories


def frequency_by_station(spark: SparkSession, folder: str) -> DataFrame:
    return ops.category_frequency(harvest_facts(spark, folder, ["station"]), "station")


def frequency_total(spark: SparkSession, folder: str) -> DataFrame:
    return ops.grand_total(frequency_by_station(spark, folder))


def distinct_farms(spark: SparkSession, folder: str) -> DataFrame:
    return plans.farm_profile(harvest_facts(spark, folder, ["mode", "farm_id"]), "mode").farms


def distinct_farms_one_campaign(spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(
        spark, folder, ["mode", "farm_id", "campaign"], first=CAMPAIGN, last=CAMPAIGN
    )
    return plans.farm_profile(facts, "mode", CAMPAIGN).farms


def distinct_campaigns(spark: SparkSession, folder: str) -> DataFrame:
    return ops.distinct_campaigns(harvest_facts(spark, folder, ["campaign"]))


def explorer(column: str, comparison: str, text: str, spark: SparkSession, folder: str) -> DataFrame:
    return plans.explore(harvest_facts(spark, folder), column, comparison, text).rows


def filter_ne(spark: SparkSession, folder: str) -> DataFrame:
    """Zone 2 is blanked first: rows of unknown zone count as different."""
    facts = harvest_facts(spark, folder).withColumn("zone", F.nullif("zone", F.lit(2)))
    return plans.explore(facts, "zone", "distinto de", "3").rows


def filter_count(spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(spark, folder, ["production"])
    return plans.explore(facts, "production", "mayor que", "30000").matches


def explorer_sorted(spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(spark, folder, identity=True)
    rows = plans.explore(facts, "production", "mayor o igual que", "30000").rows
    return ops.sort_rows(rows, "production", ascending=False, ties=ROW_IDENTITY).drop(*ROW_IDENTITY)


def explorer_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of the explorer sorted by production, from the largest; equal rows by their place in the file."""
    facts = harvest_facts(spark, folder, identity=True)
    rows = plans.explore(facts, "production", "menor o igual que", "30000").rows
    ties, end = [name for name in rows.columns if name != "production"], None
    for _ in range(2):
        end = ops.page_end(ops.page_rows(rows, "production", PAGE_ROWS, False, ties, end), "production", ties)
    return ops.page_rows(rows, "production", PAGE_ROWS, False, ties, end).drop(*ROW_IDENTITY)


def filter_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return ops.filter_rows(events, "ts", "menor que", EVENTS_BEFORE).select("event_id", "event_type", "value")


def campaign_split(spark: SparkSession, folder: str) -> DataFrame:
    return ops.closed_campaigns(harvest_facts(spark, folder, last=LAST_CLOSED), LAST_CLOSED)


def row_positions(spark: SparkSession, folder: str) -> DataFrame:
    return ops.with_position(read_table(spark, folder, "events"), ["ts", "event_id"])


def row_split(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return ops.split_at(events, floor(0.9 * events.count()), ["ts", "event_id"])[0]


def column_by_position(spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(spark, folder)
    return ops.column_at(facts, HARVEST_SCHEMA.names.index("production"))


def positional_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The last events, one per customer, take the customers' balances in order of their keys."""
    events, customers = read_table(spark, folder, "events"), read_table(spark, folder, "customer")
    rows = events.count()
    return ops.fill_by_position(
        events,
        rows - customers.count(),
        ["ts", "event_id"],
        "value",
        customers,
        "c_acctbal",
        ["c_custkey"],
        rows,
    )


def keyed_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Open campaigns take the mean production that the same vines had in the last closed one."""
    closed = harvest_facts(spark, folder, last=LAST_CLOSED, undated=True)
    open_rows = harvest_facts(spark, folder, first=LAST_CLOSED + 1)
    last = harvest_facts(
        spark, folder, [*PREDICTION_KEY, "production"], first=LAST_CLOSED, last=LAST_CLOSED
    )
    predictions = last.groupBy(*PREDICTION_KEY).agg(mean("production").alias("production"))
    return ops.fill_open_by_key(closed, open_rows, PREDICTION_KEY, "production", predictions, "production")


def delimited_scan_header(spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(spark, folder)
    path = sources.scratch_path(spark)
    facts.write.options(sep="|", header=True).csv(path)
    return sources.read_delimited(spark, path, facts.schema)


def delimited_scan_headerless(spark: SparkSession, folder: str) -> DataFrame:
    facts = harvest_facts(spark, folder, PREDICTION_SCHEMA.names)
    path = sources.scratch_path(spark)
    facts.write.options(sep="|", header=False).csv(path)
    return sources.read_delimited(spark, path, facts.schema, header=False)


def _written_with_gaps(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The facts as a file in which some cells of every column hold a marker of a missing value."""
    facts = harvest_facts(spark, folder)
    at = F.col("zone") + F.col("farm_id")
    gaps = zip(facts.columns, ["NA", "N/A", "null", "NaN", "", "#N/A", "nan", "NULL", "n/a", " NA ", "<NA>"], strict=True)
    cells = [
        F.when(at % 11 == place, F.lit(marker)).otherwise(F.col(name).cast("string")).alias(name)
        for place, (name, marker) in enumerate(gaps)
    ]
    path = sources.scratch_path(spark)
    facts.select(*cells).write.options(sep="|", header=True).csv(path)
    return path, facts


def delimited_missing(spark: SparkSession, folder: str) -> DataFrame:
    path, facts = _written_with_gaps(spark, folder)
    return sources.read_delimited(spark, path, facts.schema)


def delimited_bad_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a file whose prices above 50,000 have a unit and whose zone 7 is written in words."""
    facts = harvest_facts(spark, folder, ["farm_id", "zone", "production"])
    price = F.when(F.col("production") > 50_000, F.concat(F.col("production").cast("int").cast("string"), F.lit(" kg")))
    written = facts.select(
        "farm_id",
        F.when(F.col("zone") == 7, F.lit("seven")).otherwise(F.col("zone").cast("string")).alias("zone"),
        F.coalesce(price, F.lit("NA")).alias("production"),
    )
    path = sources.scratch_path(spark)
    written.write.options(sep="|", header=True).csv(path)
    return sources.bad_cells(spark, path, facts.schema)


def file_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Harvest and predictions as sorted files; the open rows at the end take one prediction each."""
    facts = harvest_facts(spark, folder)
    harvest_path, predictions_path = sources.scratch_path(spark), sources.scratch_path(spark)
    facts.orderBy(*facts.columns).write.options(sep="|", header=True).csv(harvest_path)
    farms = harvest_facts(spark, folder, PREDICTION_SCHEMA.names, first=LAST_CLOSED + 1)
    farms = farms.withColumn("production", F.col("area") * -100.25)
    farms.orderBy(*farms.columns).write.options(sep="|").csv(predictions_path)
    return plans.complete_by_position(
        sources.read_delimited(spark, harvest_path, facts.schema),
        sources.read_delimited(spark, predictions_path, farms.schema, header=False),
        harvest_facts(spark, folder, ["campaign"], last=LAST_CLOSED).count(),
    )


def categorical_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of the stations, of which one is blanked."""
    facts = harvest_facts(spark, folder).withColumn("station", F.nullif("station", F.lit("Brand#7")))
    return ops.ordered_codes(facts, "station")


def _blanked_altitude(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose altitude of 0.05 is no number."""
    facts = harvest_facts(spark, folder, ["farm_id", "altitude"], identity=True)
    blank = F.when(F.col("altitude") == 0.05, F.lit(float("nan"))).otherwise(F.col("altitude"))
    return facts.withColumn("altitude", blank)


def codes_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    coded = ops.ordered_codes(_blanked_altitude(spark, folder).drop(*ROW_IDENTITY), "altitude")
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min(F.nanvl("altitude", F.lit(-1.0))).alias("least"))


def sorted_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    rows = ops.sort_rows(_blanked_altitude(spark, folder), "altitude", ascending=False, ties=ROW_IDENTITY)
    return rows.select("farm_id", F.nanvl("altitude", F.lit(-1.0)).alias("altitude"))


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return learning.class_counts(read_table(spark, folder, "embeddings"))


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = learning.train_test_split(read_table(spark, folder, "embeddings"), "vec_id")
    return (
        train.withColumn("part", F.lit("train"))
        .unionByName(test.withColumn("part", F.lit("test")))
        .select("vec_id", "label", "part")
    )


def knn_classify(spark: SparkSession, folder: str) -> DataFrame:
    train, test = learning.train_test_split(read_table(spark, folder, "embeddings"), "vec_id")
    return classify(train, test, "vec_id", "embedding", "label", NEIGHBOURS)


def knn_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return learning.accuracy(knn_classify(spark, folder))


def knn_accuracy_by_k(spark: SparkSession, folder: str) -> DataFrame:
    train, test = learning.train_test_split(read_table(spark, folder, "embeddings"), "vec_id")
    lists = knn_classify_up_to(train, test, "vec_id", "embedding", "label", MOST_NEIGHBOURS)
    return learning.accuracy_by_k(lists)


def pca_2d(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with six decimals."""
    scores = learning.principal_components(read_table(spark, folder, "embeddings"), "vec_id", "embedding")
    return scores.select("vec_id", *[(F.round(name, 6) + F.lit(0.0)).alias(name) for name in ("pc1", "pc2")])


def batch_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """Learn from closed campaigns; predict the farms of the open ones, uploaded as a file."""
    model = fit_yield_model(harvest_facts(spark, folder, last=LAST_CLOSED))
    farms = harvest_facts(spark, folder, PREDICTION_SCHEMA.names, first=LAST_CLOSED + 1)
    path = sources.scratch_path(spark)
    farms.drop("production").write.options(sep="|").csv(path)
    return predict_batch(model, sources.read_batch(spark, path, farms.schema))


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {"campaign_totals": campaign_totals}
    for dimension in DIMENSIONS.values():
        found[f"sum_by_{dimension}"] = partial(production_by, dimension, "Producción total")
        found[f"mean_by_{dimension}"] = partial(production_by, dimension, "Producción media")
    found["sum_by_station_each_campaign"] = partial(each_campaign, "Producción total")
    found["mean_by_station_each_campaign"] = partial(each_campaign, "Producción media")
    for dimension in PROFILE_DIMENSIONS.values():
        found[f"share_by_{dimension}"] = partial(share_by, dimension)
    found |= {
        "share_by_mode_one_campaign": share_by_mode_one_campaign,
        "frequency_by_station": frequency_by_station,
        "frequency_total": frequency_total,
        "distinct_farms": distinct_farms,
        "distinct_farms_one_campaign": distinct_farms_one_campaign,
        "distinct_campaigns": distinct_campaigns,
        "filter_eq": partial(explorer, "zone", "igual a", " 03 "),
        "filter_ne": filter_ne,
        "filter_gt": partial(explorer, "production", "mayor que", "30000"),
        "filter_ge": partial(explorer, "area", "mayor o igual que", "25"),
        "filter_lt": partial(explorer, "station", "menor que", "Brand#2"),
        "filter_le": partial(explorer, "production", "menor o igual que", "30000.5"),
        "filter_count": filter_count,
        "explorer_sorted": explorer_sorted,
        "explorer_page": explorer_page,
        "filter_timestamp": filter_timestamp,
        "campaign_split": campaign_split,
        "row_positions": row_positions,
        "row_split": row_split,
        "column_by_position": column_by_position,
        "positional_fill": positional_fill,
        "keyed_fill": keyed_fill,
        "delimited_scan_header": delimited_scan_header,
        "delimited_scan_headerless": delimited_scan_headerless,
        "delimited_missing": delimited_missing,
        "delimited_bad_cells": delimited_bad_cells,
        "file_completion": file_completion,
        "categorical_codes": categorical_codes,
        "codes_with_nan": codes_with_nan,
        "sorted_with_nan": sorted_with_nan,
        "class_counts": class_counts,
        "hash_split": hash_split,
        "knn_classify": knn_classify,
        "knn_accuracy": knn_accuracy,
        "knn_accuracy_by_k": knn_accuracy_by_k,
        "pca_2d": pca_2d,
        "batch_prediction": batch_prediction,
    }
    return found
