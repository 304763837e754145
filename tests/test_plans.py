"""What Spark makes of the queries: pushdown, pruning, joins and shuffles."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyvine import plans
from tallyvine.operators import fill_by_key, production_by
from tallyvine.operators.positions import split_at
from tallyvine.queries import registry as queries
from tallyvine.sources import harvest_facts, read_table

PACKAGE = Path(__file__).resolve().parents[1] / "tallyvine"
TRAINED = {"pca_2d", "batch_prediction"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, column):
    """Scan lines that read a column."""
    return [line for line in text.splitlines() if "FileScan" in line and column in line]


@pytest.fixture
def settings(spark):
    kept = {}

    def change(**values):
        for name, value in values.items():
            name = "spark.sql." + name.replace("__", ".")
            kept.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, value)

    yield change
    for name, value in kept.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", sorted(set(queries()) - TRAINED))
def test_no_pairwise_joins_and_no_row_at_a_time_python(spark, tables, name):
    text = plan(queries()[name](spark, tables))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if not name.startswith("knn"):
        assert "Python" not in text and "ArrowEval" not in text and "InArrow" not in text


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("filter_gt", "GreaterThan(l_extendedprice,30000.0)"),
        ("filter_ge", "GreaterThanOrEqual(l_quantity,25.0)"),
        ("filter_le", "LessThanOrEqual(l_extendedprice,30000.5)"),
        ("filter_eq", "EqualTo(l_linenumber,3)"),
        ("campaign_split", "LessThan(l_shipdate,2001-01-01T00:00)"),
        ("distinct_farms_one_campaign", "GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)"),
    ],
)
def test_filters_reach_the_scan(spark, tables, name, pushed):
    assert pushed in plan(queries()[name](spark, tables))


def test_not_equal_is_pushed_down(spark, tables):
    rows = plans.explore(harvest_facts(spark, tables), "zone", "distinto de", "3").rows
    assert "Not(EqualNullSafe(l_linenumber,3))" in plan(rows)


def test_only_needed_columns_are_read(spark, tables):
    facts = harvest_facts(spark, tables, ["zone", "campaign", "production"])
    text = plan(production_by(facts, "zone", "total"))
    assert "part.parquet" not in text
    assert set(re.search(r"ReadSchema: struct<(.*?)>", text)[1].split(",")) == {
        "l_linenumber:int", "l_extendedprice:double", "l_shipdate:timestamp_ntz",
    }


def test_aggregates_combine_before_their_one_shuffle(spark, tables):
    text = plan(production_by(harvest_facts(spark, tables), "zone", "mean"))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text.split("Exchange hashpartitioning")[1]


def test_shares_reuse_the_shuffle_of_the_frequencies(spark, tables):
    shares = queries()["share_by_mode"](spark, tables)
    shares.collect()
    final = plan(shares).split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_split_parts_are_plain_scans(spark, tables):
    for part in split_at(read_table(spark, tables, "events"), 1000, ["ts", "event_id"]):
        assert "Exchange" not in plan(part)
    first = plan(split_at(read_table(spark, tables, "events"), 1000, ["ts", "event_id"])[0])
    assert "LessThanOrEqual(ts," in first


def test_closed_rows_are_not_shuffled_by_a_keyed_fill(spark, tables, settings):
    settings(autoBroadcastJoinThreshold="-1")
    facts = harvest_facts(spark, tables, ["campaign", "farm_id", "production"])
    values = facts.groupBy("farm_id").agg(F.max("production").alias("p"))
    closed = plan(fill_by_key(facts, 2000, ["farm_id"], "production", values, "p")).split("Union")[1]
    first_branch = closed.split("SortMergeJoin")[0]
    assert "Exchange" not in first_branch


@pytest.fixture(scope="module")
def lopsided(spark, tables, tmp_path_factory):
    """The tables with a third of the line items on one part."""
    folder = str(tmp_path_factory.mktemp("lopsided"))
    items = read_table(spark, tables, "lineitem")
    hot = F.when(F.xxhash64("l_orderkey", "l_linenumber") % 3 == 0, 7).otherwise(F.col("l_partkey"))
    items.withColumn("l_partkey", hot.cast("bigint")).repartition(16).write.parquet(f"{folder}/lineitem.parquet")
    read_table(spark, tables, "part").write.parquet(f"{folder}/part.parquet")
    return folder


def test_hot_part_is_split_when_its_table_is_not_broadcast(spark, lopsided, settings):
    small = plans.production_report(harvest_facts(spark, lopsided), "station", 1998, "total").collect()
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="64KB",
    )
    rows = harvest_facts(spark, lopsided)
    assert rows.count() == read_table(spark, lopsided, "lineitem").count()
    produced = production_by(rows, "station", "total")
    produced.collect()
    assert "skew=true" in plan(produced)
    assert plans.production_report(rows, "station", 1998, "total").collect() == small


def test_hot_key_is_split_in_a_keyed_fill(spark, lopsided, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="64KB",
    )
    items = read_table(spark, lopsided, "lineitem").select(
        F.year("l_shipdate").alias("campaign"), "l_partkey", F.col("l_extendedprice").alias("production")
    )
    values = items.groupBy("l_partkey").agg(F.max("production").alias("p"))
    filled = fill_by_key(items, 1995, ["l_partkey"], "production", values, "p")
    assert len(filled.collect()) == items.count()
    assert "skew=true" in plan(filled)


def test_library_never_collects_fact_rows():
    allowed = {
        # The labelled rows to fit, of bounded number and size.
        "operators/neighbours.py": 1,
    }
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.relative_to(PACKAGE).parts:  # an optional part with tests of its own
            continue
        calls = len(re.findall(r"\.(?:collect|toArrow|toPandas|toLocalIterator)\(", path.read_text()))
        assert calls == allowed.get(str(path.relative_to(PACKAGE)), 0), path
        assert "localCheckpoint" not in path.read_text()


def test_both_branches_of_a_keyed_fill_are_pruned(spark, tables):
    found = scans(plan(queries()["keyed_fill"](spark, tables)), "l_shipdate")
    assert len(found) == 2 and all(re.search(r"(LessThan|GreaterThanOrEqual)\(l_shipdate,2001", line) for line in found)


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_values_are_computed_by_the_one_write_that_numbers_them(spark, tables):
    facts = harvest_facts(spark, tables, ["station", "campaign", "production"], first=1998, last=1998)
    before = executions(spark)
    report = plans.production_report(facts, "station", 1998, "total")
    assert executions(spark) == before + 1
    assert "lineitem" not in plan(report)
    before = executions(spark)
    coded = queries()["categorical_codes"](spark, tables)
    assert executions(spark) == before + 1
    assert plan(coded).count("lineitem.parquet") == 1


def test_a_positional_fill_reads_each_row_twice(spark, tables):
    """Once to find the boundary, once in one of the two branches; the rest reads stored tables."""
    filled = queries()["positional_fill"](spark, tables)
    text = plan(filled)
    assert len(scans(text, "events.parquet")) == 1 and "LessThanOrEqual(ts," in text
    assert "customer.parquet" not in text
