import math
import random
from datetime import datetime

import pytest

from tallyvine.operators import positions, sort_rows, split_at, with_position


def shuffled(spark, rows, schema, partitions):
    rows = list(rows)
    random.Random(partitions).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_positions_do_not_depend_on_partitions(spark, partitions):
    rows = [(i % 7, i, f"r{i}") for i in range(500)]
    numbered = with_position(shuffled(spark, rows, "a int, b int, c string", partitions), ["a", "b"])
    found = {(r.a, r.b): r.position for r in numbered.collect()}
    assert found == {(a, b): i for i, (a, b, _) in enumerate(sorted(rows))}


def test_hot_leading_value_is_spread(spark, monkeypatch):
    monkeypatch.setattr(positions, "RANGE_ROWS", 100)
    rows = [(0 if i % 3 else i, i) for i in range(3000)]
    df = shuffled(spark, rows, "a int, b int", 5)
    found = {(r.a, r.b): r.position for r in with_position(df, ["a", "b"]).collect()}
    assert found == {row: i for i, row in enumerate(sorted(rows))}
    ranged = positions.sorted_ranges(df, ["a", "b"], len(rows))
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400


@pytest.mark.parametrize("position", [-1, 0, 1, 250, 499, 500, 501])
def test_split_is_a_partition_of_the_rows(spark, position):
    rows = [(i % 5, i) for i in range(500)]
    first, rest = split_at(shuffled(spark, rows, "a int, b int", 4), position, ["a", "b"])
    cut = max(position, 0)
    assert sorted(map(tuple, first.collect())) == sorted(rows)[:cut]
    assert sorted(map(tuple, rest.collect())) == sorted(rows)[cut:]


def test_split_orders_nulls_first(spark):
    rows = [(None, 1), (None, 2), (1, None), (1, 1), (2, 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    for position in range(6):
        first, rest = split_at(df, position, ["a", "b"])
        assert set(map(tuple, first.collect())) == set(rows[:position])
        assert set(map(tuple, rest.collect())) == set(rows[position:])


def test_split_by_other_types(spark):
    rows = [
        (datetime(2020, 1, 1, 3, 0, 0, 5), 0.1, "é"),
        (datetime(2020, 1, 1, 3, 0, 0, 5), 0.1, "ü"),
        (datetime(2020, 1, 1, 3, 0, 0, 6), -math.inf, "a"),
        (datetime(2021, 7, 1), 1e-300, "b"),
    ]
    df = spark.createDataFrame(rows, "t timestamp_ntz, d double, s string")
    for position in range(5):
        first, _ = split_at(df, position, ["t", "d", "s"])
        assert {r.s for r in first.collect()} == {r[2] for r in rows[:position]}


def test_sorting_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(2, "x"), (None, "y"), (1, "z"), (2, "a")], "n int, s string")
    assert [tuple(r) for r in sort_rows(df, "n").collect()] == [(1, "z"), (2, "a"), (2, "x"), (None, "y")]
    down = [tuple(r) for r in sort_rows(df, "n", ascending=False).collect()]
    assert down == [(2, "a"), (2, "x"), (1, "z"), (None, "y")]


def test_split_between_equal_rows_is_refused(spark):
    df = spark.createDataFrame([(i // 4, i) for i in range(20)], "k int, v int")
    with pytest.raises(ValueError, match="same"):
        split_at(df, 6, ["k"])
    first, rest = split_at(df, 8, ["k"])
    assert (first.count(), rest.count()) == (8, 12)


def test_sorting_puts_nan_with_the_nulls(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (1.0,)], "n double")
    assert [str(r.n) for r in sort_rows(df, "n", ascending=False).collect()] == ["2.0", "1.0", "nan"]
