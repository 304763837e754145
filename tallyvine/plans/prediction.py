"""Yield prediction for a batch of farms, learnt from closed campaigns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.schema import PREDICTION_SCHEMA
from tallyvine.sources.scratch import store

CATEGORIES = ["variety", "mode", "type", "color"]


@dataclass(frozen=True)
class YieldModel:
    """``lines``: per combination of categories _mean, _slope and _start; ``mean``: that of all rows."""

    lines: DataFrame
    mean: float | None


def _hundredths(value: Column) -> Column:
    return F.rint(value * 100).cast("bigint")


def fit_yield_model(closed: DataFrame) -> YieldModel:
    """Per combination of categories, the least-squares line of the production on the area.

    One pass of exact sums over whole hundredths (other values are rounded to them), so the model
    does not depend on the partitioning. Rows without production teach nothing, rows without
    area only the mean. A combination whose areas are all equal has a mean and no line. Null is
    a category like any other.
    """
    number = {name: F.nanvl(F.col(name).cast("double"), F.lit(None)) for name in ("area", "production")}
    known = closed.select(
        *CATEGORIES, _hundredths(number["area"]).alias("x"), _hundredths(number["production"]).alias("y")
    ).where("y is not null")
    y = F.when(F.col("x").isNotNull(), F.col("y"))
    # Products are formed of decimals, whose room is wider than that of integers.
    wide = {"x": F.col("x").cast("decimal(18,0)"), "y": y.cast("decimal(18,0)")}
    sums = store(
        known.groupBy(*CATEGORIES).agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("y").cast("decimal(28,0)")).alias("made"),
            F.count("x").cast("double").alias("n"),
            F.sum(F.col("x").cast("decimal(28,0)")).cast("double").alias("sx"),
            F.sum(y.cast("decimal(28,0)")).cast("double").alias("sy"),
            F.sum(wide["x"] * wide["x"]).cast("double").alias("sxx"),
            F.sum(wide["x"] * wide["y"]).cast("double").alias("sxy"),
            (F.min("x") < F.max("x")).alias("spread"),
        )
    )
    slope = F.when(F.col("spread"), F.expr("(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0)"))
    lines = sums.select("*", slope.alias("_slope")).select(
        *[F.col(name).alias(f"_{name}") for name in CATEGORIES],
        F.expr("cast(made as double) / 100.0D / rows").alias("_mean"),
        "_slope",
        F.expr("(sy - _slope * sx) / (100.0D * nullif(n, 0))").alias("_start"),
    )
    overall = sums.agg(F.expr("cast(sum(made) as double) / 100.0D / nullif(sum(rows), 0)")).first()[0]
    return YieldModel(lines, overall)


def predict_batch(model: YieldModel, batch: DataFrame) -> DataFrame:
    """The batch with its production predicted, in the columns of a predictions file.

    By the line of a farm's categories; without line or area by their mean; for categories
    never met by the mean of all rows.
    """
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in CATEGORIES])
    area = F.nanvl(F.col("area").cast("double"), F.lit(None))
    line = F.col("_start") + F.col("_slope") * area
    predicted = F.coalesce(line, F.col("_mean"), F.lit(model.mean).cast("double"))
    farms = batch.select(*PREDICTION_SCHEMA.names[:-1])
    return farms.join(model.lines, same, "left").select(*farms.columns, predicted.alias("production"))
