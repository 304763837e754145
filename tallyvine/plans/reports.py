"""The questions users ask, composed from the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvine.operators.aggregates import (
    category_shares,
    distinct_farms,
    production_by,
    row_count,
    total_by_campaign,
)
from tallyvine.operators.encoding import number_values
from tallyvine.operators.filling import fill_by_key, fill_by_position
from tallyvine.operators.selection import closed_campaigns, filter_rows, for_campaign
from tallyvine.schema import DIMENSIONS, PREDICTION_KEY, choose
from tallyvine.sources.delimited import FILE_ORDER, in_file_order


class FarmProfile(NamedTuple):
    categories: DataFrame
    farms: DataFrame


class Exploration(NamedTuple):
    rows: DataFrame
    matches: DataFrame


def campaign_series(harvest: DataFrame, last_closed: int) -> DataFrame:
    """Total production of each closed campaign."""
    return total_by_campaign(closed_campaigns(harvest, last_closed))


def production_report(
    harvest: DataFrame, dimension: str, campaign: int, statistic: str
) -> DataFrame:
    """Production of one campaign by a dimension, ascending, with the code of each value.

    Codes count the values that occur in this campaign.
    """
    by = choose(DIMENSIONS, dimension)
    produced = production_by(for_campaign(harvest, campaign), by, statistic)
    return number_values(produced, by).orderBy("code")


def farm_profile(
    harvest: DataFrame, dimension: str, campaign: int | None = None
) -> FarmProfile:
    """Rows and percentages per category, and the number of farms, of one or all campaigns."""
    rows = for_campaign(harvest, campaign)
    return FarmProfile(category_shares(rows, dimension), distinct_farms(rows))


def explore(harvest: DataFrame, column: str, comparison: str, text: str) -> Exploration:
    """Rows that match one typed-in comparison, and their number."""
    rows = filter_rows(harvest, column, comparison, text)
    return Exploration(rows, row_count(rows))


def complete_by_position(
    harvest: DataFrame, predictions: DataFrame, closed_rows: int
) -> DataFrame:
    """Harvest whose rows after the first ``closed_rows`` carry the predictions, in file order.

    Both frames must be scans of files as read.
    """
    filled = fill_by_position(
        in_file_order(harvest),
        closed_rows,
        FILE_ORDER,
        "production",
        in_file_order(predictions),
        predictions.columns[-1],
        FILE_ORDER,
    )
    return filled.drop(*FILE_ORDER)


def complete_by_key(harvest: DataFrame, predictions: DataFrame, last_closed: int) -> DataFrame:
    """Harvest whose open campaign carries the prediction for the same farm and vines."""
    return fill_by_key(
        harvest, last_closed, PREDICTION_KEY, "production", predictions, "production"
    )
