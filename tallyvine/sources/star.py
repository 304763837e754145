"""The harvest fact read from star-schema Parquet: line items described by their part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvine.schema import HARVEST_SCHEMA
from tallyvine.sources.tables import read_table

# Where each harvest column comes from; the campaign is the year of l_shipdate.
LINEITEM_COLUMNS = {
    "farm_id": "l_suppkey",
    "zone": "l_linenumber",
    "altitude": "l_discount",
    "mode": "l_linestatus",
    "type": "l_returnflag",
    "area": "l_quantity",
    "production": "l_extendedprice",
}
PART_COLUMNS = {"station": "p_brand", "variety": "p_size", "color": "p_type"}
ROW_IDENTITY = ["source_file", "source_row"]


def harvest_facts(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str] | None = None,
    first: int | None = None,
    last: int | None = None,
    identity: bool = False,
    undated: bool = False,
) -> DataFrame:
    """Harvest rows with ``columns`` (default: all), of the campaigns ``first`` to ``last``.

    The campaign bounds are put on the raw timestamp, so they reach the Parquet reader.
    The part table is joined only when one of its columns is asked for. No join hint is
    given: its size decides between a broadcast and a shuffled join, whose hot
    keys adaptive execution splits. ``identity`` adds the place of the row in its file,
    ``undated`` keeps rows without a campaign below an upper bound.
    """
    columns = list(columns or HARVEST_SCHEMA.names)
    items = read_table(spark, folder, "lineitem")
    shipped = F.col("l_shipdate")
    if first is not None:
        items = items.where(shipped >= F.lit(f"{first}-01-01").cast("timestamp_ntz"))
    if last is not None:
        early = shipped < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz")
        items = items.where(shipped.isNull() | early if undated else early)
    place = []
    if identity:
        place = [
            F.xxhash64("_metadata.file_path").alias("source_file"),
            F.col("_metadata.row_index").alias("source_row"),
        ]
    one_campaign = first is not None and first == last
    items = items.select(
        (F.lit(first) if one_campaign else F.year(shipped)).alias("campaign"),
        *[F.col(source).alias(name) for name, source in LINEITEM_COLUMNS.items()],
        "l_partkey",
        *place,
    )
    described = [name for name in columns if name in PART_COLUMNS]
    if described:
        parts = read_table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            *[F.col(PART_COLUMNS[name]).alias(name) for name in described],
        )
        items = items.join(parts, "l_partkey", "left")
    return items.select(*columns, *(ROW_IDENTITY if identity else []))
