"""Declared schemas and the choices a user may pick from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

HARVEST_SCHEMA = T.StructType(
    [
        T.StructField("campaign", T.IntegerType()),
        T.StructField("farm_id", T.IntegerType()),
        T.StructField("zone", T.IntegerType()),
        T.StructField("station", T.IntegerType()),
        T.StructField("altitude", T.StringType()),
        T.StructField("variety", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("color", T.IntegerType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("production", T.DoubleType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("farm_id", T.IntegerType()),
        T.StructField("variety", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("color", T.IntegerType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("production", T.DoubleType()),
    ]
)

# Columns that identify one prediction; unique by contract.
PREDICTION_KEY = ["farm_id", "variety", "mode", "type", "color"]

# Column titles of harvest files and the labels users choose from.
HARVEST_HEADERS = {
    "CAMPAÑA": "campaign",
    "ID_FINCA": "farm_id",
    "ID_ZONA": "zone",
    "ID_ESTACION": "station",
    "ALTITUD": "altitude",
    "VARIEDAD": "variety",
    "MODO": "mode",
    "TIPO": "type",
    "COLOR": "color",
    "PRODUCCION": "production",
}
DIMENSIONS = {
    "Estación Meteorológica": "station",
    "Zona": "zone",
    "Variedad": "variety",
    "Modo": "mode",
    "Tipo": "type",
    "Color": "color",
}
STATISTICS = {"Producción media": "mean", "Producción total": "total"}
COMPARISONS = {
    "igual a": "eq",
    "distinto de": "ne",
    "mayor que": "gt",
    "mayor o igual que": "ge",
    "menor que": "lt",
    "menor o igual que": "le",
}

# A farm profile offers every dimension but the zone.
PROFILE_DIMENSIONS = {label: name for label, name in DIMENSIONS.items() if name != "zone"}


def choose(choices: Mapping[str, str], selected: str) -> str:
    """Name behind a label; the name itself is accepted too."""
    if selected in choices:
        return choices[selected]
    if selected in choices.values():
        return selected
    raise ValueError(f"{selected!r} is not one of {sorted(choices.values())}")
