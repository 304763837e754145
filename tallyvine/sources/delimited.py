"""Pipe-delimited files with declared schemas.

Cells are read as text and cast per declared column, so that a marker of a missing value is a
null whatever the type of its column. A column that is not selected is neither cast nor checked.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvine.schema import HARVEST_HEADERS, HARVEST_SCHEMA, PREDICTION_SCHEMA
from tallyvine.sources.scratch import store

FILE_ORDER = ["file_path", "file_block", "file_line"]

# Cells that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)


def _name(field: str) -> str:
    return f"`{field.replace('`', '``')}`"


def _cells(spark: SparkSession, path: str, names: Sequence[str] | None, header: bool) -> DataFrame:
    """The file as text cells; a row with too few or too many cells fails the job."""
    reader = spark.read.options(sep="|", header=header, mode="FAILFAST")
    if names is not None:
        as_text = T.StructType([T.StructField(name, T.StringType()) for name in names])
        reader = reader.schema(as_text).option("enforceSchema", not header)
    return reader.csv(path)


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _fractional(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


# Expressions are SQL text: a wide file has many columns, and each costs one call this way.


def _absent(field: T.StructField, missing: Sequence[str]) -> str:
    """Whether the cell stands for a missing value. Blanks around it count in text only."""
    cell = _name(field.name)
    if not missing:
        return f"{cell} IS NULL"
    if isinstance(field.dataType, T.StringType):
        return f"({cell} IS NULL OR {cell} IN ({', '.join(map(_text, missing))}))"
    return f"({cell} IS NULL OR rlike(trim({cell}), {_text('^(' + '|'.join(map(re.escape, missing)) + ')$')}))"


def _suffixed(field: T.StructField) -> str:
    """Whether a number has a suffix of its type, which is no part of a number."""
    return f"rlike({_name(field.name)}, '[0-9.][ ]*[dDfF][ ]*$')" if _fractional(field) else "false"


def _value(field: T.StructField, missing: Sequence[str]) -> str:
    """The cell as a value of the declared type, null where it is missing or none."""
    fits = f"NOT {_absent(field, missing)} AND NOT {_suffixed(field)}"
    return f"CASE WHEN {fits} THEN try_cast({_name(field.name)} AS {field.dataType.simpleString()}) END"


def _bad(field: T.StructField, missing: Sequence[str]) -> str:
    return f"(NOT {_absent(field, missing)} AND ({_value(field, missing)}) IS NULL)"


def _typed(field: T.StructField, missing: Sequence[str]) -> Column:
    cell, absent = _name(field.name), _absent(field, missing)
    if isinstance(field.dataType, T.StringType):
        return F.expr(f"CASE WHEN NOT {absent} THEN {cell} END").alias(field.name)
    kind = field.dataType.simpleString()
    value = f"try_cast({cell} AS {kind})"
    # Most cells are plain values; only the others are compared with the markers.
    plain = f"{value} IS NOT NULL"
    if _fractional(field):
        plain += f" AND NOT isnan({value}) AND NOT substring({cell}, -1, 1) IN ('d', 'D', 'f', 'F', ' ')"
    if not set(missing) <= set(MISSING):
        plain += f" AND NOT {absent}"
    column, ending = _text(f"' in column '{field.name}' of "), _text(f" is no {kind}")
    said = f"concat('cell \\'', {cell}, {column}, input_file_name(), {ending})"
    return F.expr(
        f"""CASE WHEN {plain} THEN {value} WHEN {absent} THEN NULL
            WHEN {value} IS NULL OR {_suffixed(field)} THEN cast(raise_error({said}) AS {kind}) ELSE {value} END"""
    ).alias(field.name)


def _inferred(cells: DataFrame, missing: Sequence[str]) -> T.StructType:
    """The narrowest of int, bigint, double and string that holds all cells of each column, in one pass."""
    types = [T.IntegerType(), T.LongType(), T.DoubleType()]
    tests = []
    for i, name in enumerate(cells.columns):
        tests.append(F.expr(f"count_if(NOT {_absent(T.StructField(name, T.IntegerType()), missing)})").alias(f"{i}"))
        for j, kind in enumerate(types):
            tests.append(F.expr(f"count({_value(T.StructField(name, kind), missing)})").alias(f"{i}_{j}"))
    found = cells.agg(*tests).first()
    fields = []
    for i, name in enumerate(cells.columns):
        fitting = [kind for j, kind in enumerate(types) if found[f"{i}"] and found[f"{i}_{j}"] == found[f"{i}"]]
        fields.append(T.StructField(name, fitting[0] if fitting else T.StringType()))
    return T.StructType(fields)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    header: bool = True,
    infer: bool = False,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Scan ``|``-separated text. Cells of ``missing`` are null in columns of any type.

    A cell that is read and does not fit the schema fails the job with its column and file;
    ``bad_cells`` counts them all with a row of each. With a header and a schema, every file's
    titles are checked against the schema. Without a schema columns are text (or inferred on
    request, by one pass over the file), and headerless columns are named by position, ``_c0`` onwards.
    """
    cells = _cells(spark, path, schema.names if schema is not None else None, header)
    if schema is None:
        text = T.StructType([T.StructField(name, T.StringType()) for name in cells.columns])
        schema = _inferred(cells, missing) if infer else text
    return cells.select(*[_typed(field, missing) for field in schema.fields])


def bad_cells(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, missing: Sequence[str] = MISSING
) -> DataFrame:
    """Per column with cells that do not fit: column, bad (their number), and the first such row with its cell.

    One pass; counted before the shuffle, which carries one row per task and column.
    """
    cells = _cells(spark, path, schema.names, header)
    row = F.concat_ws("|", *[F.coalesce(F.col(_name(name)), F.lit("")) for name in schema.names])
    found = []
    for field in schema.fields:
        if isinstance(field.dataType, T.StringType):
            continue
        told = F.struct(F.lit(field.name).alias("column"), F.col(_name(field.name)).alias("cell"))
        found.append(F.when(F.expr(_bad(field, missing)), told))
    if not found:
        found = [F.lit(None).cast("struct<column:string,cell:string>")]
    each = cells.select(row.alias("row"), F.explode(F.array_compact(F.array(*found))).alias("found")).select("row", "found.*")
    first = F.min(F.struct("row", "cell")).alias("first")
    counted = each.groupBy("column").agg(F.count(F.lit(1)).alias("bad"), first)
    return counted.select("column", "bad", F.col("first.row").alias("row"), F.col("first.cell").alias("cell"))


def read_harvest(spark: SparkSession, path: str) -> DataFrame:
    """Harvest file with titles, in any column order, under this library's names and types.

    The one column whose title is not fixed is taken as the area.
    """
    titles = read_delimited(spark, path).columns
    unnamed = [title for title in titles if title not in HARVEST_HEADERS]
    missing = [title for title in HARVEST_HEADERS if title not in titles]
    if missing or len(unnamed) > 1:
        raise ValueError(f"harvest file lacks {missing} or has unknown columns {unnamed}")
    names = [HARVEST_HEADERS.get(title, "area") for title in titles]
    as_titled = T.StructType(
        [T.StructField(title, HARVEST_SCHEMA[name].dataType) for title, name in zip(titles, names)]
    )
    return read_delimited(spark, path, as_titled).toDF(*names)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless predictions."""
    return read_delimited(spark, path, PREDICTION_SCHEMA, header=False)


def read_batch(spark: SparkSession, path: str, schema: T.StructType = PREDICTION_SCHEMA) -> DataFrame:
    """An uploaded batch of farms, in the columns of ``schema`` with an empty production.

    With titles the columns may stand in any order, and the one without a fixed title is the
    area. Without titles they stand in the order of ``schema``. A production column may be
    there or not; it is not read.
    """
    first = read_delimited(spark, path, header=False).head()
    cells = list(first) if first else []
    titled = any(cell in HARVEST_HEADERS for cell in cells)
    described = schema.names[:-1]
    names = [HARVEST_HEADERS.get(cell, "area") for cell in cells] if titled else schema.names[: len(cells)]
    if cells and (sorted(set(names) - {"production"}) != sorted(described) or len(names) != len(cells)):
        raise ValueError(f"a batch has the columns {described}, not {cells}")
    if len(set(names)) < len(names):
        raise ValueError(f"columns of a batch met twice: {cells}")
    if not cells:
        return spark.createDataFrame([], schema)
    titles = cells if titled else names
    declared = T.StructType([T.StructField(t, schema[n].dataType) for t, n in zip(titles, names)])
    farms = read_delimited(spark, path, declared, header=titled).toDF(*names).select(*described)
    return farms.withColumn("production", F.lit(None).cast("double"))


def in_file_order(df: DataFrame) -> DataFrame:
    """Add the columns ``FILE_ORDER``, by which rows sort as they stand in the files.

    To be called on a file scan as read. A block is read front to back by one task, so
    the running id orders its lines. Stored, so that later passes agree on it.
    """
    return store(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("file_block"),
            F.monotonically_increasing_id().alias("file_line"),
        )
    )
