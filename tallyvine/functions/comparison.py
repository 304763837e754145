"""Predicates with defined behaviour for nulls, NaN and typed-in values."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from datetime import date
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = re.compile(r"[+-]?[0-9]+")
_LONG_MIN, _LONG_MAX = -(2**63), 2**63 - 1


Literal = int | float | str | bool | date | Decimal


def _read_by_spark(text: str, data_type: T.DataType) -> Literal | None:
    """The value by Spark's own rules; a timestamp, which the session's time zone gives, in microseconds."""
    cell = F.lit(text).try_cast(data_type)
    if isinstance(data_type, T.TimestampType):
        cell = F.unix_micros(cell)
    return SparkSession.active().range(1).select(cell).head()[0]


def _decimal(text: str) -> Decimal | None:
    try:
        value = Decimal(text)
    except InvalidOperation:
        return None
    _, digits, exponent = value.as_tuple()
    if not value.is_finite() or "_" in text:
        return None
    # Digits before and after the point, as Spark counts them.
    whole, scale = max(0, len(digits) + exponent), max(0, -exponent)
    return value if whole + scale <= 38 else None


def parse_literal(text: str, data_type: T.DataType) -> Literal:
    """Value of typed-in text for a column of ``data_type``; ``ValueError`` if it is none.

    Timestamps are microseconds since 1970.
    """
    if isinstance(data_type, T.StringType):
        return text
    stripped = text.strip()
    if isinstance(data_type, T.IntegralType):
        if _INTEGER.fullmatch(stripped) and _LONG_MIN <= int(stripped) <= _LONG_MAX:
            return int(stripped)
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        if "_" not in stripped:
            return float(stripped)
    elif isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.DecimalType)):
        read = _decimal(stripped) if isinstance(data_type, T.DecimalType) else _read_by_spark(stripped, data_type)
        if read is not None:
            return read
    else:
        raise TypeError(f"columns of type {data_type.simpleString()} cannot be filtered")
    raise ValueError(f"{text!r} is not a valid {data_type.simpleString()}")


def literal_of(value: Literal, data_type: T.DataType) -> Column:
    """A parsed value as a constant: of the column's own type where it fits, so that scans can use it."""
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if isinstance(data_type, T.TimestampNTZType):
        return F.lit(str(value)).cast(data_type)
    if isinstance(data_type, T.DecimalType):
        _, digits, exponent = value.as_tuple()
        fits = -exponent <= data_type.scale and len(digits) + exponent <= data_type.precision - data_type.scale
        return F.lit(str(value)).cast(data_type if fits else T.DecimalType(38, max(0, -exponent)))
    return F.lit(value).cast(data_type) if isinstance(data_type, (T.FloatType, T.DoubleType)) else F.lit(value)


def compare(column: Column, operator: str, value: Literal, data_type: T.DataType) -> Column:
    """``column operator value``; only ``ne`` holds for nulls, and NaN equals and exceeds nothing."""
    fractional = isinstance(data_type, (T.FloatType, T.DoubleType))
    if fractional and math.isnan(value):
        return F.lit(operator == "ne")
    literal = literal_of(value, data_type)
    if operator == "eq":
        return column == literal
    if operator == "ne":
        return ~column.eqNullSafe(literal)
    if operator == "lt":
        return column < literal
    if operator == "le":
        return column <= literal
    above = column > literal if operator == "gt" else column >= literal
    # Spark orders NaN above every number.
    return above & ~F.isnan(column) if fractional else above


def known(field: T.StructField) -> Column:
    """The column of ``field``, its NaN as null."""
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(F.col(field.name), F.lit(None).cast(field.dataType))
    return F.col(field.name)


def as_text(field: T.StructField) -> Column:
    """The column of ``field`` as the text of a boundary."""
    column = F.col(field.name)
    return (F.unix_micros(column) if isinstance(field.dataType, T.TimestampType) else column).cast("string")


def _limit(text: str | None, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType):
        return F.timestamp_micros(F.lit(text).cast("long"))
    return F.lit(text).cast(data_type)


def precedes(order: Sequence[T.StructField], boundary: Sequence[str | None]) -> Column:
    """True for rows sorted before the row whose ``order`` columns are ``boundary``, else false.

    Ascending order with nulls first; the boundary is given as text, timestamps by their
    microseconds (in no time zone an hour is then two). The first conjunct
    repeats what the rest implies about the leading column, as a form that a Parquet
    reader can use.
    """
    columns = [F.col(field.name) for field in order]
    limits = [_limit(text, field.dataType) for field, text in zip(order, boundary)]
    clauses = []
    for i, (column, limit) in enumerate(zip(columns, limits)):
        smaller = F.lit(False) if boundary[i] is None else column.isNull() | (column < limit)
        same = [c.eqNullSafe(b) for c, b in zip(columns[:i], limits[:i])]
        clauses.append(reduce(Column.__and__, [*same, smaller]))
    lexicographic = F.coalesce(reduce(Column.__or__, clauses), F.lit(False))
    if boundary[0] is None:
        return lexicographic
    return (columns[0].isNull() | (columns[0] <= limits[0])) & lexicographic


def follows(field: T.StructField, ascending: bool, ties: Sequence[T.StructField], last: Sequence[str | None]) -> Column:
    """True for rows sorted after the row whose ``field`` and ``ties`` are ``last``, as texts of ``as_text``.

    ``field`` is sorted up or down with null and NaN last, ``ties`` up with nulls first.
    """
    key, limits = known(field), [_limit(text, each.dataType) for each, text in zip([field, *ties], last, strict=True)]
    clauses = []
    same = key.eqNullSafe(limits[0])
    if last[0] is None or last[0] == "NaN":
        same = key.isNull()
    else:
        clauses.append(key.isNull() | (key > limits[0] if ascending else key < limits[0]))
    for tie, text, limit in zip(ties, last[1:], limits[1:], strict=True):
        column = F.col(tie.name)
        clauses.append(same & (column.isNotNull() if text is None else column > limit))
        same = same & column.eqNullSafe(limit)
    return F.coalesce(reduce(Column.__or__, clauses, F.lit(False)), F.lit(False))
