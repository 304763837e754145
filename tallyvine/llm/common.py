"""What the operators share: shipping this package to Python workers, and access to Arrow columns."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()

#: Rows per Arrow batch where the session sets no number. Of whole texts, the 10,000 of Spark's default
#: take tens of MB per task, in the JVM and again in Python.
BATCH_ROWS = 1024
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Documents handled at a time inside an Arrow batch.
SLICE_ROWS = 256
#: Bytes that a longer slice of short texts may take on average.
SHORT_BYTES = 16 << 20
#: Bytes up to which slices are put together.
GATHERED_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where its folder is not on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tallyvine-")
    context.addPyFile(shutil.make_archive(f"{folder}/tallyvine-package", "zip", _PACKAGE.parent, _PACKAGE.name))
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, kernel, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, in batches of bounded size."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(kernel, schema)


class Memory:
    """Values remembered by key within a bound of bytes, in two generations.

    When the young generation is full it becomes the old one, whose values are forgotten; a key
    found in the old one is young again. So what recurs stays, whatever passes by once.
    """

    #: Bytes of an entry besides those of its key and value.
    ENTRY = 200

    def __init__(self, most_bytes: int):
        self.most, self.size = most_bytes // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def put(self, key, value, size: int) -> None:
        if self.size >= self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += size + self.ENTRY

    def recall(self, key, size: int):
        """The value of a key that is not in the young generation, or None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value, size)
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four times longer slices where texts are short, so that more words recur in one."""
    for batch in batches:
        short = 4 * SLICE_ROWS * batch.nbytes <= SHORT_BYTES * max(1, batch.num_rows)
        yield from slices([batch], 4 * SLICE_ROWS if short else SLICE_ROWS)


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches in one as long as it stays within so many bytes; a larger one stays alone."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; a null text is an empty one."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]
