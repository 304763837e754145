"""Mean and scatter matrix of vectors in one pass: partial ones per task, merged row by row."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SCHEMA = "place int, task int, n long, mean array<double>, scatter array<double>"
_SLICE_ROWS = 4096


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors as rows of a matrix; ``ValueError`` if they have no values or not the same number of them."""
    values = column.flatten()
    if column.null_count or values.null_count or len(values) % len(column):
        raise ValueError("a vector or one of its components is null, or lengths differ")
    length = len(values) // len(column)
    if (np.diff(column.offsets.to_numpy()) != length).any():
        raise ValueError("vectors of different lengths")
    return values.to_numpy(zero_copy_only=False).reshape(len(column), length)


def _merged(left: tuple | None, right: tuple) -> tuple:
    """(n, mean, scatter) of two sets of vectors; the scatter may be one row, ``place``, of the matrix."""
    if left is None:
        return right
    (n, mean, scatter, place), (m, other, more, _) = left, right
    if len(mean) != len(other):
        raise ValueError("vectors of different lengths")
    apart = other - mean
    cross = apart[place] * apart if place is not None else np.outer(apart, apart)
    return n + m, mean + apart * (m / (n + m)), scatter + more + cross * (n * m / (n + m)), place


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE_ROWS):
            rows = _vectors(batch.column(0).slice(at, _SLICE_ROWS))
            mean = rows.mean(axis=0)
            found = _merged(found, (len(rows), mean, (rows - mean).T @ (rows - mean), None))
    if found is not None:
        n, mean, scatter, _ = found
        task = TaskContext.get().partitionId()
        for place, row in enumerate(scatter):
            yield _line(place, task, n, mean, row)


def _line(place: int, task: int, n: int, mean: np.ndarray, scatter: np.ndarray) -> pa.RecordBatch:
    values = [[place], [task], [n], [mean], [scatter]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = [pa.array(value, kind) for value, kind in zip(values, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["place", "task", "n", "mean", "scatter"])


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for batch in batches:
        for row in batch.to_pylist():
            if found is not None and found[3] != row["place"]:
                yield _line(found[3], 0, *found[:3])
                found = None
            found = _merged(found, (row["n"], np.array(row["mean"]), np.array(row["scatter"]), row["place"]))
    if found is not None:
        yield _line(found[3], 0, *found[:3])


def scatter_matrix(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Number of vectors, their mean, and the sum of outer products of their deviations; None without rows.

    One scan. Each task sends the rows of its own matrix, keyed by place, so that no task merges
    more than a row per task of the scan, and the driver gets one matrix. The tasks' parts
    are merged in their order.
    """
    partial = df.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(_partial, _SCHEMA)
    arranged = partial.repartition("place").sortWithinPartitions("place", "task")
    merged = arranged.mapInArrow(_by_place, _SCHEMA).select(F.struct("place", "n", "mean", "scatter").alias("row"))
    rows = merged.agg(F.sort_array(F.collect_list("row")).alias("rows")).first().rows
    if not rows:
        return None
    return rows[0].n, np.array(rows[0].mean), np.array([row.scatter for row in rows])
