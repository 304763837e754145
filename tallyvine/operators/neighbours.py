"""Exact k-nearest-neighbour classification in one pass over the rows to classify per model.

The labelled rows are the model. Their vectors go to every executor as a matrix of bounded size; the
rows to classify stay where they are, nothing is shuffled. More labelled rows than
``max_labelled_rows``, or than fit the bytes of a model, make several models, searched in turn. The
neighbours are exact, equal distances ordered by key.

Rows without label teach nothing. A vector that is null, of another length, or holds a value that is
not finite ends the job with an error.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvine.sources.scratch import store

# The functions below travel with the tasks; executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LABELLED_ROWS = 200_000
#: Bytes of the matrix, in doubles, that every Python worker of an executor holds, whatever the input.
MAX_MODEL_BYTES = 2**25
BLOCK_ROWS = 2_048
SLICE_ROWS = 256
#: So many times the wanted neighbours left in a block make it worth ranking.
_MANY = 4
_MARGIN = 0.9


def _squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All squared distances by matrix product; off by rounding, see ``_rounding``."""
    squares = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :]
    return np.maximum(squares - 2 * left @ right.T, 0.0)


def _rounding(left: np.ndarray, right: np.ndarray) -> float:
    """Bound on the error of ``_squared_distances``."""
    largest = (left**2).sum(axis=1).max() + (right**2).sum(axis=1).max()
    return 8 * (left.shape[1] + 4) * np.finfo(float).eps * largest


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    if column.null_count or not pc.all(pc.equal(pc.list_value_length(column), length), min_count=0).as_py():
        raise ValueError(f"a vector is null or has not {length} values")
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    matrix = (values if values.dtype.kind == "f" else values.astype(float)).reshape(-1, length)
    if flat.null_count or not np.isfinite(matrix).all():
        raise ValueError("a vector holds a value that is not finite")
    return matrix


def _nearest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the ``k`` nearest points of each query and the squared distances.

    There are at least ``k`` points. They keep their own width; a block of them at a time is widened.

    The quick distances only preselect, with room for their rounding, by the ``k``-th best distance
    of the blocks before, or where that leaves many, by that of the block. Those left are computed
    again, summing in element order, so a distance does not depend on the block.
    """
    queries = queries.astype(float)
    asking, found, squared = np.empty(0, int), np.empty(0, int), np.empty(0)
    limit = np.full((len(queries), 1), np.inf)
    for start in range(0, len(points), BLOCK_ROWS):
        block = points[start : start + BLOCK_ROWS].astype(float)
        quick = _squared_distances(queries, block)
        room = 2 * _rounding(queries, block)
        near = quick <= limit + room
        if len(block) > k and np.count_nonzero(near) > _MANY * k * len(queries):
            near &= quick <= np.partition(quick, k - 1, axis=1)[:, k - 1 : k] + room
        rows, columns = np.nonzero(near)
        exact = np.empty(len(rows))
        for lot in range(0, len(rows), BLOCK_ROWS):
            some = slice(lot, lot + BLOCK_ROWS)
            exact[some] = np.cumsum((queries[rows[some]] - block[columns[some]]) ** 2, axis=1)[:, -1]
        asking, found = np.append(asking, rows), np.append(found, columns + start)
        squared = np.append(squared, exact)
        ranked = np.lexsort((found, squared, asking))
        firsts = np.searchsorted(asking[ranked], asking[ranked])
        best = ranked[np.arange(len(ranked)) - firsts < k]
        asking, found, squared = asking[best], found[best], squared[best]
        if len(found) == k * len(queries):
            limit = squared.reshape(-1, k)[:, -1:]
    return found.reshape(len(queries), k), squared.reshape(len(queries), k)


def _votes(codes: np.ndarray) -> np.ndarray:
    """Most frequent code among the first 1, 2, ... of each row, ties to the lowest."""
    counts, found = np.zeros_like(codes), np.empty_like(codes)
    none = codes.max(initial=0) + 1
    for k in range(codes.shape[1]):
        met = codes[:, : k + 1]
        same = met == codes[:, k : k + 1]
        counts[:, : k + 1] += same
        counts[:, k] = same.sum(axis=1)
        most = counts[:, : k + 1].max(axis=1, keepdims=True)
        found[:, k] = np.where(counts[:, : k + 1] == most, met, none).min(axis=1)
    return found


def _model(known: DataFrame, key: str, vector: str, label: str, length: int) -> tuple:
    """Keys, labels and vectors of a block of labelled rows in order of their keys."""
    fitted = known.select(key, label, vector).toArrow().combine_chunks().sort_by(key)
    keys, labels, vectors = (column.combine_chunks() for column in fitted.columns)
    return keys, labels, _matrix(vectors, length)


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _lists(values: pa.Array, rows: int, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), values)


def _search(model, k: int, last: bool):
    """Bring the neighbours in one block of labelled rows into the lists of those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, points = model.value
        for some in _in_slices(batches):
            asking = _matrix(some["v"], points.shape[1])
            found, squared = _nearest(asking, points, min(k, len(points)))
            rows = np.repeat(np.arange(some.num_rows), found.shape[1])
            found = pa.array(found.ravel())
            parts = [(keys.take(found), labels.take(found), squared.ravel())]
            if "keys" in some.schema.names:
                before = [some[name].flatten() for name in ("keys", "labels", "squared")]
                width = len(before[0]) // some.num_rows
                rows = np.append(np.repeat(np.arange(some.num_rows), width), rows)
                parts.insert(0, (before[0], before[1], before[2].to_numpy()))
            all_keys, all_labels = (pa.concat_arrays([part[at] for part in parts]) for at in (0, 1))
            distances = np.concatenate([part[2] for part in parts])
            ranked = np.lexsort((all_keys.to_numpy(), distances, rows))
            best = ranked[np.arange(len(ranked)) - np.searchsorted(rows[ranked], rows[ranked]) < k]
            take = pa.array(best)
            width = len(best) // some.num_rows if some.num_rows else 0
            columns = [all_keys.take(take), all_labels.take(take), pa.array(distances[best])]
            lists = [_lists(column, some.num_rows, width) for column in columns]
            if last:
                classes = columns[1].unique()
                classes = classes.take(pc.sort_indices(classes))
                codes = pc.index_in(columns[1], classes).to_numpy().reshape(some.num_rows, width)
                lists.append(_lists(classes.take(pa.array(_votes(codes).ravel())), some.num_rows, width))
            names = ["q", "l", *([] if last else ["v"]), "keys", "labels", "squared", *(["predicted"] if last else [])]
            yield pa.RecordBatch.from_arrays([some[name] for name in names if name in ("q", "l", "v")] + lists, names)

    return run


def neighbour_lists(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int,
    max_labelled_rows: int = MAX_LABELLED_ROWS,
) -> DataFrame:
    """Per test row ``q`` (key) and ``l`` (label) the ``k`` nearest: lists ``keys labels squared predicted``.

    ``predicted`` holds the majority label of the first 1, 2, ... neighbours. The labelled rows are
    cut by a hash of their keys into blocks of ``max_labelled_rows`` at most, about; each block is a
    model in turn, and the lists found so far are stored between two blocks. One block needs no
    store and runs when the result is read.
    """
    known = train.where(F.col(label).isNotNull())
    shape = known.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("length")).first()
    if shape["rows"] < k:
        raise ValueError(f"{k} neighbours asked of {shape['rows']} labelled rows")
    length = shape["length"]
    most = min(max_labelled_rows, MAX_MODEL_BYTES // (8 * max(1, length)))
    if most < 1:
        raise ValueError(f"one labelled vector exceeds {MAX_MODEL_BYTES} bytes")
    # Blocks by hash are of uneven size; the margin keeps the largest within the bound.
    blocks = 1 if shape["rows"] <= most else ceil(shape["rows"] / (_MARGIN * most))
    asked = test.select(F.col(key).alias("q"), F.col(label).alias("l"), F.col(vector).alias("v"))
    vectors, longs = asked.schema["v"], T.ArrayType(train.schema[key].dataType)
    labels = T.ArrayType(train.schema[label].dataType)
    found = [("keys", longs), ("labels", labels), ("squared", T.ArrayType(T.DoubleType()))]
    for block in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block)
        fitted = _model(part, key, vector, label, length)
        last = block == blocks - 1
        if not len(fitted[0]) and not last:
            continue
        model = train.sparkSession.sparkContext.broadcast(fitted)
        fields = [asked.schema["q"], asked.schema["l"], *([] if last else [vectors])]
        fields += [T.StructField(*field) for field in (*found, *([("predicted", labels)] if last else []))]
        lists = asked.mapInArrow(_search(model, k, last), T.StructType(fields))
        asked = lists if last else store(lists)
    return asked


def nearest_neighbours(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int,
    max_labelled_rows: int = MAX_LABELLED_ROWS,
) -> DataFrame:
    """The ``k`` labelled rows nearest to each test row: ``_query _key _label _squared``.

    Keys are unique integers; equal distances are ordered by key.
    """
    lists = neighbour_lists(train, test, key, vector, label, k, max_labelled_rows)
    each = lists.select(F.col("q").alias("_query"), F.inline(F.arrays_zip("keys", "labels", "squared")))
    return each.withColumnsRenamed({"keys": "_key", "labels": "_label", "squared": "_squared"})


def knn_classify_up_to(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int,
    max_labelled_rows: int = MAX_LABELLED_ROWS,
) -> DataFrame:
    """Test rows as ``key, label, predicted``: a list of the majority labels of the 1 to ``k`` nearest."""
    lists = neighbour_lists(train, test, key, vector, label, k, max_labelled_rows)
    return lists.select(F.col("q").alias(key), F.col("l").alias(label), "predicted")


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int,
    max_labelled_rows: int = MAX_LABELLED_ROWS,
) -> DataFrame:
    """Test rows as ``key, label, predicted``: majority label of the ``k`` nearest, ties to the lowest."""
    lists = knn_classify_up_to(train, test, key, vector, label, k, max_labelled_rows)
    return lists.withColumn("predicted", F.col("predicted")[k - 1])
