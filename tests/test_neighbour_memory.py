import tracemalloc

import numpy as np
import pyarrow as pa

from tallyvine.operators import neighbours


def exact(queries, points, k):
    apart = ((queries[:, None, :].astype(float) - points[None].astype(float)) ** 2).sum(axis=2)
    return np.argsort(apart, axis=1, kind="stable")[:, :k]


def test_a_slice_takes_the_same_memory_whatever_the_model():
    draw = np.random.default_rng(3)
    queries = draw.normal(size=(neighbours.SLICE_ROWS, 16)).astype(np.float32)
    points = draw.normal(size=(40_000, 16)).astype(np.float32)
    tracemalloc.start()
    found, _ = neighbours._nearest(queries, points, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    assert found[:8].tolist() == exact(queries[:8], points, 15).tolist()


def test_a_model_keeps_the_width_of_its_vectors():
    column = pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))
    assert neighbours._matrix(column, 2).dtype == np.float32
    assert neighbours._matrix(pa.array([[1, 2]], pa.list_(pa.int32())), 2).dtype == float


def test_points_that_come_nearer_block_by_block_and_tie():
    queries = np.zeros((3, 2), np.float32)
    points = np.repeat(np.arange(6000, 0, -1, dtype=np.float32), 2)[:, None] * np.ones((1, 2), np.float32)
    found, squared = neighbours._nearest(queries, points, 5)
    assert found.tolist() == 3 * [[11998, 11999, 11996, 11997, 11994]]
    assert squared[0].tolist() == [2.0, 2.0, 8.0, 8.0, 18.0]
