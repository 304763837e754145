"""Hard negatives and the cover tree against brute force."""

from math import ceil, floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvine.llm.hard_negatives import Best, Shelf, build_tree, mine_hard_negatives, whole_vectors

COLUMNS = "vec_id bigint, embedding array<double>, label int, `group` string, ids int, low int, place string"


def whole(row):
    vec_id, vector, label = row
    fits = None not in (vec_id, vector, label) and all(x is not None and np.isfinite(x) for x in vector)
    return (vec_id, tuple(floor(256 * x) for x in vector), label) if fits else None


def brute(rows, positives=5, negatives=5, every=100):
    """Python's own integers over distinct rows."""
    rows = sorted({found for row in rows if (found := whole(row))})
    result = []
    for vec_id, vector, label in rows:
        if vec_id % every:
            continue
        scored = [(sum(a * b for a, b in zip(vector, w)), i, m) for i, w, m in rows if i != vec_id]
        near = sorted(((s, i) for s, i, m in scored if m == label), key=lambda x: (-x[0], x[1]))[:positives]
        for score, positive in near:
            fit = [(s, i) for s, i, m in scored if m != label and 80 * score <= 100 * s <= 100 * score]
            for rank, (s, i) in enumerate(sorted(fit, key=lambda x: (-x[0], x[1]))[:negatives], 1):
                result.append((vec_id, positive, rank, i, score, s))
    return sorted(result)


def mined(spark, rows, every=100, **options):
    frame = spark.createDataFrame([(*row, "g", 1, 2, "p") for row in rows], COLUMNS).repartition(3)
    vectors = whole_vectors(frame, "vec_id", "embedding", "label")
    return sorted(tuple(r) for r in mine_hard_negatives(vectors, vectors.where(F.col("id") % every == 0), **options).collect())


def clustered(n, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    points = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 8)) * 0.1
    return [(i, [float(x) for x in points[i]], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("group_rows", [40, 100_000])
def test_same_as_brute_force(spark, group_rows):
    rows = clustered(900, 3)
    assert mined(spark, rows, every=50, group_rows=group_rows) == brute(rows, every=50) != []


def test_ties_repeats_and_rows_that_take_no_part(spark):
    one, two = [1.0, 0.0], [0.5, 0.5]
    rows = [(0, one, 1), (100, two, 1), (200, one, 2)] + [(i, one, 1 + i % 2) for i in range(1, 40)]
    rows += [(7, one, 2)] * 30 + [(8, two, 1), (8, one, 1), (8, one, 2), (100, one, 3)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [nan, 1.0], 2), (303, [inf, 1.0], 2), (304, one, None), (None, one, 1)]
    rows += [(400, [], 1), (401, [1.0], 2), (402, [1.0, 0.25, 0.5], 1), (500, [-1.0, -1.0], 5)]
    assert mined(spark, rows) == brute(rows) != []


def test_hot_rows_and_many_labels(spark):
    rows = [(11, [0.25, 0.5], 1)] * 400 + clustered(60, 5, labels=60)[:0]
    rows += [(i, [0.25 + i / 1000, 0.5], i) for i in range(200)] + [(i, [0.3, 0.4], 1) for i in range(200, 400)]
    assert mined(spark, rows) == brute(rows) != []


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components(spark):
    rows = [(i, [float(1000 * i), 2.0**20], i // 20 % 2) for i in range(0, 300, 20)]
    assert mined(spark, rows) == brute(rows) != []


@pytest.mark.parametrize("spread", [0.0, 0.05, 5.0])
def test_nodes_cover_their_points(spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 6)) * 100
    vectors = np.floor(centres[rng.integers(0, 5, 700)] + rng.normal(size=(700, 6)) * 100 * spread).astype(np.int64)
    tree = build_tree(vectors)
    assert sorted(tree.rows) == list(range(700))
    assert all(parent < node for node, parent in enumerate(tree.parents))
    shelf = Shelf(np.arange(700), np.zeros(700, np.int64), vectors, tree)
    asking = np.floor(rng.normal(size=(20, 6)) * 100).astype(np.int64)
    lower, upper = shelf.bounds(asking)
    scores = asking @ shelf.vectors.T
    below = [set() for _ in tree.parents]
    for node in reversed(range(len(below))):
        below[node] |= set(range(shelf.starts[node], tree.ends[node]))
        if tree.parents[node] >= 0:
            below[tree.parents[node]] |= below[node]
    for node, points in enumerate(below):
        held = scores[:, sorted(points)]
        assert (held <= upper[:, node, None]).all() and (held >= lower[:, node, None]).all()


def test_the_tree_leaves_out_far_points():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    vectors = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 16)) * 5).astype(np.int64)
    shelf = Shelf(np.arange(2000), np.zeros(2000, np.int64), vectors, build_tree(vectors))
    asking, numbers = vectors[::100], np.arange(0, 2000, 100)
    high = np.full(20, 2**62)
    best = Best(20, 5, np.full(20, -(2**62)))
    shelf.ask(asking, numbers, np.zeros(20, np.int64), high, best, True)
    assert shelf.verified < 0.2 * 20 * 2000
    scores = asking @ vectors.T
    scores[np.arange(20), numbers] = -(2**62)
    for row in range(20):
        order = np.lexsort((np.arange(2000), -scores[row]))[:5]
        assert best.ids[best.who == row].tolist() == order.tolist()
    # A window below the cluster: the nodes above it are left out too.
    shelf.verified, most = 0, np.full(20, ceil(0.5 * 1000 * 1000))
    best = Best(20, 5, most // 2)
    shelf.ask(asking, numbers, np.zeros(20, np.int64), most, best, True)
    assert shelf.verified < 0.5 * 20 * 2000
    for row in range(20):
        fit = np.where((scores[row] <= most[row]) & (scores[row] >= most[row] // 2), scores[row], -(2**62))
        order = [i for i in np.lexsort((np.arange(2000), -fit))[:5] if fit[i] > -(2**62)]
        assert best.ids[best.who == row].tolist() == order
