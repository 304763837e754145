"""Hard negatives by exact search for inner products in cover trees.

All rows are candidates. They are dealt to groups of bounded size by a hash, and within a group,
sorted by label, to cover trees. In a tree every vector gets one more component that brings it to
the largest norm, so that all lie on a sphere and the angle to an anchor orders them as the inner
product does. A node covers its points within an angle; levels shrink the covering radius step by
step, a node's centre is a point of its own. An anchor at angle t from the centre has inner products
between ``|q| M cos(t + radius)`` and ``|q| M cos(t - radius)`` with the points below. Each anchor
visits the nodes whose range meets its window by falling upper bound, and stops where the bound
falls below its k-th best so far, which it carries on to the next tree. Visited points are verified
by exact integer products. Where points are too far apart for smaller balls, they stay in their
node and are verified at once.

Two passes: the positives of each anchor (same label), then the negatives of each pair, in the
window that the positive's score gives. Anchors go to every group in blocks; a group's best are
merged per anchor. Nothing is broadcast or collected.

Rows with a null id, label, vector or component, or with a component that is not finite, take no
part. Shorter vectors count as filled up with zeros. Equal rows count once; rows of one id and
different contents each for itself, but no row is a partner of its own id. Ties go to the smaller
id. Ids and labels are integers; sums of products must fit in 64 bits, otherwise the job ends with
an error. Columns other than the three named are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tallyvine.llm.common import map_batches, slices
from tallyvine.sources.scratch import store

POSITIVES, NEGATIVES = 5, 5
#: Percent of the positive's score between which negatives lie.
LOW, HIGH = 80, 100
SCALE = 256
#: Rows of a tree, at most, and of a tree of one label, at least, unless the label has fewer.
TREE_ROWS, LABEL_ROWS = 2048, 256
#: Expected rows that a task holds as trees.
GROUP_ROWS = 131_072
#: Points that make a ball a node of its own, and that stay together without another look.
BALL_ROWS, LEAF_ROWS = 8, 32
#: Ratio of the radii of neighbouring levels.
_STEP = 1.3
_BLOCK_ROWS = 1024
_ROUNDING, _EQUAL = 1e-6, 1e-13

_TREE = "`group` int, tree int, ids array<bigint>, labels array<bigint>, vectors array<bigint>, length int, parents array<int>, " \
    "centres array<int>, radii array<double>, ends array<int>"  # fmt: skip
_FOUND = "anchor_id bigint, anchor_key bigint, place int, id bigint, score bigint"


class CoverTree:
    """Nodes by rising number, parents before their children; ``rows`` orders points by their node."""

    def __init__(self, rows, parents, centres, radii, ends):
        self.rows, self.parents, self.centres, self.radii, self.ends = rows, parents, centres, radii, ends


def on_sphere(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vectors of the vectors with the component that brings them to the largest norm, and that norm."""
    points = vectors.astype(float)
    squares = (points**2).sum(axis=1)
    most = squares.max(initial=0.0)
    if not most:
        return np.hstack([points, np.ones((len(points), 1))]), 0.0
    lifted = np.sqrt(np.maximum(most - squares, 0.0))
    return np.hstack([points, lifted[:, None]]) / np.sqrt(most), float(np.sqrt(most))


def build_tree(vectors: np.ndarray) -> CoverTree:
    points, _ = on_sphere(vectors)
    squares = 2 - 2 * points @ points.T
    # Smaller ones are rounding; bounds have more slack than that.
    chords = np.sqrt(np.where(squares < _EQUAL, 0.0, squares))
    order, parents, centres, radii, ends = [], [], [], [], []
    # Of a node: its points, centre, parent and the covering radius of its level.
    waiting = [(np.arange(len(points)), 0, -1, float(chords[0].max(initial=0.0)))]
    while waiting:
        rows, centre, parent, radius = waiting.pop()
        number = len(parents)
        parents.append(parent)
        centres.append(centre)
        # The chord of an angle t is 2 sin(t / 2).
        widest = min(1.0, float(chords[centre, rows].max(initial=0.0)) / 2)
        radii.append(2 * np.arcsin(widest))
        own = rows
        while len(rows) > LEAF_ROWS and radius > _ROUNDING:
            radius /= _STEP
            balls = _balls(chords, rows, centre, radius)
            if len(balls) == 1:
                continue
            big = [(ball, middle) for ball, middle in balls if len(ball) >= BALL_ROWS]
            if big:
                waiting += [(ball, middle, number, radius) for ball, middle in big]
                small = [ball for ball, _ in balls if len(ball) < BALL_ROWS]
                own = np.concatenate(small) if small else rows[:0]
            break
        order.append(own)
        ends.append(len(own))
    return CoverTree(
        np.concatenate(order), np.array(parents), np.array(centres), np.array(radii), np.cumsum(ends)
    )


def _balls(chords: np.ndarray, rows: np.ndarray, centre: int, radius: float) -> list[tuple[np.ndarray, int]]:
    """Balls that cover the points, around points that are further apart than the radius."""
    balls = []
    while len(rows):
        near = chords[centre, rows] <= radius
        balls.append((rows[near], centre))
        rows = rows[~near]
        if len(rows):
            centre = int(rows[0])
    return balls


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    bound = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0)) * left.shape[1]
    if bound < 2.0**53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    if bound < 2.0**63:
        return left @ right.T
    raise ValueError("sums of products of these vectors do not fit in 64 bits")


class Best:
    """The k best (score, id) of each asker, by falling score, then rising id."""

    def __init__(self, askers: int, k: int, low: np.ndarray):
        self.k = k
        self.who, self.scores, self.ids = (np.empty(0, np.int64) for _ in range(3))
        #: Scores below cannot come in.
        self.least = low.copy()

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        who, scores, ids = (np.append(a, b) for a, b in ((self.who, who), (self.scores, scores), (self.ids, ids)))
        ranked = np.lexsort((ids, -scores, who))
        who = who[ranked]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = ranked[place < self.k]
        self.who, self.scores, self.ids = who[place < self.k], scores[kept], ids[kept]
        last = place == self.k - 1
        self.least[who[last]] = np.maximum(self.least[who[last]], scores[ranked[last]])


class Shelf:
    """A cover tree ready to be asked."""

    def __init__(self, ids, labels, vectors, tree: CoverTree):
        self.ids, self.labels, self.vectors = ids[tree.rows], labels[tree.rows], vectors[tree.rows]
        self.tree, self.centres = tree, vectors[tree.centres]
        self.starts = np.append(0, tree.ends[:-1])
        self.norm = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max(initial=0.0)))
        self.label = labels[0] if len(labels) and (labels == labels[0]).all() else None
        #: Points that were compared with an anchor, for tests.
        self.verified = 0

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each asker with the points below each node."""
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))[:, None] * self.norm
        cosines = np.clip(_products(vectors, self.centres) / np.where(norms > 0, norms, 1.0), -1.0, 1.0)
        angles = np.arccos(cosines)
        slack = _ROUNDING * norms + 1e-6
        upper = norms * np.cos(np.maximum(angles - self.tree.radii, 0.0)) + slack
        lower = norms * np.cos(np.minimum(angles + self.tree.radii, pi)) - slack
        return lower, upper

    def ask(self, vectors, anchors, labels, high, best: Best, same: bool) -> None:
        """Bring in the points of the same label as the askers, or of others, with scores up to ``high``."""
        if self.label is not None:
            asking = np.flatnonzero((labels == self.label) == same)
        else:
            asking = np.arange(len(labels))
        if not len(asking):
            return
        lower, upper = self.bounds(vectors[asking])
        open_ = (upper >= best.least[asking, None]) & (lower <= high[asking, None])
        for node, parent in enumerate(self.tree.parents):
            if parent >= 0:
                open_[:, node] &= open_[:, parent]
        open_ &= self.tree.ends > self.starts
        rank = np.argsort(np.where(open_, -upper, np.inf), axis=1, kind="stable")
        count, turn = open_.sum(axis=1), 0
        going = np.flatnonzero(count > 0)
        # In each turn every asker visits its best node not visited yet.
        while len(going):
            nodes = rank[going, turn]
            still = upper[going, nodes] >= best.least[asking[going]]
            going, nodes = going[still], nodes[still]
            for node in np.unique(nodes):
                self._verify(node, asking[going[nodes == node]], vectors, anchors, labels, high, best, same)
            turn += 1
            going = going[count[going] > turn]

    def _verify(self, node, who, vectors, anchors, labels, high, best, same) -> None:
        part = slice(self.starts[node], self.tree.ends[node])
        scores = _products(vectors[who], self.vectors[part])
        self.verified += scores.size
        fit = (scores >= best.least[who, None]) & (scores <= high[who, None])
        fit &= (self.labels[part][None] == labels[who, None]) == same
        fit &= self.ids[part][None] != anchors[who, None]
        if scores.shape[1] > 4 * best.k:
            # Of many points only those that reach the k-th best here can come in.
            masked = np.where(fit, scores, np.iinfo(np.int64).min)
            fit &= scores >= np.partition(masked, -best.k, axis=1)[:, -best.k, None]
        rows, columns = np.nonzero(fit)
        if len(rows):
            best.add(who[rows], scores[rows, columns], self.ids[part][columns])


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if (sizes == length).all():
        return flat.reshape(len(sizes), length)
    found = np.zeros((len(sizes), length), np.int64)
    found[np.arange(length)[None] < sizes[:, None]] = flat
    return found


def _build(schema: pa.Schema, length: int):
    def tree_row(group: int, number: int, ids, labels, vectors) -> pa.RecordBatch:
        tree = build_tree(vectors)
        lists = [ids, labels, vectors.ravel(), length, tree.parents, tree.centres, tree.radii, tree.ends]
        # The rows are stored in the order of the tree, which makes its centres' numbers refer to that order.
        lists[0], lists[1], lists[2] = ids[tree.rows], labels[tree.rows], vectors[tree.rows].ravel()
        place = np.empty(len(ids), np.int64)
        place[tree.rows] = np.arange(len(ids))
        lists[5] = place[tree.centres]
        arrays = [pa.array([value], field.type) for value, field in zip([group, number, *lists], schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def cut(all_of_it: bool):
            nonlocal waiting, size
            ids, labels, vectors = (np.concatenate(x) for x in zip(*waiting, strict=True))
            at = 0
            while at < len(ids):
                end = min(at + TREE_ROWS, len(ids))
                # A tree ends with its label, if it is large enough by then.
                changes = np.flatnonzero(np.diff(labels[at:end])) + 1
                changes = changes[changes >= LABEL_ROWS]
                if len(changes):
                    end = at + int(changes[0])
                elif end - at < TREE_ROWS and not all_of_it:
                    break
                yield ids[at:end], labels[at:end], vectors[at:end]
                at = end
            waiting, size = ([(ids[at:], labels[at:], vectors[at:])], len(ids) - at) if at < len(ids) else ([], 0)

        for batch in slices(batches, TREE_ROWS):
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), length)))
            size += batch.num_rows
            if size >= 2 * TREE_ROWS:
                for piece in cut(False):
                    yield tree_row(group, number, *piece)
                    number += 1
        if waiting:
            for piece in cut(True):
                yield tree_row(group, number, *piece)
                number += 1

    return run


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = SCALE) -> DataFrame:
    """(id, label, vector) of the rows that take part, components as whole numbers floor(scale * x)."""
    double = F.col(vector_column).cast("array<double>")
    fits = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & double.isNotNull() & fits)
    return named.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(label_column).cast("bigint").alias("label"),
        F.transform(double, lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector"),
    )


def build_trees(vectors: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, int, int]:
    """The stored trees of all (id, label, vector), the number of groups and the length of vectors."""
    distinct = store(vectors.dropDuplicates(["id", "label", "vector"]))
    shape = distinct.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("length")).first()
    length = shape["length"] or 0
    # Groups fit in memory, and there are enough of them to keep all cores busy.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-shape["n"] // group_rows), min(2 * cores, -(-shape["n"] // TREE_ROWS)))
    schema = _parse_datatype_string(_TREE)
    dealt = distinct.repartition(groups, "id", "vector").sortWithinPartitions("label", "id")
    trees = store(map_batches(dealt, _build(to_arrow_schema(schema), length), schema))
    last = trees.agg(F.max("group")).first()[0]
    return trees, (last if last is not None else -1) + 1, length


def _search(schema: pa.Schema, k: int, length: int, same: bool):
    def answers(shelves: list[Shelf], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "anchor_key", "place", "label", "low", "high"]
        anchors, keys, places, labels, low, high = (batch.column(name).to_numpy() for name in names)
        vectors = _matrix(batch.column("vector"), length)
        best = Best(len(anchors), k, low)
        for shelf in shelves:
            shelf.ask(vectors, anchors, labels, high, best, same)
        who = best.who
        columns = [anchors[who], keys[who], places[who], best.ids, best.scores]
        arrays = [pa.array(x, field.type) for x, field in zip(columns, schema, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shelves = None, []
        for batch in slices(batches, _BLOCK_ROWS):
            numbers = batch.column("group").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, end in zip(borders[:-1], borders[1:], strict=True):
                part = batch.slice(first, end - first)
                if numbers[first] != group:
                    group, shelves = numbers[first], []
                trees = int((part.column("anchor_id").is_null()).to_numpy(zero_copy_only=False).sum())
                for at in range(trees):
                    lists = [part.column(name)[at].values.to_numpy() for name in ("ids", "labels", "vectors")]
                    nodes = [part.column(name)[at].values.to_numpy() for name in ("parents", "centres", "radii", "ends")]
                    tree = CoverTree(np.arange(len(lists[0])), *nodes)
                    shelves.append(Shelf(lists[0], lists[1], lists[2].reshape(len(lists[0]), length), tree))
                if trees < part.num_rows:
                    yield from answers(shelves, part.slice(trees))

    return run


def _asked(trees: DataFrame, groups: int, length: int, asking: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each (anchor_id, anchor_key, place), with their rank."""
    everywhere = asking.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))))
    # Of each group its trees come first, then the anchors.
    rows = trees.unionByName(everywhere, allowMissingColumns=True).drop("length")
    dealt = rows.repartition("group").sortWithinPartitions("group", F.col("anchor_id").asc_nulls_first(), "anchor_key", "place")
    schema: StructType = _parse_datatype_string(_FOUND)
    found = map_batches(dealt, _search(to_arrow_schema(schema), k, length, same), schema)
    order = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per anchor and positive the negatives in the window: anchor_id, positive_id, rank, negative_id and scores.

    ``vectors`` and ``anchors`` (of the same rows) are results of ``whole_vectors``.
    """
    trees, groups, length = build_trees(vectors, group_rows)
    key = F.xxhash64("label", "vector").alias("anchor_key")
    asking = store(anchors.dropDuplicates(["id", "label", "vector"]).select(F.col("id").alias("anchor_id"), key, "label", "vector"))
    everything = [F.lit(0).alias("place"), F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high")]
    near = _asked(trees, groups, length, asking.select("*", *everything), positives, True)
    near = near.select("anchor_id", "anchor_key", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Below zero the window is empty.
    near = store(near.where("positive_score >= 0"))
    # Hundredths apart from the rest, so that no product overflows.
    hundreds, rest = "positive_score div 100", "positive_score % 100"
    window = [F.expr(f"({hundreds}) * {low} + (({rest}) * {low} + 99) div 100").alias("low")]
    window += [F.expr(f"({hundreds}) * {high} + (({rest}) * {high}) div 100").alias("high")]
    pairs = near.join(asking, ["anchor_id", "anchor_key"])
    pairs = pairs.select("anchor_id", "anchor_key", F.col("rank").alias("place"), "label", "vector", *window)
    far = _asked(trees, groups, length, pairs, negatives, False)
    named = near.withColumnRenamed("rank", "place")
    met = far.join(named, ["anchor_id", "anchor_key", "place"])
    return met.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
