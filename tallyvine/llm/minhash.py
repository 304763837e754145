"""Near duplicates by MinHash with tensored banding, verified on the full sets.

A document's n-gram set gets two small collections of half keys, each half key made of a few
minhashes. A table key joins one half key of the first collection with one of the second, so m half
keys on either side give m x m tables, for 2 m instead of m x m keys' worth of minhashes. Two sets of
similarity s meet in some table unless all half keys of one side differ: with p = s ** rows the
probability is at most 2 (1 - p) ** m, 1 in 100,000 for two sets at the threshold of 0.8 with the
parameters here, and far less above it or where a third document links them.

1. Documents of equal sets form one class; one row of each goes on.
2. A table key can be shared only if both of its half keys are. Half keys are counted first, and
   tables are formed of shared ones only; most documents have none.
3. In each bucket of a table the smallest member is checked against all others (one pair per
   member). Pairs are filtered by size and by parities of n-grams by hash class, and verified by
   the exact intersection of the full sets.
4. In buckets whose members still lie in different components the remaining pairs, without those
   checked before, pass the same filters and are verified. No pair within a component is formed.

Words are maximal runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer
words than ``n`` has one n-gram, its whole sequence. Texts without words and null texts have an
empty set and are linked with nothing. Every row is a document of its own: rows of one id with
different texts are linked each by its text, equal rows are copies of each other and have the same
result. A row without id links nothing; its component is null and it is not kept. Very long texts
are hashed whole. Columns other than the two named are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyvine.llm import bloom
from tallyvine.llm.common import map_batches, slices, utf8
from tallyvine.llm.components import components
from tallyvine.llm.ngram_join import shingle_hashes
from tallyvine.sources.scratch import store

WORDS = 4
PERCENT = 80
#: Half keys of each of the two collections, and minhashes of a half key.
HALVES, ROWS = 12, 2
#: 64-bit words of a set's parity vector.
_PARITY_WORDS = 16
_RANDOM = np.random.Generator(np.random.PCG64(12))
_MASKS = _RANDOM.integers(0, 2**64, 2 * HALVES * ROWS, dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**63, 2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = ["n_shingles", "key1", "key2"]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Half keys of both collections, one row per set; equal keys have equal places. Sets are not empty."""
    hashes = np.concatenate(sets)
    firsts = np.cumsum([0, *map(len, sets[:-1])])
    lowest = np.empty((len(_MASKS), len(sets)), np.uint64)
    for at, (mask, factor) in enumerate(zip(_MASKS, _FACTORS, strict=True)):
        lowest[at] = np.minimum.reduceat((hashes ^ mask) * factor, firsts)
    keys = np.repeat(np.arange(2 * HALVES, dtype=np.uint64)[:, None], len(sets), axis=1)
    for row in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + lowest[row::ROWS])
    return keys.T


def set_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two sums of hashes that name each set, together with its size."""
    sums = [[values.sum(dtype=np.uint64) for values in row] for row in (sets, map(_mixed, sets))]
    return [np.array(row, np.uint64).view(np.int64) for row in sums]


def _describe(schema: pa.Schema, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_hashes(utf8(batch.column(1)), n)
            full = [row for row, hashes in enumerate(sets) if len(hashes)]
            halves, parities = [[] for _ in sets], [[] for _ in sets]
            if full:
                for row, keys in zip(full, half_keys([sets[row] for row in full]).view(np.int64), strict=True):
                    halves[row] = keys
                    odd = np.bincount((sets[row] >> np.uint64(54)).astype(np.int64), minlength=64 * _PARITY_WORDS) & 1
                    parities[row] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            columns = [[len(hashes) for hashes in sets], *set_keys(sets), halves, parities]
            arrays = [pa.array(x, field.type) for x, field in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return run


def described(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Per (doc_id, text) the size, keys, half keys and parities of its set, stored, with a number per row."""
    longs = T.ArrayType(T.LongType())
    columns = [*((name, T.LongType()) for name in _KEY), ("halves", longs), ("parity", longs)]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(*column) for column in columns)])
    sets = map_batches(docs, _describe(to_arrow_schema(schema), n), schema)
    # Stored with the rows, the numbers stay as they are.
    return store(sets.withColumn("row", F.monotonically_increasing_id()))


def _whole(schema: pa.Schema, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_hashes(utf8(batch.column("text")), n)
            keys = np.stack([[len(hashes) for hashes in sets], *set_keys(sets)], axis=1)
            wanted = np.stack([batch.column(name).to_numpy() for name in _KEY], axis=1)
            rows = np.flatnonzero((keys == wanted).all(axis=1))
            grams = pa.array([sets[row].view(np.int64) for row in rows], pa.list_(pa.int64()))
            nodes = batch.column("node").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([nodes, grams], schema=schema)

    return run


def _sets_of(nodes: DataFrame, named: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, grams) of the nodes, hashed anew from their texts."""
    wanted = store(nodes.distinct().join(named, "node"))
    texts = bloom.reduced(docs, "doc_id", wanted, "doc_id").join(wanted, "doc_id")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return store(map_batches(texts, _whole(to_arrow_schema(schema), n), schema).dropDuplicates(["node"]))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities allow to be similar.

    An n-gram of one set only turns one parity over, so the vectors differ in at most as many
    places as the sets do.
    """
    sides = [nodes.select(F.col("node").alias(node), F.col("size").alias(size), F.col("parity").alias(parity))
             for node, size, parity in (("a", "m", "x"), ("b", "n", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(_near(percent)).select("a", "b")


def _near(percent: int):
    m, n = F.col("m"), F.col("n")
    apart = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(_PARITY_WORDS)), F.lit(0))
    # Of m + n n-grams at least percent / (100 + percent) must be common, each counted in both sets.
    overlap = (m + n - apart) * (100 + percent) >= 2 * percent * (m + n)
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & overlap


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    common = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y") - common).alias("all"), common.alias("common"))
    return met.where(100 * F.col("common") >= percent * F.col("all")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def table_postings(nodes: DataFrame) -> DataFrame:
    """(key, node) of the tables whose key may be shared, of nodes with their half keys."""
    halves = nodes.select("node", F.posexplode("halves").alias("place", "half"))
    shared = store(halves.groupBy("half").count().where("count > 1").select("half"))
    live = bloom.reduced(halves, "half", shared, "half").join(shared, "half")
    # At most the half keys of one document.
    sides = [F.collect_list(F.when(side, F.col("half"))) for side in (F.col("place") < HALVES, F.col("place") >= HALVES)]
    met = live.groupBy("node").agg(sides[0].alias("one"), sides[1].alias("two"))
    paired = met.select("node", F.explode("one").alias("one"), "two").select("node", "one", F.explode("two").alias("two"))
    postings = store(paired.select(F.xxhash64("one", "two").alias("key"), "node"))
    buckets = store(postings.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    return store(postings.join(buckets.select("key", "least"), "key"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links) and kept."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    each = described(slim, n)
    real = "doc_id is not null and n_shingles > 0"
    classes = each.where(real).groupBy(*_KEY).agg(F.min("row").alias("node"), F.min("doc_id").alias("smallest"))
    classes = store(classes)
    named = each.select(F.col("row").alias("node"), "doc_id", *_KEY).join(classes.select("node"), "node")
    nodes = each.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), "halves", "parity")
    nodes = store(nodes.join(classes.select("node"), "node"))
    postings = table_postings(nodes.select("node", "halves"))

    pairs = store(postings.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    star = store(_possible(pairs, nodes, percent))
    links = store(_similar(star, _sets_of(_ends(star), named, slim, n), percent))
    merged = components(links)

    labelled = postings.select("key", "node").join(merged, "node", "left")
    labelled = store(labelled.select("key", "node", F.coalesce("component", "node").alias("component")))
    # Per bucket one component is set aside; only the others look for partners, in all of them.
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"))
    both = labelled.join(store(mains.where("parts > 1").select("key", "main")), "key")
    both = store(both.join(nodes.select("node", "size", "parity"), "node"))
    few = both.where("component <> main").toDF(*[{"node": "a", "size": "m", "parity": "x", "component": "c"}.get(x, x) for x in both.columns])
    rest = both.drop("main").withColumnsRenamed({"node": "b", "size": "n", "parity": "y", "component": "d"})
    # A pair outside the main component is met from both its ends; the smaller one keeps it.
    once = (F.col("d") == F.col("main")) | (F.col("a") < F.col("b"))
    met = few.join(rest, "key").where((F.col("c") != F.col("d")) & once & _near(percent))
    # The pairs of the first pass have the larger node first.
    open_ = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    open_ = store(open_)
    more = _similar(open_, _sets_of(_ends(open_), named, slim, n), percent)
    final = components(links.unionByName(more))

    joined = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("smallest").alias("component_id"))
    placed = joined.join(smallest, "component").select(*_KEY, "component_id")
    linked = each.where(real).join(placed, _KEY).select("doc_id", "n_shingles", "component_id")
    alone = each.where(f"not ({real})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select(F.col("doc_id").alias(id_column), "n_shingles", "component_id", kept)
