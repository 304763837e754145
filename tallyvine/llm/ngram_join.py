"""Documents linked by the Jaccard similarity of their word n-grams, as connected components.

A row is known by its id and a hash of its text. Rows of equal n-gram sets form one class, and
only one row of each goes on. All n-grams are put in one order, the rare ones first: frequencies
are counted over all documents in a table of cells of fixed size; an n-gram that makes up one in
``MOST_FREQUENT`` of all occurrences or more is counted exactly and comes after all others, by that
count; equal ranks are ordered by hash. Any order gives exact results. Two sets of the wanted
similarity share an n-gram in their prefixes, so candidates are joined on those, in two passes:

1. In each prefix n-gram the row that has it earliest is the centre; every other row
   is checked against it. Groups of near copies come together here with one check per copy.
2. What still lies in different components is joined pair by pair. No pair within a component
   is formed, and none that the first pass has verified.

N-grams whose rows are all too far apart in size to be linked are left out before. In both passes
a length filter, a positional filter and a suffix filter (parities of n-grams by hash class, over
the whole sets) come before the verification on the whole sets, once per pair. In the second pass a pair is met only where its first common n-gram may be, and postings
carry folded parities; the full ones are met by the pairs left, and pairs of large sets then meet
parities that are as long as the sets ask for.

Words are maximal runs of characters other than ASCII white space, A-Z lower-cased. A text of
fewer words than ``n`` has one n-gram, its whole sequence; a text without words and a null text
have none and are linked with nothing. Rows of equal ids with different texts are searched each for
itself and may lie in different components. Rows without id have a null component. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvine.llm import bloom
from tallyvine.llm.common import map_batches, slices, utf8
from tallyvine.llm.components import components
from tallyvine.sources.scratch import store

WORDS = 5
PERCENT = 80
#: Cells of the frequency table and the parts it is summed in. 4 MB whatever the input.
CELLS = 1 << 22
_PART = 1 << 16
#: At most so many n-grams can each make up this part of all occurrences: 12 MB of hashes and counts.
MOST_FREQUENT = 1 << 20
#: Bits of a set's parity vector; one 64-bit word per 64 hash classes.
_PARITY_BITS = 1024
#: 64-bit words of the parities that postings carry: the full vector folded.
_FOLDED_WORDS = 4
#: Larger sets than this have a second parity vector, of two to four bits per n-gram.
_LARGE = 512
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text hashed at a time.
_BLOCK = 1 << 20
_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_BLANK = np.isin(np.arange(256), [ord(blank) for blank in _BLANKS])
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    bases = int(_MULTIPLIER), pow(int(_MULTIPLIER), -1, 2**64)
    steps = [np.full(size + 1, base, np.uint64) for base in bases]
    for row in steps:
        row[0] = 1
    return tuple(np.cumprod(row, dtype=np.uint64) for row in steps)


def _words_of(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: differences of one running polynomial hash of the bytes."""
    data = np.frombuffer(block, np.uint8)
    blank = np.concatenate([[True], _BLANK[data], [True]])
    starts, ends = np.flatnonzero(blank[:-2] & ~blank[1:-1]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
    power, inverse = _powers(max(_BLOCK + 1, len(data)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in blocks that end between words."""
    at = 0
    while len(text) - at > _BLOCK:
        end = max(text.rfind(blank, at, at + _BLOCK) for blank in _BLANKS)
        if end <= at:
            end = min((x for blank in _BLANKS if (x := text.find(blank, at + _BLOCK)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and their number per text."""
    lengths = np.array([len(text) for text in texts], np.int64)
    if lengths.sum() + len(texts) <= _BLOCK:
        hashes, starts = _words_of(b"\n".join(texts))
        firsts = np.cumsum(lengths + 1) - lengths - 1
        return hashes, np.diff(np.append(np.searchsorted(starts, firsts), len(starts)))
    found = [np.concatenate([_words_of(piece)[0] for piece in _pieces(text)]) for text in texts]
    return np.concatenate(found), np.array([len(hashes) for hashes in found])


def gram_hashes(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts, with repeats, and their number per text."""
    hashes, words = _word_hashes(texts)
    ends = np.cumsum(words)
    total = np.zeros(len(hashes), np.uint64)
    whole = np.zeros(len(texts), np.uint64)
    for k in range(n):
        factor = np.uint64(pow(int(_MULTIPLIER), k, 2**64))
        total[: max(0, len(hashes) - k)] += hashes[k:] * factor
        has = words > k
        whole[has] += hashes[(ends - words + k)[has]] * factor
    inside = np.ones(len(hashes), bool)
    for k in range(1, n):
        inside[(ends - k)[words >= k]] = False
    grams = _mixed(total + np.uint64(n))
    # The first word of a short text stands for its whole sequence.
    short = (words > 0) & (words < n)
    firsts = (ends - words)[short]
    inside[firsts] = True
    grams[firsts] = _mixed(whole[short] + words[short].astype(np.uint64))
    return grams[inside], np.where(short, 1, np.maximum(words - n + 1, 0))


def shingle_hashes(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Of each text the distinct n-grams as sorted 64-bit hashes."""
    grams, sizes = gram_hashes(texts, n)
    return [np.unique(part) for part in np.split(grams, np.cumsum(sizes)[:-1])] if texts else []


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts byte by byte of rising weight: few of the upper ones are not zero."""
    coder = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return coder.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) + coder.flush()


def _restored(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(payload), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _count_cells(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in slices(batches):
            hashes = gram_hashes(utf8(batch.column(0)), n)[0]
            np.add.at(cells, (hashes % np.uint64(CELLS)).astype(np.int64), np.uint32(1))
        if cells.any():
            parts = [_squeezed(cells[at : at + _PART]) for at in range(0, CELLS, _PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["part", "cells"])

    return run


def _levels(counts: np.ndarray, most: int) -> np.ndarray:
    """Ranks of frequency in steps of an eighth of a doubling, one byte each."""
    return np.minimum(most, np.round(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = None, None

    def rank():
        columns = [pa.array([part], pa.int32()), pa.array([_levels(total, 255).tobytes()]), pa.array([int(total.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "cells", "total"])

    for batch in batches:
        for now, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now != part:
                if part is not None:
                    yield rank()
                part, total = now, np.zeros(_PART, np.uint64)
            total += _restored(cells)
    if part is not None:
        yield rank()


def _in_cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(CELLS)).astype(np.int64)


def _proposed(n: int, full):
    """Occurrences, per slice of texts, of the n-grams in cells that are full enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = gram_hashes(utf8(batch.column(0)), n)[0]
            grams, times = np.unique(hashes[full.value[_in_cells(hashes)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times, pa.int64())], names=["gram", "times"])

    return run


class Rarity:
    """Ranks of n-grams by frequency: of each cell, and above all of those the counted n-grams."""

    def __init__(self, cells: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.cells, self.grams = cells, grams[order]
        self.ranks = 256 + _levels(counts[order], 255).astype(np.uint16)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        found = self.cells[_in_cells(hashes)].astype(np.uint16)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
            found = np.where(self.grams[at] == hashes, self.ranks[at], found)
        return found


def rarity(texts: DataFrame, n: int = WORDS, most: int = MOST_FREQUENT) -> Rarity:
    """Ranks of frequency from all texts.

    No n-gram occurs more often than its cell, so the cells propose those that may be one of ``most``
    occurrences; they are then counted exactly, and no more than ``most`` of them can be.
    """
    spark = texts.sparkSession
    counted = map_batches(texts, _count_cells(n), "part int, cells binary")
    arranged = counted.repartition("part").sortWithinPartitions("part")
    cells, total = np.zeros(CELLS, np.uint8), 0
    for row in map_batches(arranged, _sum_cells, "part int, cells binary, total long").collect():  # CELLS bytes in all
        cells[row.part * _PART : (row.part + 1) * _PART] = np.frombuffer(row.cells, np.uint8)
        total += row.total
    least = max(2, -(-total // most))
    # Levels are rounded: one below that of the bound may still hold it.
    full = cells >= max(0, int(_levels(np.array([least]), 255)[0]) - 1)
    if not full.any():
        return Rarity(cells, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    proposed = map_batches(texts, _proposed(n, spark.sparkContext.broadcast(full)), "gram long, times long")
    counts = proposed.groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= least).toArrow()
    grams = counts.column("gram").to_numpy().view(np.uint64)
    return Rarity(cells, grams, counts.column("times").to_numpy())


def _least_overlap(a, b, percent: int):
    """The smallest intersection of sets of these sizes that reaches the similarity."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two sums of hashes that name each set, together with its size."""
    sums = [[values.sum(dtype=np.uint64) for values in row] for row in (sets, map(_mixed, sets))]
    return [pa.array(np.array(row, np.uint64).view(np.int64)) for row in sums]


def _long_parity(hashes: np.ndarray) -> np.ndarray | None:
    """Parities of a large set by the lower bits of its hashes, so that a vector folds to one of half the length."""
    if len(hashes) <= _LARGE:
        return None
    bits = 1 << (2 * len(hashes) - 1).bit_length()
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _describe(n: int, percent: int, order_of):
    """Size, key, prefix and parities by hash class of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_hashes(utf8(batch.column(1)), n)
            heads, parities = [], []
            for hashes in sets:
                order = np.argsort(order_of.value.of(hashes), kind="stable")
                # Sets of the wanted similarity share one of the first size - least overlap + 1.
                heads.append(hashes[order[: len(hashes) - -(-percent * len(hashes) // 100) + 1]].view(np.int64))
                odd = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=_PARITY_BITS) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            columns = [pa.array([len(hashes) for hashes in sets], pa.int64()), *_set_keys(sets)]
            longs = [_long_parity(hashes) for hashes in sets]
            columns += [pa.array(lists, pa.list_(pa.int64())) for lists in (heads, parities, longs)]
            names = ["row", "n_shingles", "key1", "key2", "head", "parity", "long_parity"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def _whole(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [hashes.view(np.int64) for hashes in shingle_hashes(utf8(batch.column(1)), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    return run


def _sets_of(nodes: DataFrame, chosen: DataFrame, slim: DataFrame, n: int) -> DataFrame:
    """(node, grams) of the nodes, hashed anew from their texts."""
    wanted = store(nodes.distinct().join(chosen.select("node", "row"), "node"))
    # A filter of bounded size keeps most other texts out of the shuffle.
    texts = bloom.reduced(slim, "row", wanted, "row").join(wanted, "row").dropDuplicates(["node"])
    return store(map_batches(texts.select("node", "text"), _whole(n), "node long, grams array<long>"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _folded(parity: str) -> Column:
    """Parities of fewer, wider hash classes."""
    words = range(_PARITY_BITS // 64)
    return F.array(*[reduce(Column.bitwiseXOR, [F.col(parity)[k] for k in words[at::_FOLDED_WORDS]]) for at in range(_FOLDED_WORDS)])


def _may_overlap(percent: int, words: int = _PARITY_BITS // 64):
    """Suffix filter on sets of sizes m, n and parity vectors x, y of so many 64-bit words.

    An element of one set only turns one parity over, so the vectors differ in at most as many
    places as the sets do.
    """
    x, y = F.col("x"), F.col("y")
    apart = reduce(add, [F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(words)])
    return F.col("m") + F.col("n") - apart >= 2 * _least_overlap(F.col("m"), F.col("n"), percent)


def _halved(words: Column) -> Column:
    half = F.shiftright(F.size(words), 1)
    return F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _long_may_overlap(percent: int):
    """The same filter on long parities x, y, of lengths that are equal or twice the other."""
    x, y = F.col("x"), F.col("y")
    p, q = F.when(F.size(x) > F.size(y), _halved(x)).otherwise(x), F.when(F.size(y) > F.size(x), _halved(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(p, q, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, n: total + n)
    return F.col("m") + F.col("n") - apart >= 2 * _least_overlap(F.col("m"), F.col("n"), percent)


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _described(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (node, ...) of the stored pairs' ends, and a few others."""
    return bloom.reduced(table, "node", store(_ends(pairs).distinct()), "node")


def _left(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of the stored (a, b, m, n) that the long parities of large sets leave."""
    large = F.least("m", "n") > _LARGE
    few = pairs.where(large)
    held = _described(parities, few)
    met = few.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").where(_long_may_overlap(percent))
    return store(pairs.where(~large).select("a", "b").unionByName(met.select("a", "b")))


def _size_band(percent: int) -> Column:
    """A bit for the size. Sizes that fit have the same one or neighbouring ones."""
    # Bands are a little wider than asked for, so that rounding moves no size on to the band after the next.
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(101 / percent)))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.least(band, F.lit(62)).cast("int"))


def _centres(postings: DataFrame, percent: int) -> DataFrame:
    """(gram, b, n, j): the row that has it earliest, of each n-gram in which two sizes may fit."""
    found = postings.groupBy("gram").agg(
        F.min(F.struct("place", "node", "size")).alias("first"),
        F.count("*").alias("n"),
        F.bit_or(_size_band(percent)).alias("bands"),
    )
    bands = F.col("bands")
    close = (F.bit_count(bands) < F.col("n")) | (bands.bitwiseAND(F.shiftright(bands, 1)) != 0)
    found = found.where(close)
    return found.select("gram", F.col("first.node").alias("b"), F.col("first.size").alias("n"), F.col("first.place").alias("j"))


def _verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    left = grams.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    # Few rows are the second of a pair; the sets of the others need not move.
    right = right.join(pairs.select("b").distinct(), "b", "left_semi")
    shared = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), shared.alias("s"))
    return met.where(100 * F.col("s") >= percent * (F.col("m") + F.col("n") - F.col("s"))).select("a", "b")


def _row_key(id_column: str, text_column: str) -> Column:
    """What a row is known by: its id and a hash of its text, ordered by id."""
    mark = F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("mark")
    return F.struct(F.col(id_column).alias("id"), mark).alias("row")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(_row_key(id_column, text_column), F.col(text_column).alias("text"))


def _linked_rows(slim: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row (row, n_shingles, first), the smallest row reachable by links."""
    spark = slim.sparkSession
    order_of = spark.sparkContext.broadcast(rarity(slim.select("text"), n))
    longs = T.ArrayType(T.LongType())
    key = ["n_shingles", "key1", "key2"]
    columns = [*((name, T.LongType()) for name in key), ("head", longs), ("parity", longs), ("long_parity", longs)]
    described = T.StructType([slim.schema["row"], *(T.StructField(*column) for column in columns)])
    each = map_batches(slim, _describe(n, percent, order_of), described)
    each = store(each.withColumn("node", F.monotonically_increasing_id()))
    members = each.select("row", *key)

    # One row speaks for all of equal sets. It goes by the number given as it is stored.
    real = "row.id is not null and n_shingles > 0"
    numbered = each.where(real).select("row", "node", *key)
    classes = store(numbered.groupBy(*key).agg(F.min(F.struct("row", "node")).alias("least")))
    others = store(numbered.join(classes, key).where("node <> least.node").select("node"))
    rows = each.where(real).drop("long_parity")
    chosen = store(bloom.without(rows, "node", others, "node").withColumnRenamed("n_shingles", "size"))

    # N-grams in one prefix only lead nowhere.
    posting = chosen.select("node", "size", F.posexplode("head").alias("place", "gram"))
    shared = store(posting.groupBy("gram").count().where("count > 1").select("gram"))
    postings = store(bloom.reduced(posting, "gram", shared, "gram").join(shared, "gram"))
    # So do those that no two rows of fitting sizes have.
    star = store(postings.join(_centres(postings, percent), "gram"))
    postings = star.select("gram", "node", "size", "place")
    star = star.withColumnsRenamed(dict(node="a", size="m", place="i"))
    star = star.where((F.col("a") != F.col("b")) & _sizes_fit("m", "n", percent))
    # Of the n-grams up to this one at most so many are common, and of what lies ahead.
    bound = F.least("i", "j") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    star = star.groupBy("a", "b", "m", "n").agg(F.min(bound).alias("bound"))
    star = star.where(F.col("bound") >= _least_overlap(F.col("m"), F.col("n"), percent))
    parities = chosen.select("node", "parity")
    star = star.join(parities.toDF("a", "x"), "a").join(parities.toDF("b", "y"), "b").where(_may_overlap(percent))
    star = store(star.select("a", "b", "m", "n"))
    long_parities = each.where(F.col("long_parity").isNotNull()).select("node", "long_parity")
    near = _left(star, long_parities, percent)
    links = store(_verified(near, _sets_of(_ends(near), chosen, slim, n), percent))
    merged = components(links)
    labelled = postings.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = store(labelled)
    # Per n-gram, one component is set aside; only the others look for partners, in all of them.
    counted = labelled.groupBy("gram", "component").agg(F.count("*").alias("n")).groupBy("gram").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.max(F.struct("n", "component")).alias("largest")
    )
    open_grams = store(counted.where("least <> most").select("gram", F.col("largest.component").alias("main")))
    folded = chosen.select("node", _folded("parity").alias("parity"))
    both = store(labelled.join(open_grams, "gram").join(folded, "node"))
    names = dict(node="a", size="m", place="i", component="c", parity="x"), dict(node="b", size="n", place="j", component="d", parity="y")
    few = both.where("component <> main").withColumnsRenamed(names[0])
    rest = both.drop("main").withColumnsRenamed(names[1])
    # A pair outside the main component is met from both its ends; the smaller one keeps it.
    once = (F.col("d") == F.col("main")) | (F.col("a") < F.col("b"))
    need = _least_overlap(F.col("m"), F.col("n"), percent)
    ahead = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    met = few.join(rest, "gram").where((F.col("c") != F.col("d")) & once & _sizes_fit("m", "n", percent))
    # All common n-grams of a pair lie ahead of its first one, so linked pairs are met there.
    met = met.where((ahead >= need) & _may_overlap(percent, _FOLDED_WORDS))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # What the first pass has verified is known.
    seen = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = store(pairs.join(seen, ["a", "b"], "left_anti"))
    whole = _described(chosen.select("node", "size", "parity"), pairs)
    pairs = pairs.join(whole.toDF("a", "m", "x"), "a").join(whole.toDF("b", "n", "y"), "b").where(_may_overlap(percent))
    pairs = _left(store(pairs.select("a", "b", "m", "n")), long_parities, percent)
    more = _verified(pairs, _sets_of(_ends(pairs), chosen, slim, n), percent)
    final = components(links.unionByName(more))

    # The smallest row of a component is the smallest of its classes' smallest rows.
    placed = chosen.join(final, "node", "left").select(
        "row", F.col("size").alias("n_shingles"), "key1", "key2", F.coalesce("component", "node").alias("component")
    )
    firsts = placed.groupBy("component").agg(F.min("row").alias("first"))
    placed = placed.join(firsts, "component").select(*key, "first")
    linked = members.where(real).join(placed, key).select("row", "n_shingles", "first")
    alone = members.where(f"not ({real})").select("row", "n_shingles", F.col("row").alias("first"))
    return linked.unionByName(alone)


def link_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable by links."""
    linked = _linked_rows(_rows(docs, id_column, text_column), n, percent)
    return linked.select(F.col("row.id").alias(id_column), "n_shingles", F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, of the smallest id; rows without id stay.

    Of rows with one id those with different texts count each for itself: only copies go. Rows
    without words are copies of nothing but a row of the same id and text.
    """
    linked = _linked_rows(_rows(docs, id_column, text_column), WORDS, PERCENT)
    kept = linked.where("row = first and row.id is not null").select("row").distinct()
    # Whole rows in one column, as theirs may have any names.
    named = docs.select(_row_key(id_column, text_column), F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("whole"))
    named = named.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("whole.*")
    return named.unionByName(docs.where(F.col(id_column).isNull()))
