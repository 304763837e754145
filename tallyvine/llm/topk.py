"""Exact top-k search by BM25 over a sharded inverted index with block-max WAND pruning.

The index covers all rows. A shard holds a bounded number of documents, numbered by rising id:
one row with their ids and lengths, and rows of many terms each with their compressed postings. Corpus
statistics (documents, mean length, document frequencies) come from all shards, so scores do
not depend on the sharding. A few shards are searched together, as one space of documents that stand
beside those like them, in language and length, and are cut into blocks; a long list has its highest
impact per block.

Queries are whole texts of hundreds of terms, so WAND's cursors move over blocks and not over single
documents, and many queries move together: rare lists, of highest impact, are added up at once and
give a threshold that k documents reach; blocks where the maxima of the lists left cannot lift any
document over it are skipped, and for what is in reach the long lists are added up as matrix
products, each query's likeliest blocks first, with the threshold renewed on the way. The products
are rounded, their error is bounded, and what comes within it of the threshold is added up exactly.
The groups' top k are merged per query.

Scores are exact: each term adds a whole number of millionths, ties go to the smaller id. Queries
travel in packets, each a few thousand queries with one list of their terms and numbers into it.
Postings go to their group once, as they are stored, and meet no other table on the way; each
packet goes once to each group. Within a task one group is in memory, its impacts reckoned when a
term is first asked for; packets stream past it.

Words are maximal runs of characters other than ASCII white space, A-Z lower-cased. Null texts
have none; they are indexed and never found. Rows with equal or null ids are documents of their
own and tie in any order. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyvine.llm import bloom
from tallyvine.llm.common import map_batches, slices, utf8
from tallyvine.sources.scratch import store

K = 10
K1, B = 1.2, 0.75
#: Documents and bytes of text that close a shard.
SHARD_DOCUMENTS = 8192
SHARD_BYTES = 32 << 20
#: Shards that are searched together: so many of the largest, or more smaller ones.
GROUP_SHARDS = 3
#: Documents per block.
BLOCK = 32
#: Postings that close a row of the index, and queries that travel together.
PART_POSTINGS = 1 << 16
PACKET_QUERIES = 2048
#: Bytes of an Arrow batch where the session sets no number: rows of the index and packets are large.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _packed(*numbers: np.ndarray) -> bytes:
    return pa.compress(b"".join(x.tobytes() for x in numbers), codec="zstd", asbytes=True)


def _unpacked(payload: bytes, size: int) -> memoryview:
    return memoryview(pa.decompress(payload, size, codec="zstd"))


def _steps(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rising lists, one after the other, as their first numbers and the differences that follow."""
    steps = np.diff(numbers, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = numbers[starts]
    return steps.astype(np.uint32)


def _climbed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lists of which these are the steps."""
    sums = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    return sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)


def _split(joined: str) -> pa.Array:
    """The terms of a row; none has a blank."""
    return pc.list_flatten(pc.split_pattern(pa.array([joined], pa.large_string()), " "))


#: Letters in lower case, and every white space a blank.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, and per word of the texts its number among them and the number of its text."""
    pieces = pc.split_pattern(pa.array([text.translate(_PLAIN) for text in texts], pa.large_binary()).view(pa.large_string()), " ")
    owner = np.repeat(np.arange(len(texts)), np.diff(pieces.offsets.to_numpy()))
    coded = pieces.flatten().dictionary_encode()
    names, terms = coded.dictionary.view(pa.large_binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if b"" in names:
        # Between two blanks, before the first and behind the last is no word.
        nothing = names.index(b"")
        names.pop(nothing)
        held = terms != nothing
        terms, owner = terms[held], owner[held]
        terms -= terms > nothing
    return names, terms, owner


def _index(schema: pa.Schema, shard_documents: int, shard_bytes: int):
    def shard_rows(shard: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))
        names, terms, owner = _words([texts[i] for i in order])
        lengths = np.bincount(owner, minlength=len(order))
        pairs, frequencies = np.unique(terms * len(order) + owner, return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(names) + 1) * len(order))
        own = dict(shard=shard, doc_ids=[ids[i] for i in order], lengths=lengths.tolist())
        yield pa.RecordBatch.from_pylist([own], schema)
        start = 0
        while start < len(names):
            end = min(len(names), int(np.searchsorted(ends, ends[start] + PART_POSTINGS)))
            sizes, held = np.diff(ends[start : end + 1]), slice(ends[start], ends[end])
            steps = _steps(pairs[held] % len(order), sizes)
            part = dict(shard=shard, terms=b" ".join(names[start:end]).decode(), sizes=sizes)
            yield pa.RecordBatch.from_pylist([part | dict(payload=_packed(steps, frequencies[held].astype(np.uint32)))], schema)
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(name)
                texts.append(text)
                size += len(text)
                if len(ids) >= shard_documents or size >= shard_bytes:
                    yield from shard_rows(shard, ids, texts)
                    shard, ids, texts, size = shard + 1, [], [], 0
        if ids:
            yield from shard_rows(shard, ids, texts)

    return run


def build_index(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_documents: int = SHARD_DOCUMENTS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The stored index. Per shard one row with doc_ids and lengths, numbered from 0, and rows with terms.

    Those have the terms joined by blanks, the documents of each (sizes) and the packed postings of all:
    document numbers as steps, then frequencies.
    """
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(slim.schema["doc_id"].dataType)),
            T.StructField("lengths", numbers),
            T.StructField("terms", T.StringType()),
            T.StructField("sizes", numbers),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    return store(map_batches(slim, _index(to_arrow_schema(schema), shard_documents, shard_bytes), schema))


def statistics(index: DataFrame) -> tuple[int, float]:
    """Documents and their mean length."""
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    row = index.where("terms is null").agg(F.sum(F.size("lengths")), F.sum(lengths)).first()
    return row[0] or 0, (row[1] or 0) / max(1, row[0] or 0)


def document_queries(
    docs: DataFrame,
    index: DataFrame,
    documents: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    terms: int | None = None,
    least_documents: int = 1,
) -> DataFrame:
    """(query, term, idf): per document all distinct terms of its whole text.

    On request only the ``terms`` of highest weight tf x idf, ties by term, or those in
    ``least_documents`` documents at least. Rows without id are no queries.
    """
    flat = F.translate(F.col(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    words = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("query"), F.explode(F.split(flat, " ")).alias("term"))
    weights = store(words.where("term <> ''").groupBy("query", "term").agg(F.count("*").alias("tf")))
    asked = store(weights.select("term").distinct())
    lists = F.arrays_zip(F.split("terms", " ").alias("term"), F.col("sizes").alias("n"))
    lists = index.where("terms is not null").select(F.explode(lists).alias("list")).select("list.term", "list.n")
    held = bloom.reduced(lists, "term", asked, "term")
    known = held.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= least_documents)
    idf = F.log((F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    met = weights.join(known, "term").select("query", "term", "tf", idf.alias("idf"))
    if terms is None:
        return store(met.select("query", "term", "idf"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round(F.col("tf") * F.col("idf") * 1e6).cast("long")), "term")
    return store(met.withColumn("at", F.row_number().over(best)).where(F.col("at") <= terms).select("query", "term", "idf"))


class Postings:
    """The postings of a group of shards, in lists by rising number of the term, with maxima per block.

    A block is ``BLOCK`` neighbouring documents, a part a range of blocks; ``parts`` has their bounds.
    A list that many documents of a part share is long in it: a column of the part's matrix, with a row
    per document, and of its maxima, with a row per block. What is long in no part, or too large to be
    exact in four bytes, stays a list of documents with their impacts.
    ``skipped`` counts the blocks left out per query before their long lists were read.
    """

    def __init__(
        self, numbers: np.ndarray, sizes: np.ndarray, documents: np.ndarray, impacts: np.ndarray, ranks: np.ndarray, parts: np.ndarray | None = None
    ):
        self.ranks, self.skipped = ranks, 0
        self.blocks = max(1, -(-len(ranks) // BLOCK))
        self.parts = np.array([0, self.blocks]) if parts is None else parts
        self.home = np.repeat(np.arange(len(self.parts) - 1), np.diff(self.parts)).astype(np.int16)
        heads = np.flatnonzero(np.diff(numbers, prepend=-1)) if len(numbers) else np.zeros(0, np.int64)
        self.terms = numbers[heads].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.append(heads, len(numbers))]
        self._choose(bounds, documents)
        self._divide(bounds, documents, impacts)
        widths = [len(x) for x in self.columns]
        self.matrices = [np.zeros((n * BLOCK, width), np.float32) for n, width in zip(np.diff(self.parts), widths, strict=True)]
        self.maxima = [np.zeros((n, width), np.float32) for n, width in zip(np.diff(self.parts), widths, strict=True)]
        # Sums of so many numbers of four bytes are off by less than this part of them.
        self.error = (max(widths) + 8) * 2.0**-23
        self.filled, self.wide = np.zeros(len(self.terms), bool), np.zeros(len(self.terms), bool)

    def _choose(self, bounds: np.ndarray, documents: np.ndarray) -> None:
        """Which terms are long in which part, the densest if not all have room; their columns."""
        room = np.diff(self.parts) * BLOCK
        some = np.flatnonzero(np.diff(bounds) * _SHARE * len(room) >= room.sum())
        met = np.zeros((len(some), len(room)), np.int64)
        for i, term in enumerate(some.tolist()):
            met[i] = np.bincount(self.home[documents[bounds[term] : bounds[term + 1]] // BLOCK], minlength=len(room))
        dense = met / room
        order = np.argsort(-dense, axis=None, kind="stable")
        part = order % len(room)
        taken = order[(dense.ravel()[order] * _SHARE >= 1) & (np.cumsum(4 * room[part]) <= _MATRIX_BYTES)]
        chosen = np.zeros(met.shape, bool)
        chosen.ravel()[taken] = True
        kept = chosen.any(1)
        self.slot = np.full(len(self.terms), -1, np.int64)
        self.slot[some[kept]] = np.arange(np.count_nonzero(kept))
        self.column = np.where(chosen[kept], np.cumsum(chosen[kept], axis=0) - 1, -1)
        self.columns = [np.flatnonzero(x) for x in chosen[kept].T]

    def _divide(self, bounds: np.ndarray, documents: np.ndarray, impacts: np.ndarray) -> None:
        """Short and long lists, each the postings of one term after those of another."""
        long, sizes, counts = np.zeros(len(documents), bool), np.diff(bounds), np.zeros(len(bounds), np.int64)
        for some in _runs(sizes, _POSTINGS):
            held = slice(bounds[some.start], bounds[some.stop])
            slot, homes = np.repeat(self.slot[some], sizes[some]), self.home[documents[held] // BLOCK]
            long[held] = (slot >= 0) & (self.column[slot, homes] >= 0) if len(self.column) else False
            counts[some.start + 1 : some.stop + 1] = np.diff(np.append(0, np.cumsum(long[held]))[bounds[some.start : some.stop + 1] - held.start])
        ends = np.cumsum(counts)
        self.long = ends, _paired(documents, impacts, long)
        np.logical_not(long, out=long)
        self.short = bounds - ends, _paired(documents, impacts, long)

    def fill(self, terms: np.ndarray, weigh=None) -> None:
        """Make the lists at these places ready; ``weigh`` turns (terms, documents, impacts) into impacts."""
        terms = np.unique(terms[~self.filled[terms]])
        if not len(terms):
            return
        for bounds, pairs in (self.short, self.long) if weigh else ():
            sizes = bounds[terms + 1] - bounds[terms]
            for some in _runs(sizes, _POSTINGS):
                places = _places(bounds[terms[some]], sizes[some])
                documents, impacts = _parted(pairs[places])
                pairs[places] = _paired(documents, weigh(np.repeat(terms[some], sizes[some]), documents, impacts))
        bounds, pairs = self.long
        held = terms[self.slot[terms] >= 0]
        for term in held.tolist():
            rows, values = _parted(pairs[bounds[term] : bounds[term + 1]])
            if values.max() >= 1 << 24:
                self.wide[term] = True
                continue
            homes = self.home[rows // BLOCK]
            for part in np.flatnonzero(self.column[self.slot[term]] >= 0).tolist():
                inside, column = homes == part, self.column[self.slot[term], part]
                self.matrices[part][rows[inside] - self.parts[part] * BLOCK, column] = values[inside]
        if len(held):
            for matrix, maxima in zip(self.matrices, self.maxima, strict=True):
                matrix.reshape(len(maxima), BLOCK, -1 if matrix.size else 0).max(1, out=maxima)
        self.filled[terms] = True

    def best(self, terms: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, document) for terms given by number, ties by rank of the document."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return next(self.best_of([at[self.terms[at] == terms] if len(self.terms) else at[:0]], k))

    def best_of(self, queries: list[np.ndarray], k: int) -> Iterator[list[tuple[int, int]]]:
        """``best`` for each of many queries, of terms given by their places."""
        width = self.blocks * BLOCK
        together = min(len(queries), max(_FEWEST, min(_MOST, _SCORE_BYTES // (8 * width))))
        room = np.empty((together, width))
        for at in range(0, len(queries), together):
            some = queries[at : at + together]
            yield from self._together(some, k, room[: len(some)])

    def _add_short(self, queries: list[np.ndarray], scores: np.ndarray, tops: np.ndarray) -> None:
        """Sums of the short lists per document, and their maxima per block. The room for postings is used again and again."""
        bounds, pairs = self.short
        most = max(int((bounds[asked + 1] - bounds[asked]).sum()) for asked in queries)
        both, rows, values = np.empty(most, np.int64), np.empty(most, np.int64), np.empty(most)
        firsts = np.arange(0, scores.shape[1], BLOCK)
        for asked, sums, highest in zip(queries, scores, tops, strict=True):
            starts, ends = bounds[asked], bounds[asked + 1]
            total = int((ends - starts).sum())
            if total:
                lists = [pairs[start:end] for start, end in zip(starts.tolist(), ends.tolist(), strict=True) if end > start]
                np.concatenate(lists, out=both[:total])
                values[:total], rows[:total] = _parted(both[:total])[::-1]
            # Sums of whole numbers far below 2^53: exact.
            sums[:] = np.bincount(rows[:total], values[:total], len(sums))
            if self.wide[asked].any():
                sums += np.bincount(*self._listed(self.long, asked[self.wide[asked]]), minlength=len(sums))
            np.maximum.reduceat(sums, firsts, out=highest)

    def _listed(self, lists: tuple, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of these lists."""
        bounds, pairs = lists
        return _parted(pairs[_places(bounds[terms], bounds[terms + 1] - bounds[terms])])

    def _together(self, queries: list[np.ndarray], k: int, scores: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        terms = np.concatenate(queries)
        owner = np.repeat(np.arange(len(queries)), [len(x) for x in queries])
        self.fill(terms)
        tops = np.empty((len(queries), self.blocks))
        self._add_short(queries, scores, tops)
        long = np.flatnonzero((self.slot[terms] >= 0) & ~self.wide[terms])
        asks = np.zeros((len(queries), len(self.column)), np.float32)
        asks[owner[long], self.slot[terms[long]]] = 1
        masks = [np.take(asks, columns, axis=1) for columns in self.columns]
        # Documents of k blocks reach it, so the k-th best of all does.
        least = np.partition(tops, -k, axis=1)[:, -k] if self.blocks >= k else np.zeros(len(queries))
        # What a document of each block can reach.
        tops += np.concatenate([mask @ maxima.T for mask, maxima in zip(masks, self.maxima, strict=True)], axis=1)
        tops *= 1 + self.error
        found = self._visit(scores, masks, tops, least, k)
        who, documents, sums = self._exact(scores, masks, *found)
        few = np.bincount(who[sums > 0], minlength=len(queries)) < k
        if few.any():
            # Fewer than k documents with a score: those that a term adds nothing to are found as well.
            near = [np.unique(np.concatenate([self._listed(lists, queries[i])[0] for lists in (self.short, self.long)])) for i in np.flatnonzero(few)]
            whole = self._exact(scores, masks, np.repeat(np.flatnonzero(few), [len(x) for x in near]), np.concatenate(near).astype(np.int64))
            who, documents, sums = [np.concatenate([x[~few[who]], y]) for x, y in zip((who, documents, sums), whole, strict=True)]
        order = np.lexsort((self.ranks[documents], -sums, who))
        cuts = np.searchsorted(who[order], np.arange(len(queries) + 1))
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            first = order[start : min(end, start + k)]
            yield list(zip(sums[first].astype(np.int64).tolist(), documents[first].tolist(), strict=True))

    def _visit(self, scores: np.ndarray, masks: list, reach: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) of all that may be among the k best: from the blocks in reach, each query's likeliest stretch first."""
        stretches = [(part, b, min(b + _STRETCH, end)) for part, end in enumerate(self.parts[1:].tolist()) for b in range(self.parts[part], end, _STRETCH)]
        highest = np.maximum.reduceat(reach, [b for _, b, _ in stretches], axis=1)
        first, highest = highest.argmax(1), np.ascontiguousarray(highest.T)
        best, least = np.zeros((len(least), k)), least.copy()
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        read = 0
        for again in (False, True):
            for at, (part, start, end) in enumerate(stretches):
                asking = np.flatnonzero(((first != at) == again) & (highest[at] >= least) & (highest[at] > 0))
                if not len(asking):
                    continue
                blocks = np.flatnonzero((reach[asking, start:end] >= least[asking, None]).any(0)) + start
                read += len(asking) * len(blocks)
                base = self.parts[part] * BLOCK
                if len(blocks) == end - start:
                    documents = np.arange(start * BLOCK, end * BLOCK)
                    sums = masks[part][asking] @ self.matrices[part][documents[0] - base : documents[-1] + 1 - base].T
                    sums = sums + scores[asking, documents[0] : documents[-1] + 1]
                else:
                    documents = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                    sums = masks[part][asking] @ self.matrices[part][documents - base].T
                    sums = sums + scores[asking[:, None], documents]
                near = sums >= np.maximum(least[asking] * (1 - self.error), 0.5)[:, None]
                rows = np.flatnonzero(near.any(1))
                if len(rows):
                    columns = np.flatnonzero(near.any(0))
                    near, sums, rows = near[rows][:, columns], sums[rows][:, columns], asking[rows]
                    who, which = np.nonzero(near)
                    found.append((rows[who], documents[columns[which]], sums[who, which]))
                    best[rows] = np.partition(np.concatenate([best[rows], sums], axis=1), -k, axis=1)[:, -k:]
                    least[rows] = np.maximum(least[rows], best[rows].min(1) * (1 - self.error))
        self.skipped += len(least) * self.blocks - read
        who, documents, sums = [np.concatenate(x) for x in zip(*found, strict=True)]
        kept = sums >= least[who] * (1 - self.error)
        return who[kept], documents[kept]

    def _exact(self, scores: np.ndarray, masks: list, who: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """These queries and documents with their scores."""
        sums, homes = scores[who, documents], self.home[documents // BLOCK]
        for part, (mask, matrix) in enumerate(zip(masks, self.matrices, strict=True)):
            inside = np.flatnonzero(homes == part)
            for at in range(0, len(inside), _PAIRS):
                some = inside[at : at + _PAIRS]
                rows = matrix[documents[some] - self.parts[part] * BLOCK]
                rows *= mask[who[some]]
                sums[some] += rows.sum(1, dtype=float)
        return who, documents, sums


#: A list is long in a part if one of so many of its documents is in it, as far as the matrices of a group have room.
_SHARE = 24
_MATRIX_BYTES = 48 << 20
#: Blocks that are added up together, and (query, document) pairs that are.
_STRETCH = 16
_PAIRS = 1024
#: Queries answered together: as many as their scores have room for, between the two numbers.
_SCORE_BYTES = 56 << 20
_FEWEST, _MOST = 16, 256
#: Postings handled at a time, and lists.
_POSTINGS = 1 << 18
_LISTS = 1 << 14


#: A document and its impact, as one number of eight bytes.
_PAIR = np.dtype([("impact", "<u4"), ("document", "<i4")])


def _paired(documents: np.ndarray, impacts: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    pairs = np.empty(len(documents) if chosen is None else np.count_nonzero(chosen), _PAIR)
    pairs["document"] = documents if chosen is None else documents[chosen]
    pairs["impact"] = impacts if chosen is None else impacts[chosen]
    return pairs.view(np.int64)


def _parted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = pairs.view(_PAIR)
    return parts["document"], parts["impact"]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all postings of lists."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring lists with so many postings together, or one list; ``_LISTS`` at most."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        end = min(max(start + 1, end), start + _LISTS)
        yield slice(start, end)
        start = end


def _rank(name) -> tuple:
    return (True, name) if name is not None else (False,)


class _Group:
    """One group of shards as it arrives: its documents, then its postings, then packets of queries."""

    def __init__(self, mean: float):
        self.mean, self.names, self.lengths, self.offsets = mean, [], [], {}
        self.parts: tuple[list, ...] = ([], [], [], [])
        self.postings: Postings | None = None

    def add_documents(self, row: dict) -> None:
        self.offsets[row["shard"]] = len(self.names)
        self.names += row["doc_ids"]
        self.lengths.append(np.array(row["lengths"], np.int64))

    def add_postings(self, row: dict) -> None:
        sizes = np.array(row["sizes"], np.int64)
        total, shift = int(sizes.sum()), self.offsets[row["shard"]]
        numbers = np.frombuffer(_unpacked(row["payload"], 8 * total), np.uint32)
        documents = (_climbed(numbers[:total], sizes) + shift).astype(np.int32)
        for held, part in zip(self.parts, (_split(row["terms"]), sizes, documents, numbers[total:].copy()), strict=True):
            held.append(part)

    def _taken(self, part: int, kind) -> np.ndarray:
        """One array of the parts, which are dropped."""
        whole = np.concatenate([np.zeros(0, kind), *self.parts[part]])
        self.parts[part].clear()
        return whole

    def _arrange(self) -> None:
        """One list per term, over documents that stand beside those like them."""
        lengths = np.concatenate([np.zeros(0, np.int64), *self.lengths])
        coded = pa.chunked_array(self.parts[0] or [pa.array([], pa.large_string())]).dictionary_encode()
        self.parts[0].clear()
        self.terms, numbers = coded.chunk(0).dictionary, np.concatenate([chunk.indices.to_numpy() for chunk in coded.chunks])
        del coded
        pa.default_memory_pool().release_unused()
        sizes, documents, frequencies = self._taken(1, np.int64), self._taken(2, np.int32), self._taken(3, np.uint32)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(numbers, kind="stable")
        kinds = _alike(numbers, sizes, starts, documents, len(lengths))
        arranged = np.lexsort((-lengths, kinds))
        # Each kind begins with a block of its own; what is left of its last one stays empty.
        counts = np.bincount(kinds, minlength=1)
        blocks = -(-counts // BLOCK)
        parts = np.concatenate([[0], np.cumsum(blocks)])
        placed = np.arange(len(lengths)) + np.repeat(parts[:-1] * BLOCK - (np.cumsum(counts) - counts), counts)
        place = np.empty(len(lengths), np.int32)
        place[arranged] = placed
        held = np.zeros(parts[-1] * BLOCK, np.int64)
        held[placed] = arranged
        self.named = held
        ranks, self.norms = np.zeros(len(held), np.int64), np.ones(len(held))
        ranks[place[sorted(range(len(self.names)), key=lambda i: _rank(self.names[i]))]] = np.arange(len(lengths))
        if self.mean:
            self.norms[place] = K1 * (1 - B + B * lengths / self.mean)
        sizes, starts, numbers, at = sizes[order], starts[order], numbers[order], 0
        pairs = np.empty(len(documents), np.int64)
        for some in _runs(sizes, _POSTINGS):
            places = _places(starts[some], sizes[some])
            pairs[at : at + len(places)] = _paired(place[documents[places]], frequencies[places])
            at += len(places)
        del documents, frequencies, starts, order
        self.postings = Postings(numbers, sizes, *_parted(pairs), ranks, parts if len(lengths) else None)

    def answer(self, row: dict, k: int) -> Iterator[tuple]:
        """(query, document, score) of the k best documents of each query in a packet."""
        if self.postings is None:
            self._arrange()
        terms, sizes = _split(row["terms"]), np.array(row["sizes"], np.int64)
        payload = _unpacked(row["payload"], 8 * len(terms) + 4 * int(sizes.sum()))
        idf = np.frombuffer(payload[: 8 * len(terms)], np.float64)
        found = pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(found >= 0)
        own, weights = np.full(len(terms), -1), np.zeros(len(self.terms))
        own[found[known]], weights[known] = known, idf[found[known]]

        def weigh(lists: np.ndarray, documents: np.ndarray, tf: np.ndarray) -> np.ndarray:
            return np.rint(1e6 * weights[lists] * (tf * (K1 + 1)) / (tf + self.norms[documents]))

        self.postings.fill(known, weigh)
        numbers = own[_climbed(np.frombuffer(payload[8 * len(terms) :], np.uint32), sizes)]
        asked = [x[x >= 0] for x in np.split(numbers, np.cumsum(sizes)[:-1])]
        for query, best in zip(row["queries"], self.postings.best_of(asked, k), strict=True):
            for score, document in best:
                yield query, self.names[self.named[document]], score


#: Kinds of documents in a group, documents that make one up at least, and the terms and steps that tell them apart.
_KINDS, _KIND_DOCUMENTS, _KIND_TERMS, _KIND_STEPS = 8, 512, 256, 4


def _alike(numbers: np.ndarray, sizes: np.ndarray, starts: np.ndarray, documents: np.ndarray, total: int) -> np.ndarray:
    """A kind for each document by the frequent terms in it. Results do not depend on it, only what is skipped."""
    kinds = min(_KINDS, total // _KIND_DOCUMENTS)
    if kinds < 2 or not len(numbers):
        return np.zeros(total, np.int64)
    frequent = np.argsort(-np.bincount(numbers, sizes), kind="stable")[:_KIND_TERMS]
    column = np.full(int(numbers.max()) + 1, -1)
    column[frequent] = np.arange(len(frequent))
    lists = np.flatnonzero(column[numbers] >= 0)
    held = np.zeros((total, len(frequent)), np.float32)
    for some in _runs(sizes[lists], _POSTINGS):
        own = lists[some]
        held[documents[_places(starts[own], sizes[own])], np.repeat(column[numbers[own]], sizes[own])] = 1
    held *= np.log1p(total / np.maximum(1, held.sum(0)))
    held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-6)
    middle = held[np.linspace(0, total - 1, kinds).astype(np.int64)]
    for step in range(_KIND_STEPS):
        near = (held @ middle.T).argmax(1)
        if step < _KIND_STEPS - 1:
            middle = np.stack([held[near == kind].sum(0) for kind in range(kinds)])
            middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-6)
    return np.unique(near, return_inverse=True)[1]


def _search(schema: pa.Schema, k: int, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for batch in slices(batches, 1):
            row = {name: column[0].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True) if name not in _ARRAYS}
            row |= {name: batch.column(name).flatten().to_numpy() for name in _ARRAYS}
            if row["group"] != now:
                now, group = row["group"], _Group(mean)
            if row["kind"] == 0:
                group.add_documents(row)
            elif row["kind"] == 1:
                group.add_postings(row)
            elif found := list(group.answer(row, k)):
                arrays = [pa.array(x, field.type) for x, field in zip(zip(*found, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


_ARRAYS = ("lengths", "sizes")


def _pack(schema: pa.Schema):
    """Packets of queries: the terms asked for, frequent ones first, their idf, and numbers into them."""

    def packet(rows: pa.Table) -> pa.RecordBatch:
        asked = rows.column("asked").combine_chunks()
        sizes = asked.value_lengths().to_numpy().astype(np.int64)
        coded = asked.flatten().field("term").dictionary_encode()
        codes, first = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        order = np.argsort(-np.bincount(codes, minlength=len(first)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers, owner = place[codes], np.repeat(np.arange(len(sizes)), sizes)
        numbers = numbers[np.lexsort((numbers, owner))]
        idf = asked.flatten().field("idf").to_numpy()[first[order]]
        terms = " ".join(coded.dictionary.take(pa.array(order)).to_pylist())
        made = dict(queries=rows.column("query").to_pylist(), terms=terms, sizes=sizes, payload=_packed(idf, _steps(numbers, sizes)))
        return pa.RecordBatch.from_pylist([made], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = batch.column("packet").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and keys[start] != now:
                    yield packet(pa.Table.from_batches(held))
                    held = []
                now = keys[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield packet(pa.Table.from_batches(held))

    return run


def _packets(queries: DataFrame, packet_queries: int) -> DataFrame:
    """(queries, terms, sizes, payload): about so many queries each, dealt by hash."""
    lists = store(queries.groupBy("query").agg(F.collect_list(F.struct("term", "idf")).alias("asked")))
    number = max(1, -(-lists.count() // packet_queries))
    dealt = lists.withColumn("packet", F.pmod(F.xxhash64("query"), F.lit(number))).repartition(number, "packet").sortWithinPartitions("packet", "query")
    schema = T.StructType(
        [
            T.StructField("queries", T.ArrayType(queries.schema["query"].dataType)),
            T.StructField("terms", T.StringType()),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    return store(map_batches(dealt, _pack(to_arrow_schema(schema)), schema))


def _placed(index: DataFrame, group_shards: int) -> DataFrame:
    """(shard, group), one row per shard: each group by the words and documents of the shards before it."""
    words = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    shards = index.where("terms is null").select("shard", (F.size("lengths") + words).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    most = F.max("size").over(Window.partitionBy()) * group_shards
    return store(shards.select("shard", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / most).cast("int").alias("group")))


def search(
    index: DataFrame,
    queries: DataFrame,
    mean_length: float,
    k: int = K,
    group_shards: int = GROUP_SHARDS,
    packet_queries: int = PACKET_QUERIES,
) -> DataFrame:
    """Per query (query, term, idf) its k best documents: query_id, rank, doc_id, score (millionths).

    Each query goes once to every group of shards, in a packet with others. A group takes as much as
    ``group_shards`` of the largest shards, and a shard more at most.
    """
    conf = index.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    placed = _placed(index, group_shards)
    groups = max(1, (placed.agg(F.max("group")).first()[0] or 0) + 1)
    asked = _packets(queries, packet_queries).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # Of each group its documents come first, then its postings, then the queries.
    rows = index.join(placed, "shard").withColumn("kind", F.when(F.col("terms").isNull(), 0).otherwise(1))
    rows = rows.unionByName(asked.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    dealt = rows.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind", "shard")
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query"].dataType),
            T.StructField("doc_id", index.schema["doc_ids"].dataType.elementType),
            T.StructField("score", T.LongType()),
        ]
    )
    found = map_batches(dealt, _search(to_arrow_schema(schema), k, mean_length), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "score")
