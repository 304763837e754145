"""Packing of documents into sequences of equal length by best-fit decreasing.

A document's ids are its tokens and an end id. Documents longer than a window are first cut
into full windows; what remains (and every shorter document) is one piece. The pieces are dealt
to shards of a bounded expected size by a hash, sorted by falling length within a shard by
Spark (which spills), and placed one after the other in the tightest open window that holds
them. A segment tree over remaining capacities finds that window, so a task keeps only its
open windows. A shard of any size gives right results; a larger one only takes longer.

Null texts are empty documents: one piece of one id. Rows with equal or null ids are packed
each for itself. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvine.llm.common import gathered, map_batches, text_slices
from tallyvine.llm.tokens import REMEMBERED_BYTES, word_ids

WINDOW = 2048
END_ID = 1
#: Expected documents per shard. Each shard leaves a few windows part-filled.
SHARD_DOCUMENTS = 16_384
_LOCAL = 32


class OpenWindows:
    """Windows by remaining capacity; finds the tightest that holds a piece."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (capacity, window) with the least capacity of at least ``need``, taken out."""
        filled, node = self.filled, self.leaves + need
        while not filled[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not filled[2 * node])
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            filled[node] = 0
            while node > 1 and not (filled[node] or filled[node ^ 1]):
                node >>= 1
                filled[node] = 0
        return capacity, window


class BestFit:
    """Places pieces, which come by falling length, in windows numbered from 0."""

    def __init__(self, size: int):
        self.size, self.count, self.open = size, 0, OpenWindows(size)

    def place(self, length: int) -> tuple[int, int]:
        found = self.open.take(length)
        if found is None:
            found, self.count = (self.size, self.count), self.count + 1
        capacity, window = found
        if capacity > length:
            self.open.put(capacity - length, window)
        return window, self.size - capacity


def _cut(path: str, window: int, end_id: int, schema: pa.Schema, remembered_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path, remembered_bytes)
        for batch in gathered(text_slices(batches)):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            ids, cuts = encoder.ids_with_ends(batch.column(1), end_id)
            data, cuts = memoryview(ids.astype("<u4", copy=False)).cast("B"), cuts.tolist()
            for row, (first, last) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for at in range(first, last, window):
                    to = min(at + window, last)
                    rows.append(row)
                    starts.append(at - first)
                    lengths.append(to - at)
                    sums.append(zlib.crc32(data[4 * at : 4 * to]))
                    totals.append(last - first)
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(values, pa.int64()) for values in (starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _place(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fit = None, BestFit(window)
        for batch in batches:
            shards, lengths = batch.column("shard").to_pylist(), batch.column("length").to_pylist()
            windows = np.empty((2, len(shards)), np.int64)
            for row, (now, length) in enumerate(zip(shards, lengths, strict=True)):
                if now != shard:
                    shard, fit = now, BestFit(window)
                number, offset = fit.place(length)
                windows[:, row] = (now << _LOCAL) + number, offset
            kept = [name for name in batch.schema.names if name != "shard"]
            columns = [batch.column(name) for name in kept] + [pa.array(windows[0]), pa.array(windows[1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_documents: int = SHARD_DOCUMENTS,
    remembered_bytes: int = REMEMBERED_BYTES,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of the vocabulary file on every machine.
    """
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = slim.schema["doc_id"].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in names)])
    cut = _cut(tokenizer, window, end_id, _arrow(schema), remembered_bytes)
    shards = max(1, -(-docs.count() // shard_documents))
    pieces = map_batches(slim, cut, schema).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(shards))
    )
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32")
    placed = T.StructType(schema.fields + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")])
    return map_batches(dealt, _place(window), placed).withColumnRenamed("doc_id", id_column)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
