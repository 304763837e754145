"""Token ids of documents as compressed binary blocks, written and read in order of their ids.

The format: a folder of Parquet files, one row per block. A row holds its shard, the number of
ids before the block in its shard, the directory of its documents (ids and lengths) and the
payload, a self-contained block of ``range_coder``. Spark's writer commits the files, so a lost
executor leaves no half-written block, and any store that Spark reaches will do. Shards are
ranges of document ids; a block holds whole documents.

Null texts are empty documents of one id, the end id. Null document ids come first. Rows with
equal ids stay apart, in the order of a hash of their texts, so that a repeated id is dealt to
several shards. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyvine.llm.common import gathered, map_batches, slices, text_slices
from tallyvine.llm.range_coder import decode_block, encode_block
from tallyvine.llm.tokens import word_ids

END_ID = 2
#: A block is closed by the document that brings it to so many ids.
BLOCK_IDS = 1 << 20
VOCABULARY = 49_408


def _files_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )


def _write(path: str, end_id: int, vocabulary: int, block_ids: int, schema: pa.Schema):
    def block(shard: int, first: int, names: list[pa.Array], lengths: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        columns = [pa.array([x], schema.field(at).type) for at, x in enumerate((shard, first, len(ids)))]
        for name, values in (("doc_ids", pa.concat_arrays(names)), ("lengths", pa.array(np.concatenate(lengths)))):
            kind = schema.field(name).type
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type), type=kind))
        columns.append(pa.array([encode_block(ids, vocabulary)], schema.field("payload").type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), word_ids(path)
        first, names, lengths, parts, size = 0, [], [], [], 0
        for batch in gathered(text_slices(batches)):
            ids, cuts = encoder.ids_with_ends(batch.column(1), end_id)
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, int(np.searchsorted(cuts, cuts[at] + block_ids - size)))
                names.append(batch.column(0).slice(at, to - at))
                lengths.append(np.diff(cuts[at : to + 1]))
                parts.append(ids[cuts[at] : cuts[to]])
                size += len(parts[-1])
                at = to
                if size >= block_ids:
                    yield block(shard, first, names, lengths, parts)
                    first, names, lengths, parts, size = first + size, [], [], [], 0
        if parts:
            yield block(shard, first, names, lengths, parts)

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
    vocabulary: int = VOCABULARY,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of all documents, each followed by ``end_id``, by rising document id."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = _files_schema(slim.schema["doc_id"].dataType)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = slim.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    kernel = _write(tokenizer, end_id, vocabulary, block_ids, to_arrow_schema(schema))
    map_batches(dealt, kernel, schema).write.parquet(folder)


def _read(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = decode_block(batch.column("payload")[0].as_py())
            lengths = np.array(batch.column("lengths")[0].as_py(), np.int64)
            if lengths.sum() != len(ids):
                raise ValueError("directory of block does not match its ids")
            starts = np.cumsum(lengths) - lengths
            data, cuts = ids.tobytes(), zip(starts.tolist(), (starts + lengths).tolist(), strict=True)
            base = batch.column("base")[0].as_py() + batch.column("first")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_ids")[0].values,
                    pa.array(base + starts),
                    pa.array(lengths),
                    pa.array([data[4 * a : 4 * b] for a, b in cuts], pa.binary()),
                ],
                schema=schema,
            )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    ``ids`` are little-endian unsigned 32-bit integers. A damaged block fails the read.
    """
    found = spark.read.parquet(folder)
    totals = found.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # One row per shard, that is per written partition.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    schema = T.StructType(
        [
            T.StructField("doc_id", found.schema["doc_ids"].dataType.elementType),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    blocks = found.join(F.broadcast(bases), "shard").select("base", "first", "doc_ids", "lengths", "payload")
    return map_batches(blocks, _read(to_arrow_schema(schema)), schema)
