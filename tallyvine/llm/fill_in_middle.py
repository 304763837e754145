"""Fill-in-the-middle forms of documents, put together and taken apart as streams of pieces.

A text is cut at two places, drawn from a hash of its id, into prefix, middle and suffix. Its output
is ``<P>``prefix``<S>``suffix``<M>``middle (psm), ``<S>``suffix``<P>``prefix``<M>``middle (spm),
or the text itself (plain). No output is held whole: each part is emitted in pieces of at most
``unit`` code points, keyed by document and place in the output. One shuffle partitions the pieces by
document, a secondary sort by place brings each document's output as a stream, which goes through
an incremental digest. The same stream is read for its marks, which tell the parts apart; every
piece gets the place that it has in the text, and a second sort within the same partitions (no
shuffle) brings the text back as a stream, which is digested again.

A document is named by its id, a hash of its text and the partition that it was read in, so a hot id
does not gather in one task. Rows that repeat id and text within a partition are put together once;
each gets its own result row. Null texts are empty. A null id counts as an empty one in the draw.
A text of any length works, in pieces. Columns other than the two named are not read, and may have
any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyvine.llm.common import map_batches, slices

# The marks of the parts, and hundredths of documents.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED_BELOW, SPM_BELOW = 90, 20
#: Code points per piece.
UNIT = 32_768
#: Places of the parts in the text, by mark.
_RANK = {PREFIX.encode(): 0, MIDDLE.encode(): 1, SUFFIX.encode(): 2}
_MARK_BYTES = 3
#: Pieces per rank in the order of a restored text.
_SPAN = 1 << 40
#: Bytes of pieces that make a batch.
_BATCH_BYTES = 4 << 20

_KEY = ["doc_id", "name", "part"]
_FACTS = ["n", "form", "prefix_chars", "middle_chars"]


def draw(doc_id, text: str) -> tuple[str, int, int]:
    """Form, end of the prefix and end of the middle of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    first, second, change, order = (int(digest[at : at + 8], 16) for at in range(0, 32, 8))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or change % 100 >= CHANGED_BELOW:
        return "plain", 0, 0
    start, end = sorted((first % (len(text) + 1), second % (len(text) + 1)))
    return "spm" if order % 100 < SPM_BELOW else "psm", start, end


def parts_of(text: str, form: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(mark, from, to) of the parts of the output, in its order."""
    if form == "plain":
        return [("", 0, len(text))]
    prefix, suffix, middle = (PREFIX, 0, start), (SUFFIX, end, len(text)), (MIDDLE, start, end)
    return [prefix, suffix, middle] if form == "psm" else [suffix, prefix, middle]


def _schema(id_type: T.DataType, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    fields = [("doc_id", id_type), ("name", T.BinaryType()), ("part", T.IntegerType()), ("place", T.LongType())]
    fields += [("piece", T.BinaryType()), ("n", T.LongType()), ("form", T.StringType())]
    fields += [("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), *extra]
    return T.StructType([T.StructField(*field) for field in fields])


class _Rows:
    """Rows that become Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size + 64

    def full(self) -> bool:
        return self.size >= _BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True)
        arrays = [pa.array(column, field.type) for column, field in zip(columns, self.schema, strict=True)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _emit(schema: pa.Schema, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(schema)
        for batch in slices(batches):
            columns = [batch.column(name).to_pylist() for name in ("doc_id", "text", "part")]
            met = Counter((doc_id, text or "", part) for doc_id, text, part in zip(*columns, strict=True))
            for (doc_id, text, part), copies in met.items():
                name = hashlib.blake2b(text.encode(), digest_size=16).digest()
                form, start, end = draw(doc_id, text)
                facts = len(text), form, *((start, end - start) if form != "plain" else (None, None))
                place = 0
                for mark, low, high in parts_of(text, form, start, end):
                    for at in range(low, max(high, low + 1), unit):
                        piece = text[at : min(at + unit, high)].encode()
                        if at == low:
                            piece = mark.encode() + piece
                        # Facts of the document stand in its first piece only.
                        told = (*facts, copies) if place == 0 else (None,) * 5
                        rows.add((doc_id, name, part, place, piece, *told), len(piece))
                        place += 1
                        if rows.full():
                            yield rows.take()
        if rows.rows:
            yield rows.take()

    return run


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: int = UNIT) -> DataFrame:
    """The outputs as pieces, sorted by place within each document and partitioned by document.

    doc_id, name and part name the document, ``place`` is the piece's place in the output. The first
    piece holds n, form, prefix_chars, middle_chars and the number of equal rows that it stands for.
    """
    slim = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(text_column).alias("text"),
        F.spark_partition_id().alias("part"),
    )
    schema = _schema(slim.schema["doc_id"].dataType, [("copies", T.LongType())])
    pieces = map_batches(slim, _emit(to_arrow_schema(schema), unit), schema)
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "place")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def _take_apart(schema: pa.Schema):
    """Digest each output and give its pieces their places in the text.

    Of copies, pieces of the same place follow each other; one of them is taken. A document ends
    with a row that holds its facts, the digest and the number of copies, after all of its pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(schema)
        key = facts = last = digest = None
        copies = rank = 0

        def end():
            rows.add((*key, 3 * _SPAN, None, *facts, digest.hexdigest(), copies), 0)

        for *now, place, piece, n, form, prefix_chars, middle_chars, equal in _rows_of(batches):
            if now != key:
                if key is not None:
                    end()
                key, last, copies, rank = now, None, 0, 0
                digest = hashlib.sha256()
                facts = n, form, prefix_chars, middle_chars
            copies += equal or 0
            if place == last:
                continue
            last = place
            digest.update(piece)
            if facts[1] != "plain" and piece[:_MARK_BYTES] in _RANK:
                rank, piece = _RANK[piece[:_MARK_BYTES]], piece[_MARK_BYTES:]
            rows.add((*key, rank * _SPAN + place, piece, None, None, None, None, None, None), len(piece))
            if rows.full():
                yield rows.take()
        if key is not None:
            end()
        if rows.rows:
            yield rows.take()

    return run


def _put_back(schema: pa.Schema):
    """Digest each restored text; one row per copy of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest = _Rows(schema), hashlib.sha256()
        for doc_id, _, _, place, piece, *facts, output, copies in _rows_of(batches):
            if place < 3 * _SPAN:
                digest.update(piece)
                continue
            for _ in range(copies):
                rows.add((doc_id, *facts, output, digest.hexdigest()), 256)
                if rows.full():
                    yield rows.take()
            digest = hashlib.sha256()
        if rows.rows:
            yield rows.take()

    return run


def digests(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document of ``fill_in_middle``: its facts, output_sha256 and restored_sha256.

    The restored text comes from the pieces of the output and the form alone.
    """
    id_type = pieces.schema["doc_id"].dataType
    schema = _schema(id_type, [("output_sha256", T.StringType()), ("copies", T.LongType())])
    apart = map_batches(pieces, _take_apart(to_arrow_schema(schema)), schema)
    # The partitions still hold whole documents, so a sort within them is enough.
    ordered = apart.sortWithinPartitions(*_KEY, "place")
    names = [T.StructField(name, T.StringType()) for name in ("output_sha256", "restored_sha256")]
    facts = [schema[name] for name in _FACTS]
    result = T.StructType([schema["doc_id"], *facts, *names])
    return map_batches(ordered, _put_back(to_arrow_schema(result)), result).withColumnRenamed("doc_id", id_column)


def _join_pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(schema)
        key, facts, parts, last, copies = None, None, [], None, 0

        def end():
            output = b"".join(parts).decode()
            for _ in range(copies):
                rows.add((key[0], facts[1], output), len(output))

        for *now, place, piece, n, form, prefix_chars, middle_chars, equal in _rows_of(batches):
            if now != key:
                if key is not None:
                    end()
                    if rows.full():
                        yield rows.take()
                key, facts, parts, last, copies = now, (n, form, prefix_chars, middle_chars), [], None, 0
            copies += equal or 0
            if place != last:
                parts.append(piece)
                last = place
        if key is not None:
            end()
        if rows.rows:
            yield rows.take()

    return run


def outputs(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document of ``fill_in_middle``: id, form and the output as one text, where it fits in memory."""
    text = T.StructField("output", T.StringType())
    schema = T.StructType([pieces.schema["doc_id"], T.StructField("form", T.StringType()), text])
    return map_batches(pieces, _join_pieces(to_arrow_schema(schema)), schema).withColumnRenamed("doc_id", id_column)
