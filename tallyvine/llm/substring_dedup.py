"""Passages that were met before, found by content-defined chunks.

A gear hash rolls over the bytes of a text and ends a chunk where its upper bits are zero, so
that equal passages are cut alike wherever they stand. A stretch is a row of neighbouring chunks
that comes to ``least`` characters and would not without its first or its last chunk; it is named by
the digest of its text. From each chunk one stretch begins and at each one ends (if the text goes so
far), so that the stretches inside any longer passage cover it. A stretch is a repeat if a document
of a smaller id, or an earlier place of the same document, has it as a whole. Repeats that touch are
joined to the spans to remove: every character of a span is part of at least ``least`` characters
that stand together in one place before. Shorter repeats are left, as sentences and phrases recur
by nature. The first occurrence of a passage always stays.

Null and empty texts have no chunks. Rows of one id count as one document: a text that is
repeated under the same id, or without an id, is no repeat; of several texts of one id each loses
its own spans only. Documents of equal texts and
different ids are: all but the first lose their spans, up to the whole text. Positions count
code points; ends are exclusive. Columns other than the two named are not read by ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyvine.llm import bloom
from tallyvine.llm.common import map_batches, slices, utf8
from tallyvine.sources.scratch import store

#: Bytes of context that decide on a cut, and the bits that must be zero (one place in 16).
_REACH = 16
_MASK = np.uint32(0xF0000000)
#: Bytes of the shortest and the longest chunk.
SHORTEST, LONGEST = 12, 256
#: Characters of the shortest run that counts as a passage.
LEAST = 120
_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of the bytes, the last one at their end."""
    if not len(data):
        return np.zeros(0, np.int64)
    rolled, reach = _GEAR[data], 1
    # A shift by one per byte, doubled: afterwards each place holds the hash of its last bytes.
    while reach < _REACH:
        earlier = rolled[:-reach] << np.uint32(reach)
        rolled = rolled.copy()
        rolled[reach:] += earlier
        reach *= 2
    starts_character = np.append((data[1:] & 0xC0) != 0x80, True)
    fit = ((rolled & _MASK) == 0) & starts_character
    ends, last = [], 0
    for end in (np.flatnonzero(fit) + 1).tolist():
        if end - last < SHORTEST:
            continue
        while end - last > LONGEST:
            last = _forced(starts_character, last)
            ends.append(last)
        if end - last >= SHORTEST:
            ends.append(end)
            last = end
    while len(data) - last > LONGEST:
        last = _forced(starts_character, last)
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return np.array(ends, np.int64)


def _forced(starts_character: np.ndarray, last: int) -> int:
    """The last end of a character within the longest chunk."""
    end = last + LONGEST
    while not starts_character[end - 1]:
        end -= 1
    return end


def stretches(place: np.ndarray, least: int) -> np.ndarray:
    """First chunk and end of the stretches, of chunks whose bounds are ``place``, in characters."""
    chunks = np.arange(len(place) - 1)
    ends = np.searchsorted(place, place[:-1] + least)
    starts = np.searchsorted(place, place[1:] - least, "right") - 1
    pairs = np.concatenate([np.stack([chunks, ends], 1)[ends < len(place)], np.stack([starts, chunks + 1], 1)[starts >= 0]])
    return np.unique(pairs, axis=0)


def _stretch(schema: pa.Schema, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest_of = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            rows, digests, starts, ends, again = [], [], [], [], []
            for row, text in enumerate(utf8(batch.column(1))):
                data = np.frombuffer(text, np.uint8)
                bounds = np.append(0, cuts(data))
                place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                pairs = stretches(place, least)
                if not len(pairs):
                    continue
                names = np.array([digest_of(text[a:b]) for a, b in bounds[pairs].tolist()], np.uint64)
                first = np.zeros(len(names), bool)
                first[np.unique(names, return_index=True)[1]] = True
                rows.append(np.full(len(names), row))
                digests.append(names.view(np.int64))
                starts.append(place[pairs[:, 0]])
                ends.append(place[pairs[:, 1]])
                again.append(~first)
            if not rows:
                continue
            columns = [batch.column(at).take(pa.array(np.concatenate(rows))) for at in (0, 2)]
            columns += [pa.array(np.concatenate(x)) for x in (digests, starts, ends, again)]
            columns[3:5] = [x.cast(pa.int32()) for x in columns[3:5]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _name(text_column: str):
    """Tells texts of one id apart."""
    return F.xxhash64(text_column)


def passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """Stretches: doc_id, name (hash of the text), digest, start, end and again (met before in the same text)."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), _name(text_column).alias("name"))
    slim = slim.where("text <> ''")
    schema = T.StructType(
        [
            slim.schema["doc_id"],
            T.StructField("name", T.LongType()),
            T.StructField("digest", T.LongType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("again", T.BooleanType()),
        ]
    )
    return map_batches(slim, _stretch(to_arrow_schema(schema), least), schema)


def _spans(docs: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    """Spans to remove: doc_id, name, start, end and first_doc."""
    # Texts are cut and digested once; both passes read the stored stretches.
    cut = store(passages(docs, id_column, text_column, least))
    known = cut.where("doc_id is not null and not again").groupBy("digest")
    known = known.agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    known = store(known.where("first_doc < last_doc").select("digest", "first_doc"))
    # Only stretches that may be known elsewhere are shuffled; those met again in their text are known.
    elsewhere = bloom.reduced(cut, "digest", known, "digest").join(known, "digest").where("doc_id > first_doc and not again")
    within = cut.where("again").select("*", F.col("doc_id").alias("first_doc"))
    columns = ["doc_id", "name", "start", "end", "first_doc"]
    met = elsewhere.select(*columns).unionByName(within.select(*columns)).where("doc_id is not null")
    document = Window.partitionBy("doc_id", "name").orderBy("start", "end")
    begins = F.coalesce(F.col("start") > F.max("end").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = met.select("*", begins.cast("int").alias("begins"))
    numbered = numbered.select("*", F.sum("begins").over(document.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    first = F.min(F.struct("start", "end", "first_doc"))["first_doc"].alias("first_doc")
    runs = numbered.groupBy("doc_id", "name", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), first)
    return runs.select(*columns)


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """One row per span to remove: id, start, end and first_doc (the first document that has its first stretch)."""
    found = _spans(docs, id_column, text_column, least)
    return found.select(F.col("doc_id").alias(id_column), "start", "end", "first_doc")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in sorted(spans):
        parts.append(text[at:start])
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _remove(text_at: int, length_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(text_at).to_pylist()
            pairs = zip(texts, spans, strict=True)
            texts = [without_spans(x, [(s["start"], s["end"]) for s in found]) if found and x else x for x, found in pairs]
            columns = list(batch.columns)[:-1]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if length_at >= 0:
                old = columns[length_at].to_pylist()
                new = [len(x or "") if found else n for x, found, n in zip(texts, spans, old, strict=True)]
                columns[length_at] = pa.array(new, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars", least: int = LEAST
) -> DataFrame:
    """All rows and columns of ``docs``; spans are cut out, and documents left without a word go.

    Documents that had no word before stay as they are.
    """
    found = store(_spans(docs, id_column, text_column, least))
    spans = found.groupBy(F.col("doc_id").alias("__id"), F.col("name").alias("__name"))
    spans = spans.agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    # Only documents with spans are shuffled; ids that may have some are told by a filter of bounded size.
    keys = store(found.select(F.col("doc_id").alias("__key")).distinct())
    blocks = bloom.block_count(keys.count())
    probed = bloom.probe(docs, id_column, bloom.build(keys, "__key", blocks), blocks)
    # A span belongs to one text of its id.
    same_text = (F.col(id_column) == F.col("__id")) & (_name(text_column) == F.col("__name"))
    maybe = probed.where("__possible").drop("__possible").join(spans, same_text, "left").select(*docs.columns, "__spans")
    text_at = docs.columns.index(text_column)
    length_at = docs.columns.index(length_column) if length_column in docs.columns else -1
    changed = map_batches(maybe.where("__spans is not null"), _remove(text_at, length_at), docs.schema)
    changed = changed.where(F.col(text_column).rlike(r"[^ \t-\r]"))
    same = maybe.where("__spans is null").select(*docs.columns)
    return probed.where(~F.col("__possible")).drop("__possible").unionByName(same).unionByName(changed)
