"""Byte-level BPE without running its merges.

The ids of a piece of text are the one sequence of vocabulary tokens in which any two
neighbours are compatible, that is, in which merging the bytes of both would give just these
two. It is found from the left: take the longest token, go on, and fall back to shorter ones
where no compatible neighbour follows. Positions that led nowhere are marked, so each is left
once only. The tokens at all positions come from one Aho-Corasick pass over the piece (bytes
mapped to Latin-1), the verdict on a pair is remembered.

The ranks must be those of a trained vocabulary, in which a token is the merge of two tokens of
lower rank; tokens that no merges give are used only for a piece that equals them.

Pieces are the matches of a pattern, each encoded separately. Null texts are empty: no ids.
Every row of a repeated document is encoded. A text of any length is encoded whole, within one
task; its ids are one value, so they must fit in memory. Columns other than those asked for are
not read, and may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvine.llm.common import Memory, map_batches, slices, utf8

#: Bytes of units of text, of pieces and of pairs of tokens remembered per Python worker (results do not depend on it).
REMEMBERED_BYTES = 400 << 20
_LONGEST_UNIT = 64


class ByteBPE:
    def __init__(self, ranks_path: str, pattern: str, remembered_bytes: int = REMEMBERED_BYTES):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern)
        # A space between two white-space characters may belong to a longer match.
        self.runs = regex.compile(r"\s (?!\S)|^ (?!\S)")
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.packed = [int(rank).to_bytes(4, "little") for rank in range(len(self.tokens))]
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs = Memory(remembered_bytes // 4)
        self.units = Memory(remembered_bytes * 5 // 8)
        self.known = Memory(remembered_bytes // 8)
        self.prefixes: dict[int, int] = {}
        self.lengths = list(map(len, self.tokens))

    def _merge(self, data: bytes, limit: int) -> list[bytes]:
        """``data`` after all merges of a rank below ``limit``, for the bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            )
            if rank >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; twice itself for a byte; None if no merges give it."""
        if token not in self.parts:
            parts = [self.ranks[part] for part in self._merge(self.tokens[token], token)]
            self.parts[token] = {1: (token, token), 2: tuple(parts)}.get(len(parts))
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged together, stay these two tokens.

        No merge may cross the border before the tokens are complete. The merges at the border
        are undone from the latest to the earliest; at each stage the two tokens that meet
        there must not have had a merge that would have come first.
        """
        pair = left, right
        found = self.pairs.young.get(pair)
        if found is None:
            found = self.pairs.recall(pair, 0)
        if found is None:
            found = self._border_holds(left, right)
            self.pairs.put(pair, found, 0)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        # The merge that consumed the meeting tokens; on equal ranks the left one is made first.
        later = (len(tokens), 0)
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and (across, 0 if later[1] else 1) < (later[0], 1):
                return False
            inner_left, inner_right = self._halves(left)[1], self._halves(right)[0]
            left_is_byte, right_is_byte = inner_left == left, inner_right == right
            if left_is_byte and right_is_byte:
                return True
            if right_is_byte or (not left_is_byte and left > right):
                later, left = (left, 0), inner_left
            else:
                later, right = (right, 1), inner_right

    def _shorter(self, token: int) -> int:
        """The longest other token that this one starts with, or -1."""
        found = self.prefixes.get(token)
        if found is None:
            data = self.tokens[token]
            starts = (data[:n] for n in range(len(data) - 1, 0, -1))
            found = self.prefixes[token] = next((self.ranks[x] for x in starts if x in self.ranks), -1)
        return found

    def encode_piece(self, piece: str) -> bytes:
        ids = self.known.young.get(piece)
        if ids is None:
            ids = self.known.recall(piece, 2 * len(piece))
        if ids is None:
            ids = self._backtrack(piece.encode())
            if len(piece) <= _LONGEST_UNIT:
                self.known.put(piece, ids, len(piece) + len(ids))
        return ids

    def _backtrack(self, data: bytes) -> bytes:
        if data in self.ranks:
            return self.packed[self.ranks[data]]
        longest = [0] * len(data)
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length] = rank
        lengths, pairs, compatible = self.lengths, self.pairs.young, self.compatible
        dead, ids, at, token = bytearray(len(data) + 1), [], 0, longest[0]
        while at < len(data):
            end = at + lengths[token]
            if not dead[end] and self._halves(token):
                fits = not ids or pairs.get((ids[-1], token))
                if fits is None:
                    fits = compatible(ids[-1], token)
                if fits:
                    ids.append(token)
                    at = end
                    token = longest[at] if at < len(data) else 0
                    continue
            token = self._shorter(token)
            if token < 0:
                dead[at] = 1
                token = ids.pop()
                at -= lengths[token]
        return b"".join([self.packed[token] for token in ids])

    def _encode_unit(self, unit: str) -> bytes:
        ids = self.units.recall(unit, 2 * len(unit))
        if ids is None:
            ids = b"".join(map(self.encode_piece, self.pieces.findall(unit)))
            if len(unit) <= _LONGEST_UNIT:
                self.units.put(unit, ids, len(unit) + len(ids))
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Pieces start anew at any space that has a character other than white space on one side,
        so a text is encoded in such units, most of which recur.
        """
        if not text:
            return b""
        if self.runs.search(text):
            return b"".join(map(self.encode_piece, self.pieces.findall(text)))
        head, *rest = text.split(" ")
        units, parts = self.units.young, []
        for unit in [head, *[" " + word for word in rest]]:
            ids = units.get(unit)
            parts.append(self._encode_unit(unit) if ids is None else ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def byte_bpe(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def _mapped(ranks_path: str, pattern: str, encode: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(ranks_path, pattern)
        for batch in slices(batches):
            ids = utf8(batch.column(batch.num_columns - 1))
            if encode:
                ids = [coder.encode(text.decode()) for text in ids]
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            if decode:
                columns, names = [*columns, pa.array(map(coder.decode, ids), pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``ids``: binary, little-endian unsigned 32-bit integers."""
    slim = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    schema = T.StructType([slim.schema[id_column], T.StructField("ids", T.BinaryType())])
    return map_batches(slim, _mapped(ranks_path, pattern, True, False), schema)


def decode_bpe(encoded: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``encoded`` (id column and ``ids``) with ``decoded``: the bytes of the tokens."""
    slim = encoded.select(F.col(id_column), "ids")
    schema = T.StructType([*slim.schema.fields, T.StructField("decoded", T.BinaryType())])
    return map_batches(slim, _mapped(ranks_path, pattern, False, True), schema)


def encode_and_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id column, ``ids`` and ``decoded``, the bytes of these ids, in one pass over the texts."""
    slim = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    coded = [T.StructField(name, T.BinaryType()) for name in ("ids", "decoded")]
    schema = T.StructType([slim.schema[id_column], *coded])
    return map_batches(slim, _mapped(ranks_path, pattern, True, True), schema)
