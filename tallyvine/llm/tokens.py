"""Token ids of whole texts by a public word-level BPE vocabulary.

The vocabulary drops white space and treats every word alone, so the ids of a text are
those of its words, one after the other. Texts come many at a time, and each of their distinct
words is looked up once. Words recur; those remembered are not encoded again.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids remembered per Python worker (results do not depend on it).
REMEMBERED_BYTES = 240 << 20
_TOGETHER = 400
_MARKS = ".,!#$%&*|"
#: a-z and the lower-case letters of Latin-1 (ß to ÿ, without the sign ÷).
_LETTERS = "^[a-zß-öø-ÿ]+$"
#: How byte-level BPE writes the bytes of such letters: 0x7F to 0xA0 go by characters from U+0121 on, others by themselves.
_BYTE_LETTERS = {byte: chr(0xA2 + byte) for byte in range(0x7F, 0xA1)} | {0xAD: chr(0x143)}
_SEPARATOR = "<|endoftext|>"
_SCHEMA = pa.schema({"word": pa.large_string(), "ids": pa.large_list(pa.uint32())})


def _parts(array: pa.Array) -> tuple[np.ndarray, pa.Array | pa.Buffer]:
    """Offsets of an array of strings or lists, which may be a slice, and the data they point to."""
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8 * array.offset)
    return offsets, array.values if pa.types.is_large_list(array.type) else array.buffers()[2]


def _strings(offsets: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), data or pa.py_buffer(b"")])


def _lists(lengths, ids) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.uint32()))


class WordMemory:
    """Distinct words and their ids within a bound of bytes, in two generations.

    A generation that is full becomes the old one, whose words are forgotten; a word found in
    the old one is young again. So what recurs stays, whatever passes by once.
    """

    #: Bytes of an entry besides those of its word and ids, and its share of the copies made as tables grow.
    ENTRY = 100

    def __init__(self, most_bytes: int):
        self.most, self.size = most_bytes // 2, 0
        self.young = self.old = _SCHEMA.empty_table()

    def rows(self, words: pa.Array) -> np.ndarray:
        """Of each word its row in the young and, counted on, the old generation; -1 if in neither."""
        found = np.full(len(words), -1)
        for table, before in ((self.old, len(self.young)), (self.young, 0)):
            if len(table):
                at = pc.index_in(table["word"], value_set=words).combine_chunks()
                met = at.is_valid().to_numpy(zero_copy_only=False)
                found[at.drop_null().to_numpy()] = before + np.flatnonzero(met)
        return found

    def put(self, fresh: pa.Table) -> None:
        """Remember words that are not in the young generation, as many as one generation holds."""
        if not len(fresh):
            return
        if self.size >= self.most:
            self.old, self.young, self.size = self.young, _SCHEMA.empty_table(), 0
        ids = pc.list_value_length(fresh["ids"]).to_numpy()
        sizes = np.cumsum(self.ENTRY + pc.binary_length(fresh["word"]).to_numpy() + 4 * ids)
        fit = int(np.searchsorted(sizes, self.most - self.size)) + 1
        self.young = pa.concat_tables([self.young, fresh.slice(0, fit)]).combine_chunks()
        self.size += int(sizes[min(fit, len(sizes)) - 1])


class WordIds:
    """Ids of words."""

    def __init__(self, path: str, remembered_bytes: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.memory = WordMemory(remembered_bytes)
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.merged = self.tokenizer.model.tokenize

    def _letters(self, words: list[str]) -> pa.Array:
        # Normalised already, and one piece: only the merges are left to do.
        merged = self.merged
        ids = [[token.id for token in merged(word)] for word in words]
        return _lists(list(map(len, ids)), [x for word in ids for x in word])

    def _latin(self, words: list[str]) -> pa.Array:
        spelt = "\n".join(words).encode().decode("latin-1").translate(_BYTE_LETTERS).split("\n")
        return self._letters(spelt[: len(words)])

    def _others(self, words: list[str]) -> pa.Array:
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), _TOGETHER):
            text = _SEPARATOR.join(words[at : at + _TOGETHER])
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(found == self.separator)
            lengths.append(np.diff(ends, prepend=-1, append=len(found)) - 1)
            ids.append(np.delete(found, ends))
        return _lists(np.concatenate(lengths), np.concatenate(ids))

    def _special(self, words: list[str]) -> pa.Array:
        ids = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in words]
        return _lists(list(map(len, ids)), [x for word in ids for x in word])

    def _learn(self, words: pa.Array) -> pa.Table:
        """The words, in another order, and their ids."""
        letters, special = pc.match_substring_regex(words, _LETTERS), pc.match_substring(words, "<|")
        plain = pc.string_is_ascii(words)
        kinds = {
            self._letters: pc.and_(letters, plain),
            self._latin: pc.and_not(letters, plain),
            self._special: special,
            self._others: pc.invert(pc.or_(letters, special)),
        }
        parts = [(part := words.filter(kind), encode(part.to_pylist())) for encode, kind in kinds.items()]
        return pa.concat_tables([pa.table(list(part), schema=_SCHEMA) for part in parts])

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words: those of their stems and of the marks that follow them."""
        offsets, data = _parts(words)
        stems = pc.binary_length(pc.ascii_rtrim(words, characters=_MARKS)).to_numpy()
        lengths = np.diff(offsets)
        text = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(1, np.uint8)
        ends = offsets[:-1] + stems
        last, before = text[np.maximum(ends - 1, 0)], text[np.maximum(ends - 2, 0)]
        letter = (last >= 0x61) & (last <= 0x7A) | (before == 0xC3) & (last >= 0x9F) & (last <= 0xBF) & (last != 0xB7) & (stems > 1)
        special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        cut = np.where(letter & (stems > 0) & ~special, stems, lengths)
        borders = np.empty(2 * len(words) + 1, np.int64)
        borders[::2], borders[1::2] = offsets, offsets[:-1] + cut
        pieces = _strings(borders, data).dictionary_encode()
        distinct = pieces.dictionary
        rows = self.memory.rows(distinct)
        unknown = rows < 0
        learnt = self._learn(distinct.filter(pa.array(unknown)))
        young, old = len(self.memory.young), len(self.memory.old)
        known = pa.concat_tables([self.memory.young, self.memory.old, learnt])
        if len(learnt):
            rows[pc.index_in(learnt["word"], value_set=distinct).to_numpy()] = young + old + np.arange(len(learnt))
        ids = known["ids"].combine_chunks().take(pa.array(rows)).take(pieces.indices)
        # A put may start a generation, so what is new is remembered when the words are done.
        again = rows[(rows >= young) & (rows < young + old)]
        self.memory.put(pa.concat_tables([known.slice(young, old).take(pa.array(again - young)), learnt]))
        offsets, data = _parts(ids)
        return pa.LargeListArray.from_arrays(pa.array(offsets[::2]), data)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the places where each text begins and the last one ends."""
        texts = texts.cast(pa.large_string()).fill_null("")
        # Letters are lower-cased by the vocabulary too; a text that may spell a special token is left as it is.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        firsts = split.offsets.to_numpy()
        words = split.values.slice(firsts[0], firsts[-1] - firsts[0]).dictionary_encode()
        offsets, ids = _parts(self._of_words(words.dictionary).take(words.indices))
        return ids.to_numpy()[offsets[0] : offsets[-1]], offsets[firsts - firsts[0]] - offsets[0]

    def ids_with_ends(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids``, with the end id after those of each text."""
        ids, cuts = self.ids(texts)
        return np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        ids, cuts = self.ids(pa.array(texts, pa.large_binary()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str, remembered_bytes: int = REMEMBERED_BYTES) -> WordIds:
    return WordIds(path, remembered_bytes)
