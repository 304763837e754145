"""Blocks of token ids, coded by an adaptive context-mixing range coder.

A block is cut into lanes, coded side by side: each lane has its own range coder, all lanes of a
block share one model, which starts anew with each block. For every id the model mixes three
predictions: the id that last followed the two ids before it (order 2), the one that last
followed the id before it (order 1), and all ids by their counts so far (order 0). The weights
of the mixture are learnt per pair of confidences of the first two.

Layout (little-endian): magic, number of ids, lanes, vocabulary size, CRC-32 of the ids; the
number of 32-bit words of each lane; the words, lane by lane.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TVR1"
MOST_LANES = 4096
LANE_STEPS = 128
VOCABULARY_LIMIT = 1 << 18
_HEADER = struct.Struct("<4sIIII")
_SCALE, _WEIGHT = 20, 10
_TOTAL = np.uint64(_SCALE + _WEIGHT)
_SLOTS = 1 << 18
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


class _Model:
    """Predictions for one id of every lane at a time; both directions update it alike.

    A prediction of order 2 or 1 and its confidence, 0 to 3, are one number: id * 4 + confidence.
    """

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary = vocabulary
        self.before = np.zeros(lanes, np.int64)
        self.slot = np.zeros(lanes, np.int64)
        self.second, self.first = np.zeros(_SLOTS, np.int32), np.zeros(vocabulary, np.int32)
        self.counts, self.uncounted = np.zeros(vocabulary, np.int64), []
        # Hits of order 2, of order 1 and of neither, by confidence of order 2 and order 1.
        self.outcomes = np.ones((16, 3), np.int64) * np.array([2, 1, 4])
        self.step = 0

    def spread(self) -> None:
        """Order-0 frequencies, each at least 1, of a sum of at most 2**20."""
        if self.uncounted:
            self.counts += np.bincount(np.concatenate(self.uncounted), minlength=self.vocabulary)
            self.uncounted = []
        total = max(1, int(self.counts.sum()))
        self.frequency = (1 + self.counts * ((1 << _SCALE) - self.vocabulary) // total).astype(np.int32)
        # Both of an id side by side, for one look: start * 2**32 + frequency.
        self.ranges = (np.cumsum(self.frequency, dtype=np.int64) - self.frequency << 32) + self.frequency
        self.symbols = None

    def symbol_at(self, place: np.ndarray) -> np.ndarray:
        if self.symbols is None:
            kind = np.uint16 if self.vocabulary <= 1 << 16 else np.int32
            symbols = np.repeat(np.arange(self.vocabulary, dtype=kind), self.frequency)
            self.symbols = np.pad(symbols, (0, (1 << _SCALE) - len(symbols)), constant_values=self.vocabulary - 1)
        return self.symbols.take(place, mode="clip").astype(np.int64)

    def predict(self) -> None:
        if not self.step & (self.step - 1):
            self.spread()
        self.seen2, self.seen1 = self.second.take(self.slot, mode="clip"), self.first.take(self.before, mode="clip")
        self.guess2, self.guess1 = self.seen2 >> 2, self.seen1 >> 2
        self.level2, self.level1 = self.seen2.astype(np.int8) & 3, self.seen1.astype(np.int8) & 3
        self.context = ((self.level2 << 2) + self.level1).astype(np.int64)
        seen = self.outcomes.sum(1)
        most = 1 << _WEIGHT
        weight2 = np.minimum(np.maximum(self.outcomes[:, 0] * most // seen, 1), most - 8)
        weight1 = np.minimum(np.maximum(self.outcomes[:, 1] * most // seen, 1), most - 4 - weight2)
        self.weight2, self.both = weight2.take(self.context, mode="clip"), (weight2 + weight1).take(self.context, mode="clip")

    def range_of(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids within a range of 2**30."""
        rest = (1 << _WEIGHT) - self.both
        ranges = self.ranges.take(ids, mode="clip")
        start = (self.both << _SCALE) + rest * (ranges >> 32)
        size = rest * (ranges & 0xFFFFFFFF)
        for hit, low, high in ((hit1, self.weight2, self.both), (hit2, None, self.weight2)):
            at = np.flatnonzero(hit)
            lows = low[at] if low is not None else np.zeros(len(at), np.int64)
            start[at], size[at] = lows << _SCALE, high[at] - lows << _SCALE
        return start.view(np.uint64), size.view(np.uint64)

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Learn the ids; hits are those of either order by itself."""
        outcome = 2 - (hit1 | hit2).view(np.int8) - hit2.view(np.int8)
        self.outcomes += np.bincount(3 * self.context + outcome, minlength=48).reshape(16, 3)
        fresh = ids.astype(np.int32) << 2
        for seen, level, hit, table, at in (
            (self.seen2, self.level2, hit2, self.second, self.slot),
            (self.seen1, self.level1, hit1, self.first, self.before),
        ):
            kept, sure = hit | (level > 0), hit & (level < 3)
            table[at] = np.where(kept, seen + (sure.view(np.int8) - (kept & ~hit).view(np.int8)), fresh)
        self.uncounted.append(ids)
        # Bits 7 to 24 of the sum, which 32 bits hold.
        mixed = self.before.astype(np.uint32) * np.uint32(0x9E3779B1) + ids.astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.slot = (mixed >> np.uint32(7) & np.uint32(_SLOTS - 1)).astype(np.int64)
        self.before = ids
        self.step += 1


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of the ids, all below ``vocabulary``."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not 0 < vocabulary <= VOCABULARY_LIMIT or (len(ids) and int(ids.max()) >= vocabulary):
        raise ValueError("ids must be below a vocabulary size of at most 2**18")
    lanes = min(MOST_LANES, max(1, len(ids) // LANE_STEPS))
    header = _HEADER.pack(MAGIC, len(ids), lanes, vocabulary, zlib.crc32(ids))
    steps = -(-len(ids) // lanes)
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(lanes, vocabulary)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words, used = np.zeros((steps + 1, lanes), "<u4"), np.ones((steps + 1, lanes), bool)
    for step in range(steps):
        now = columns[step].astype(np.int64)
        model.predict()
        hit2, hit1 = now == model.guess2, now == model.guess1
        start, size = model.range_of(now, hit2, hit1)
        unit = width >> _TOTAL
        low += start * unit
        width = size * unit
        short = width <= _LOW
        words[step], used[step] = low >> _HALF, short
        low, width = _shift(low, width, short)
        model.update(now, hit2, hit1)
    words[steps] = (low + _LOW) >> _HALF
    lengths = used.sum(0).astype("<u4")
    return header + lengths.tobytes() + words.T[used.T].tobytes()


def _shift(low, width, short):
    """Moves the upper word of the short lanes out; a width across its border is cut at it."""
    at = np.flatnonzero(short)
    lows, widths = low[at], width[at]
    tail = lows & _LOW
    across = (lows >> _HALF) != ((lows + widths - np.uint64(1)) >> _HALF)
    width[at] = np.where(across, np.uint64(1 << 32) - tail, widths) << _HALF
    low[at] = tail << _HALF
    return low, width


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ``ValueError`` if it is damaged."""
    if len(block) < _HEADER.size:
        raise ValueError("block too short")
    magic, count, lanes, vocabulary, checksum = _HEADER.unpack_from(block)
    if magic != MAGIC or not 0 < vocabulary <= VOCABULARY_LIMIT or not 0 < lanes <= MOST_LANES:
        raise ValueError("not a block of token ids")
    body = _HEADER.size + 4 * lanes
    if len(block) < body or (len(block) - body) % 4:
        raise ValueError("block cut short")
    lengths = np.frombuffer(block, "<u4", lanes, _HEADER.size).astype(np.int64)
    words = np.frombuffer(block, "<u4", -1, body).astype(np.uint64)
    if lengths.sum() != len(words) or (count and not lengths.all()):
        raise ValueError("block cut short")
    words = np.append(words, np.uint64(0))
    first = np.cumsum(lengths) - lengths
    last, at = first + lengths, first.copy()
    steps = -(-count // lanes)
    columns = np.zeros((steps, lanes), np.int32)
    model = _Model(lanes, vocabulary)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def following(lanes):
        """The next word of the lanes, which move on by one."""
        found = words[np.where(at[lanes] < last[lanes], at[lanes], len(words) - 1)]
        at[lanes] += 1
        return found

    every = np.arange(lanes)
    code = following(every) << _HALF
    code |= following(every)
    limit = np.uint64((1 << (_SCALE + _WEIGHT)) - 1)
    for step in range(steps):
        model.predict()
        unit = width >> _TOTAL
        place = np.minimum((code - low) // unit, limit).view(np.int64)
        top = place >> _SCALE
        in2, in1 = top < model.weight2, top < model.both
        # Below 2**30, so the quotient of doubles is exact when cut.
        inner = ((place - (model.both << _SCALE)) / ((1 << _WEIGHT) - model.both)).astype(np.int64)
        now = np.where(in2, model.guess2, np.where(in1, model.guess1, model.symbol_at(inner)))
        start, size = model.range_of(now, in2, in1)
        low += start * unit
        width = size * unit
        short = width <= _LOW
        low, width = _shift(low, width, short)
        moved = np.flatnonzero(short)
        code[moved] = (code[moved] << _HALF) | following(moved)
        columns[step] = now
        model.update(now, now == model.guess2, now == model.guess1)
    ids = columns.T.reshape(-1)[:count].astype("<u4")
    if zlib.crc32(ids) != checksum:
        raise ValueError("checksum of block does not match")
    return ids
