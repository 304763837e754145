"""A blocked Bloom filter as a small table: one 64-bit block per row, looked up by a broadcast join.

The number of blocks, and with it what is broadcast, is bounded whatever the number of keys. A
key that was put in is always found; others are found by chance, so an exact join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of two numbers at most, a few MB.
MOST_BLOCKS = 1 << 18
_BITS_PER_KEY = 12
_HASHES = 4


def block_count(keys: int, most: int = MOST_BLOCKS) -> int:
    """Blocks for so many keys: a power of two, bounded."""
    wanted = max(1, keys * _BITS_PER_KEY // 64)
    return min(most, 1 << (wanted - 1).bit_length())


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, Column]:
    block = F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))
    spread = F.xxhash64(F.lit(1), key)
    bits = F.lit(0).cast("long")
    for k in range(_HASHES):
        at = F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return block, bits


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row (__block, __held) per block that holds a key."""
    block, bits = _block_and_bits(F.col(key), blocks)
    return keys.groupBy(block.alias("__block")).agg(F.bit_or(bits).alias("__held"))


def probe(frame: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``frame`` with ``__possible``: whether the key may be among those put in; null keys are not."""
    names = frame.columns
    block, bits = _block_and_bits(F.col(key), blocks)
    placed = frame.select("*", block.alias("__block"), bits.alias("__bits"))
    # At most ``blocks`` rows of two numbers.
    met = placed.join(F.broadcast(bloom), "__block", "left")
    held = F.col("__held").bitwiseAND(F.col("__bits")) == F.col("__bits")
    return met.select(*names, F.coalesce(held & F.col(key).isNotNull(), F.lit(False)).alias("__possible"))


def reduced(frame: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    """The rows of ``frame`` whose key may be in the column ``other`` of the stored ``keys``."""
    blocks = block_count(keys.count())
    return probe(frame, key, build(keys, other, blocks), blocks).where("__possible").drop("__possible")


def without(frame: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    """The rows of ``frame`` whose key is not in the column ``other`` of the stored ``keys``; only possible hits are shuffled."""
    blocks = block_count(keys.count())
    probed = probe(frame, key, build(keys, other, blocks), blocks)
    possible = probed.where("__possible").join(keys.select(F.col(other).alias(key)), key, "left_anti")
    return probed.where("not __possible").unionByName(possible).drop("__possible")
