"""Filters of keys in bounded memory: Bloom filters cut in blocks, built and asked by built-in functions only.

A key's hash names a block and ``BITS`` bits in it. A filter has a row for each block with a bit set, so its size has a
bound whatever the number of keys, and it can be broadcast. It never lacks a key; beyond about 3,000 keys a block it says
yes to more and more others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a filter at most. A block is a bitmap of 4 KB, so this is 16 MB, for some 13 million keys.
BLOCKS = 4096
BITS, BLOCK_BITS = 4, 32768


def _places(key: list[str], blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and its bits in it, from two hashes."""
    block = F.pmod(F.xxhash64(F.lit(0), *key), F.lit(blocks)).cast("int")
    h = F.xxhash64(F.lit(1), *key)
    return block, [F.shiftrightunsigned(h, 15 * n).bitwiseAND(BLOCK_BITS - 1) for n in range(BITS)]


def build(keys: DataFrame, key: list[str], blocks: int = BLOCKS) -> DataFrame:
    """(block, bits) of the keys; repeated ones cost nothing, as bits are joined before the exchange."""
    block, bits = _places(key, blocks)
    return keys.select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def mark(df: DataFrame, key: list[str], made: DataFrame, name: str, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``name``: whether a filter of as many ``blocks`` may hold the row's key, False for keys with a null.
    The filter is broadcast, so no row of ``df`` moves."""
    block, bits = _places(key, blocks)
    held = f"_bits_{name}"
    filtered = made.select(F.col("_block").alias(f"_block_{name}"), F.col("_bits").alias(held))
    byte = lambda at: F.conv(F.hex(F.substring(held, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = lambda at: F.call_function("shiftright", byte(at), at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    known = reduce(Column.__and__, (has(b) for b in bits), reduce(Column.__and__, (F.col(k).isNotNull() for k in key)))
    rows = df.withColumn(f"_block_{name}", block).join(F.broadcast(filtered), f"_block_{name}", "left")
    return rows.withColumn(name, F.coalesce(known, F.lit(False))).drop(f"_block_{name}", held)
