"""A bitmap of fixed size that tells which keys can not be in a table.

It is a prefilter only: keys that pass are joined exactly afterwards. Its size is a
parameter, so it may be broadcast; with very many keys it fills up and merely saves less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 2**26 bits are 8 MB. One that stands in an expression has 2**23, 1 MB.
FILTER_BITS = 26
COLUMN_BITS = 23


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def key_bitmap(keys: DataFrame, key: str, bits: int = FILTER_BITS):
    """Broadcast bitmap (one byte holds 8 slots) of the top ``bits`` bits of each key."""
    slots = keys.select(_slot(F.col(key), bits).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.int64)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(filled)


def bitmap_column(keys: DataFrame, key: str, bits: int = COLUMN_BITS) -> Column:
    """The bitmap as an array of longs, a scalar subquery, for use in ``bit_of``."""
    slots = keys.select(_slot(F.col(key), bits).alias("s"))
    filled = slots.groupBy(F.shiftright("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    dense = keys.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word")).join(filled, "word", "left")
    words = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return dense.agg(F.transform(words, lambda x: x["bits"]).alias("bitmap")).scalar()


def bit_of(bitmap: Column, key: Column, bits: int = COLUMN_BITS) -> Column:
    """Whether a key may be in the table of ``bitmap_column``."""
    slot = _slot(key, bits)
    word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    return word.bitwiseAND(F.call_function(
        "shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))) != 0


def may_contain(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit key may be in the table of the bitmap."""
    bits = (len(filled) * 64).bit_length() - 1
    slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (filled[slots >> 6] >> (slots & 63)) & 1 == 1
