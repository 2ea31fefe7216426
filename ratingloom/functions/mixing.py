"""Keyed integer mixing, used wherever the engine needs reproducible randomness.

Every function depends only on the row's own key and the seed, so results do not
change with the number of partitions, and a recomputed task yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers and moduli of the integer mix (all prime).
KEY_MULTIPLIER = 7919
INDEX_MULTIPLIER = 104729
SALT_MULTIPLIER = 1299709
MIX_MODULUS = 10007
BLOCK_MODULUS = 2147483647

# New factors are uniform in [0, INITIAL_SPAN); SINGLE_SPAN is the same as a single.
INITIAL_SPAN = 0.1
SINGLE_SPAN = 0.10000000149011612
# Multiplier of the minimal standard generator, whose modulus is BLOCK_MODULUS (fixed value).
MINIMAL_STANDARD = 16807


def shuffle_key(key: Column, seed: int, method: str = "mix") -> Column:
    """Sort key of a seeded permutation; ties are broken by the key itself."""
    if method == "mix":
        return (key.cast("long") * KEY_MULTIPLIER + F.lit(seed)) % MIX_MODULUS
    if method == "hash":
        return F.xxhash64(key.cast("long"), F.lit(seed))
    raise ValueError(f"unknown shuffle method {method!r}; use 'mix' or 'hash'")


def shuffle_prefix(sort_key: Column, method: str = "mix") -> Column:
    """Coarse, order-preserving prefix of ``shuffle_key``: at most 16,384 values."""
    return sort_key if method == "mix" else F.shiftright(sort_key, 50)


def initial_value(key: Column, index: Column, salt: Column, method: str = "mix") -> Column:
    """Initial factor element for row ``key`` and feature ``index``."""
    if method == "mix":
        mixed = (key.cast("long") * KEY_MULTIPLIER + index * INDEX_MULTIPLIER
                 + salt * SALT_MULTIPLIER) % MIX_MODULUS
        return mixed / F.lit(MIX_MODULUS / INITIAL_SPAN)
    if method == "hash":
        bits = F.shiftrightunsigned(F.xxhash64(key.cast("long"), index, salt), 11)
        return bits.cast("double") * F.lit(INITIAL_SPAN / 2.0**53)
    raise ValueError(f"unknown init method {method!r}; use 'mix' or 'hash'")


def parity_values(key: Column, width: int) -> Column:
    """Initial factors of row ``key``: the draws ``key * width + 1`` on of the minimal standard generator.

    Draw n is ``multiplier ** n`` modulo the prime, so a row jumps to its first draw by the binary digits of n
    and the others follow by fixed powers; no row waits for another one. Draws become singles in [0, 0.1).
    """
    squares = [pow(MINIMAL_STANDARD, 1 << bit, BLOCK_MODULUS) for bit in range(62)]
    first = key.cast("long") * width
    jumps = F.zip_with(F.array(*map(F.lit, squares)), F.sequence(F.lit(0), F.lit(61)),
                       lambda power, bit: F.when(F.pmod(_halved(first, bit), F.lit(2)) == 1, power.cast("long"))
                       .otherwise(F.lit(1).cast("long")))
    start = F.aggregate(jumps, F.lit(1).cast("long"), lambda x, power: x * power % BLOCK_MODULUS)
    follow = F.array(*(F.lit(pow(MINIMAL_STANDARD, k + 1, BLOCK_MODULUS)).cast("long") for k in range(width)))

    def uniform(power: Column) -> Column:
        # Scaled as a single: a cast to a single and on to a double would be taken for one cast.
        draw = (start * power % BLOCK_MODULUS - 1).cast("float") * F.lit(2.0 ** -31).cast("float")
        below_one = F.least(draw.cast("double"), F.lit(1 - 2.0 ** -24))
        return (below_one * F.lit(SINGLE_SPAN)).cast("float")

    return F.transform(follow, uniform)


def _halved(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def block_of(key: Column, copy: Column, blocks: int) -> Column:
    """Block of a factor row; copies of one split row land in different blocks."""
    mixed = key.cast("long") * SALT_MULTIPLIER + copy.cast("long") * INDEX_MULTIPLIER
    return (mixed % BLOCK_MODULUS % blocks).cast("int")
