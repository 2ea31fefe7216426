"""A keyed bijection of an id range: shuffled positions without sorting anything.

Ids below ``size`` are pairs ``(left, right)`` of a grid of ``rows x columns`` cells, barely more than
``size``. A Feistel network adds a mix of one half to the other by turns, which any grid survives as a
permutation. An id that lands beyond ``size`` walks on until it is back; only fewer than ``rows`` cells lie
there, so the longest walk is found beforehand and the column expression has that many steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ratingloom.functions.mixing import BLOCK_MODULUS, INDEX_MULTIPLIER, KEY_MULTIPLIER, SALT_MULTIPLIER

ROUNDS = 4


@dataclass(frozen=True)
class Bijection:
    """The permutation of ``0 .. size - 1`` that belongs to ``seed``."""

    size: int
    seed: int

    @property
    def rows(self) -> int:
        root = math.isqrt(max(self.size, 1))
        return root + (root * root < self.size)

    @property
    def columns(self) -> int:
        return -(-max(self.size, 1) // self.rows)

    @property
    def keys(self) -> list[int]:
        """One key a round and half."""
        return [(self.seed * SALT_MULTIPLIER + n * INDEX_MULTIPLIER) % BLOCK_MODULUS for n in range(1, 2 * ROUNDS + 1)]

    @staticmethod
    def _mixed(half, key):
        """Below 2**31 for halves below 2**31; works on columns, arrays and numbers."""
        once = (half % BLOCK_MODULUS * KEY_MULTIPLIER + key) % BLOCK_MODULUS
        return (once * once + key) % BLOCK_MODULUS

    def _rounds(self, left, right, first, second):
        left = (left + self._mixed(right, first)) % self.rows
        return left, (right + self._mixed(left, second)) % self.columns

    def cells(self, ids: np.ndarray) -> np.ndarray:
        """One application to cell numbers, those beyond ``size`` included."""
        left, right = ids // self.columns, ids % self.columns
        for first, second in zip(self.keys[::2], self.keys[1::2]):
            left, right = self._rounds(left, right, first, second)
        return left * self.columns + right

    @property
    def walk(self) -> int:
        """Steps that the longest way through cells beyond ``size`` takes."""
        outside = np.arange(self.size, self.rows * self.columns, dtype=np.int64)
        # Ways begin at cells that no cell beyond leads to; cells on a circle beyond are never met.
        steps, outside = 0, np.setdiff1d(outside, self.cells(outside))
        while len(outside):
            outside = self.cells(outside)
            outside = outside[outside >= self.size]
            steps += 1
        return steps

    def positions(self, ids: np.ndarray) -> np.ndarray:
        found = self.cells(ids)
        while (found >= self.size).any():
            found = np.where(found < self.size, found, self.cells(found))
        return found

    def position(self, key: Column) -> Column:
        """The position of an id below ``size``; null and other ids give null."""
        pairs = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
                          for a, b in zip(self.keys[::2], self.keys[1::2])))
        columns = F.lit(self.columns).cast("long")

        def applied(cell: Column) -> Column:
            start = F.struct(((cell - cell % columns) / columns).cast("long").alias("left"), (cell % columns).alias("right"))

            def turn(state: Column, key: Column) -> Column:
                left, right = self._rounds(state["left"], state["right"], key["a"], key["b"])
                return F.struct(left.alias("left"), right.alias("right"))

            last = F.aggregate(pairs, start, turn)
            return last["left"] * columns + last["right"]

        cell = key.cast("long")
        found, walk = applied(cell), self.walk
        if walk:
            found = F.aggregate(F.array_repeat(F.lit(0), walk), found,
                                lambda at, _: F.when(at < self.size, at).otherwise(applied(at)))
        return F.when((cell >= 0) & (cell < self.size), found)
