"""Joins on user or item ids that stay balanced when one id holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.session import StagedTable, stage

# An id is hot when it holds more than 1/MAX_HOT_KEYS of all rows, so there can be
# at most MAX_HOT_KEYS of them: at 12 bytes a row, that makes the hot table safe to broadcast.
MAX_HOT_KEYS = 1_000_000
# Below this many rows a key never needs splitting, however small the table is.
MIN_HOT_ROWS = 250_000
# Slots of the hash by which ids are counted first: a task brings at most that many rows to the shuffle.
HOT_SLOTS = 1 << 16


def hot_keys(rows: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS,
             max_keys: int = MAX_HOT_KEYS) -> DataFrame:
    """``(key, copies)`` of the ids with too many rows for one task.

    The limit is the larger of ``min_rows`` and ``rows / max_keys``; ``copies`` is
    how many pieces of at most that size the id's rows need.
    """
    total = rows.agg(F.count("*")).scalar()
    limit = F.greatest(F.lit(min_rows).cast("long"), F.ceil(total / F.lit(max_keys)))
    # An id can not be hot in a slot of its hash with fewer rows: the others are not counted one by one.
    slot = F.pmod(F.xxhash64(key), F.lit(HOT_SLOTS)).alias("_slot")
    slots = rows.groupBy(slot).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_slot")
    likely = rows.select(key, slot).join(F.broadcast(slots), "_slot", "left_semi")
    counts = likely.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > limit)
    return hot.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("copies"))


def stage_hot_keys(rows: DataFrame, key: str, root: str | None = None, **limits) -> StagedTable | None:
    """The hot keys written once for many joins, or None when there are none to care for."""
    written = stage(hot_keys(rows, key, **limits), f"hot-{key}", root=root)
    if written.df.isEmpty():
        written.drop()
        return None
    return written


def salted_join(rows: DataFrame, factors: DataFrame, key: str, hot: DataFrame | None, salt: Column,
                how: str = "inner") -> DataFrame:
    """Join ``rows`` with the one matching factor row per ``key``.

    Rows of a hot key are spread over ``copies`` salted keys by ``salt`` (any well-spread
    integer column of ``rows``), and the key's single factor row is repeated that often.
    Other keys get salt 0 and are not repeated. ``hot`` is bounded by construction, see
    ``hot_keys``. Without hot keys (None) it is a plain join. Spark takes arrays for a value long, so its
    own choice would broadcast tables that are many times larger than it believes; both sides are
    shuffled at every size instead, and only the factor rows of a task are hashed: nothing is sorted.
    """
    if hot is None:
        return rows.join(factors.hint("shuffle_hash"), key, how)
    copies = F.broadcast(hot.select(key, F.col("copies").alias("_copies")))
    spread = (rows.join(copies, key, "left")
              .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_copies")), F.lit(0)).cast("int"))
              .drop("_copies"))
    repeated = (factors.join(copies, key, "left")
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1)))
                .drop("_copies"))
    return spread.join(repeated.hint("shuffle_hash"), [key, "_salt"], how).drop("_salt")
