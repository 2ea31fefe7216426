"""Record-parallel and user-parallel descent: independent parts, then averaged rows.

Each part runs one-by-one descent on its own copies of the factor rows it touches. The
copies of a row are then averaged, weighted by the number of records each one saw. Parts
are cut by position, so their size is bounded whatever the distribution of ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.arrays import array_type
from ratingloom.functions.half import rounded_features
from ratingloom.operators.skew import hot_keys, salted_join
from ratingloom.plans import exchange
from ratingloom.plans.parts import PartedRatings
from ratingloom.plans.strata import average_copies
from ratingloom.session import StagedTable, stage

MAX_RECORDS_PER_PART = 1_000_000
# Every record may bring two factor rows of its own into the part.
MAX_PART_BYTES = 512 << 20


def part_records(width: int) -> int:
    """Records per part such that its factor rows fit in a task, whatever ids it holds."""
    return max(1, min(MAX_RECORDS_PER_PART, MAX_PART_BYTES // (2 * 8 * width)))


def parts_by_record(ratings: DataFrame, records_per_part: int) -> DataFrame:
    """Consecutive records of the shuffled order share a part."""
    return ratings.withColumn("part", F.floor(F.col("pos") / records_per_part))


def parts_by_user(deduped: DataFrame, offsets: DataFrame, records_per_part: int,
                  split_users: bool = True) -> DataFrame:
    """Users in shuffled order share a part; a user's records stay together, in item order.

    With ``split_users`` a user with more records than a part holds is spread over several parts
    and its copies are averaged like those of an item. Without it every user has one writer, and
    a part may be as large as its largest user.
    """
    hot = hot_keys(deduped, "user_id", min_rows=records_per_part) if split_users else None
    users = offsets.select("user_id", F.col("pos").alias("_user_pos"), "base", "cnt")
    placed = salted_join(deduped.select("user_id", "item_id", "rating"), users, "user_id", hot, F.col("item_id"))
    pieces = F.ceil(F.col("cnt") / records_per_part) if split_users else F.lit(1)
    piece = F.when(pieces > 1, F.pmod(F.xxhash64("item_id"), pieces)).otherwise(F.lit(0))
    return placed.select(
        "user_id", "item_id", "rating",
        (F.col("_user_pos") * F.lit(1 << 31) + F.col("item_id")).alias("pos"),
        (F.floor(F.col("base") / records_per_part) + piece).alias("part"))


def local_epoch(ratings: PartedRatings, state: DataFrame, width: int, learning_rate: float, regularization: float,
                precision: str = "double", root: str | None = None) -> StagedTable:
    """One pass of every part over its own records, then the weighted mean of the copies."""
    update = exchange.BlockUpdate("sgd", width, float(learning_rate), float(regularization), precision)
    return local_pass(ratings, state, update, precision, lambda mean: rounded_features(mean, precision), root)


def local_pass(ratings: PartedRatings, state: DataFrame, update: exchange.BlockUpdate, precision: str,
               rounding: Callable[[Column], Column], root: str | None = None) -> StagedTable:
    """Apply ``update`` to all parts; ``rounding`` brings the mean of the copies to storage precision."""
    def step(key, factor_rows, records):
        return update(factor_rows, records).drop_columns("part")

    trained = ratings.meet(state).applyInArrow(
        step, f"side int, key long, n long, features {array_type(precision)}")
    named = trained.select("side", F.col("key").cast("int").alias("id"), "n", "features")
    averaged = average_copies(named, ["side", "id"], ["features"], update.lists["features"], rounding)
    moved = averaged.withColumnRenamed("features", "_moved")
    joined = state.join(moved, ["side", "id"], "left")
    return stage(joined.select("side", "id", F.coalesce("_moved", "features").alias("features")), "factors", root=root)
