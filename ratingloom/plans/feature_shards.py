"""Batch descent on factor rows that are cut into slices of features.

A row of K features lies as slices ``(side, id, shard, features)`` of at most ``slice_width`` values. Every
exchange and every file carries slices only, and each of them once a side: a task has the ratings and slices of a
block of ids and reads the other side's slices through, see ``streamed``. It sums partial inner products by
record, then goes through them again with the error for the gradients of its slices, which are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.factors import ITEM, USER
from ratingloom.plans import streamed

SLICE_WIDTH = 32


def sliced(state: DataFrame, slice_width: int = SLICE_WIDTH) -> DataFrame:
    """``(side, id, features)`` as ``(side, id, shard, features)``."""
    shards = F.sequence(F.lit(0), F.floor((F.size("features") - 1) / slice_width).cast("int"))
    return state.select("side", "id", F.explode(shards).alias("shard"), "features").select(
        "side", "id", "shard", F.slice("features", F.col("shard") * slice_width + 1, slice_width).alias("features"))


def joined_slices(slices: DataFrame) -> DataFrame:
    """Back to ``(side, id, features)``, for callers that want whole rows."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("shard", "features"))), lambda s: s["features"])
    return slices.groupBy("side", "id").agg(F.flatten(parts).alias("features"))


def errors(ratings: DataFrame, slices: DataFrame) -> DataFrame:
    """``(rec_id, user_id, item_id, rating, prediction, residual)``: partial inner products summed by record, in its block's task."""
    found = {row.side: row for row in slices.groupBy("side").agg(
        F.count("*").alias("rows"), F.max(F.size("features")).alias("width")).collect()}
    sizes = streamed.Sizes(ratings.count(), {side: found[side].rows if side in found else 0 for side in (USER, ITEM)})
    return streamed.predictions(ratings, slices, sizes, max((row.width for row in found.values()), default=1))


def sharded_epoch(ratings: DataFrame, slices: DataFrame, slice_width: int, learning_rate: float, regularization: float,
                  precision: str = "double") -> DataFrame:
    """One batch step on slices, equal to ``batch_gd.gd_epoch`` on whole rows up to the order of additions."""
    store = streamed.StreamedRows.of(slices, slice_width)
    moved = streamed.epoch(ratings, store, ratings.count(), learning_rate, regularization, precision, gaps=True)
    return moved.select("side", "id", "shard", "features")
