"""Scoring and gradients on a grid of user blocks by item blocks.

Joining both factor tables to the ratings moves a factor array for every rating. On a
grid of B x B cells each factor row travels at most B times instead, so for ratings that
outnumber the factor rows the grid moves far less. Sums over cells are exact, so hot ids
can be spread over blocks freely.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.arrays import COLUMNWISE_WIDTH, sum_arrays
from ratingloom.functions.mixing import block_of
from ratingloom.operators.factors import ITEM, USER, apply_step
from ratingloom.operators.skew import hot_keys
from ratingloom.plans import exchange, streamed
from ratingloom.plans.parts import PartedRatings
from ratingloom.session import task_slots

CELL_RECORDS = 1_000_000
MAX_CELL_BYTES = 256 << 20
MIN_SPLIT_RECORDS = 10_000
MIN_JOIN_BYTES = 64 << 20
# Wide rows that a grid would copy beyond this are streamed instead.
MAX_COPIED_BYTES = 64 << 20


def grid_size(num_records: int, num_rows: int, width: int, slots: int) -> int:
    """Blocks per side: cells of bounded size, and at least one for each task slot."""
    for_records = math.ceil(math.sqrt(num_records / CELL_RECORDS))
    for_rows = math.ceil(num_rows * width * 8 / MAX_CELL_BYTES)
    return max(1, for_records, for_rows, math.ceil(math.sqrt(slots)))


def parts_by_cell(ratings: DataFrame, blocks: int) -> DataFrame:
    """Add ``part``: the grid cell of each rating. Ids above 1/(2B) of the ratings use several blocks."""
    placed = ratings
    for key, block in (("user_id", "_ub"), ("item_id", "_ib")):
        # At most 2B ids can be above the limit.
        hot = F.broadcast(hot_keys(ratings, key, min_rows=MIN_SPLIT_RECORDS, max_keys=2 * blocks))
        copy = F.coalesce(F.pmod(F.xxhash64("rec_id", F.lit(key)), F.col("copies")), F.lit(0))
        placed = placed.join(hot, key, "left").withColumn(block, block_of(F.col(key), copy, blocks)).drop("copies")
    part = F.col("_ub").cast("long") * blocks + F.col("_ib")
    return placed.select("rec_id", "user_id", "item_id", "rating", part.alias("part"))


def grid_ratings(ratings: DataFrame, blocks: int, precision: str = "double", cache: bool = False) -> PartedRatings:
    return PartedRatings.of(parts_by_cell(ratings, blocks), precision, ordered=False, cache=cache)


def pays_off(num_records: int, num_rows: int, width: int, blocks: int) -> bool:
    """Whether a grid moves clearly less than joins: ``blocks`` arrays per factor row against one per rating.

    Below MIN_JOIN_BYTES of joined factors the layout of the grid costs more than it saves.
    """
    return num_records * width * 8 > MIN_JOIN_BYTES and num_records > 2 * blocks * num_rows


def wide_pass(ratings: DataFrame, state: DataFrame, width: int) -> PartedRatings | streamed.Sizes | None:
    """Ratings with both ids on a grid, for one pass over wide rows; the sizes where these should be streamed; None where joins move less."""
    if width <= COLUMNWISE_WIDTH:
        return None
    rows = dict.fromkeys((USER, ITEM), 0) | {row.side: row["count"] for row in state.groupBy("side").count().collect()}
    num_records, num_rows = ratings.count(), sum(rows.values())
    # Rows are so wide that the layout does not count: fewer rows than records travel, that decides.
    if num_records * width * 8 <= MIN_JOIN_BYTES or num_records <= num_rows:
        return None
    blocks = grid_size(num_records, num_rows, width, task_slots(ratings.sparkSession))
    if blocks * num_rows * width * 8 > MAX_COPIED_BYTES:
        return streamed.Sizes(num_records, rows)
    if num_records <= blocks * num_rows:
        return None
    return grid_ratings(ratings.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()), blocks)


def grid_predict(ratings: PartedRatings, state: DataFrame, width: int) -> DataFrame:
    """``(rec_id, user_id, item_id, rating, prediction, residual)`` of the records the model covers."""
    score = exchange.BlockScore(width)
    kind = ratings.records.schema["rating"].dataType.simpleString()

    def cell(key, factor_rows, records):
        return score.predictions(factor_rows, records)

    scored = ratings.meet(state).applyInArrow(
        cell, f"rec_id long, user_key long, item_key long, rating {kind}, prediction double")
    return scored.select("rec_id", F.col("user_key").cast("int").alias("user_id"),
                         F.col("item_key").cast("int").alias("item_id"), "rating", "prediction",
                         (F.col("prediction") - F.col("rating")).alias("residual"))


def grid_gradients(ratings: PartedRatings, state: DataFrame, width: int) -> DataFrame:
    """``(side, id, gradient, square, rated)``: sum of ``error * other side's features`` per touched row.

    ``square`` and ``rated``, over all rows, are the squared errors and their number.
    """
    score = exchange.BlockScore(width)

    def cell(key, factor_rows, records):
        return score.gradients(factor_rows, records)

    partial = ratings.meet(state).applyInArrow(cell, "side int, key long, gradient array<double>, square double, rated long")
    named = partial.select("side", F.col("key").cast("int").alias("id"), "gradient", "square", "rated")
    return sum_arrays(named, ["side", "id"], "gradient", width, [F.sum("square").alias("square"), F.sum("rated").alias("rated")])


def grid_epoch(ratings: PartedRatings, state: DataFrame, width: int, learning_rate: float, regularization: float,
               precision: str = "double", carry: tuple[str, ...] = ()) -> DataFrame:
    """Batch gradient descent step, as ``batch_gd.gd_epoch`` but moving factor rows per cell."""
    gradients = grid_gradients(ratings, state, width)
    return apply_step(state, gradients, learning_rate, regularization, precision, carry)


def grid_square_error(ratings: PartedRatings, state: DataFrame, width: int) -> DataFrame:
    """One row ``(square_error_sum, num_records, rmse)`` over the records the model covers."""
    score = exchange.BlockScore(width)

    def cell(key, factor_rows, records):
        return score.errors(factor_rows, records)

    partial = ratings.meet(state).applyInArrow(cell, "square_error_sum double, num_records long")
    total = partial.agg(F.sum("square_error_sum").alias("square_error_sum"),
                        F.coalesce(F.sum("num_records"), F.lit(0)).alias("num_records"))
    return total.withColumn("rmse", F.sqrt(F.try_divide("square_error_sum", "num_records")))
