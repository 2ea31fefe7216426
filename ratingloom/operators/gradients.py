"""Gradient sums per user and item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.arrays import dot, scaled, sum_arrays
from ratingloom.operators.factors import ITEM, USER, RatingSkew, attach_factors


def gradient_sums(ratings: DataFrame, state: DataFrame, width: int,
                  skew: RatingSkew | None = None) -> DataFrame:
    """``(side, id, gradient, n, square, rated)``: sum of ``error * other side's features`` per touched row.

    ``square`` and ``rated`` are the squared errors and their number, on the rows of users: over all rows they
    are the error of ``state`` on ``ratings``, without another pass.

    Each scored record yields its user and its item term together, so the joined data is
    read once and both sides share one map-side combined aggregation.
    """
    scored = (attach_factors(ratings, state, skew)
              .withColumn("_error", dot(F.col("p"), F.col("q"), width) - F.col("rating")))
    terms = scored.select(F.inline(F.array(
        F.struct(F.lit(USER).alias("side"), F.col("user_id").alias("id"),
                 scaled(F.col("_error"), F.col("q"), width).alias("gradient"),
                 (F.col("_error") * F.col("_error")).alias("square")),
        F.struct(F.lit(ITEM).alias("side"), F.col("item_id").alias("id"),
                 scaled(F.col("_error"), F.col("p"), width).alias("gradient"),
                 F.lit(None).cast("double").alias("square")))))
    return sum_arrays(terms, ["side", "id"], "gradient", width, [
        F.count("*").alias("n"), F.sum("square").alias("square"), F.count("square").alias("rated")])
