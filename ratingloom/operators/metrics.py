"""Error measures of a model and comparison of runs with quality targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.factors import RatingSkew, predict

# Least exponent of a normal double.
LEAST_EXPONENT = -1022


def square_error(ratings: DataFrame, state: DataFrame, skew: RatingSkew | None = None,
                 width: int | None = None) -> DataFrame:
    """One row ``(square_error_sum, num_records, rmse)`` over the rated records the model covers."""
    scored = predict(ratings, state, skew, width=width)
    error = F.col("residual")
    return scored.agg(F.sum(error * error).alias("square_error_sum"), F.count(error).alias("num_records"),
                      F.sqrt(F.avg(error * error)).alias("rmse"))


def exact_sum(values: DataFrame, column: str) -> DataFrame:
    """One row ``(total, n)``: a sum of non-negative doubles whose bits depend on nothing but the values.

    A value is an integer below 2**53 times a power of two. Integers are added by that power, in three parts
    of 18 bits, so sums are exact in any order; the few sums are then put together in one fixed order.
    """
    value = F.col(column).cast("double")
    near = F.greatest(F.floor(F.log2(value)), F.lit(LEAST_EXPONENT))
    scaled = value * F.pow(F.lit(2.0), -near)
    # The logarithm may be one off beside a power of two.
    exponent = (near + F.when(scaled >= 2, 1).when((scaled < 1) & (near > LEAST_EXPONENT), -1).otherwise(0)).cast("int")
    mantissa = (value * F.pow(F.lit(2.0), -exponent) * F.lit(2.0 ** 52)).cast("long")
    finite = value.isNotNull() & ~F.isnan(value) & (value < float("inf"))
    parts = values.where(value.isNotNull()).select(
        F.when(finite & (value > 0), exponent).alias("exponent"), F.when(finite & (value > 0), mantissa).alias("mantissa"),
        F.when(~finite, value).alias("odd"))
    limbs = [F.sum(F.shiftright("mantissa", 18 * k).bitwiseAND((1 << 18) - 1)).alias(f"limb{k}") for k in range(3)]
    sums = parts.groupBy("exponent").agg(*limbs, F.count("*").alias("n"), F.sum("odd").alias("odd"))
    whole = sum((F.col(f"limb{k}").cast("decimal(38,0)") * F.lit(1 << 18 * k).cast("decimal(18,0)") for k in range(1, 3)),
                F.col("limb0").cast("decimal(38,0)"))
    term = whole.cast("double") * F.pow(F.lit(2.0), F.lit(-52)) * F.pow(F.lit(2.0), F.col("exponent"))
    # At most some two thousand powers.
    rows = sums.agg(F.array_sort(F.collect_list(F.when(F.col("exponent").isNotNull(), F.struct("exponent", term.alias("term"))))).alias("terms"),
                    F.sum("n").alias("n"), F.sum("odd").alias("odd"))
    total = F.aggregate("terms", F.lit(0.0).cast("double"), lambda t, x: t + x["term"])
    return rows.select(F.coalesce(F.col("odd"), F.when(F.col("n") > 0, total)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def square_error_exact(ratings: DataFrame, state: DataFrame, skew: RatingSkew | None = None) -> DataFrame:
    """As ``square_error``, with the same bits on any number of partitions."""
    scored = predict(ratings, state, skew)
    squares = scored.select((F.col("residual") * F.col("residual")).alias("square"))
    return exact_sum(squares, "square").select(
        F.col("total").alias("square_error_sum"), F.col("n").alias("num_records"),
        F.sqrt(F.try_divide("total", "n")).alias("rmse"))


def epochs_to_target(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """``(dataset, target_rmse, epochs)``: first epoch at or below each dataset's target.

    ``metrics`` has ``(dataset, iter, test_rmse)``; ``epochs`` is null when a run never got there.
    """
    reached = F.min(F.when(F.col("test_rmse") <= F.col("target_rmse"), F.col("iter")))
    return (metrics.join(targets, "dataset")
            .groupBy("dataset", "target_rmse").agg(reached.alias("epochs")))
