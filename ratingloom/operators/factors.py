"""Factor state: initialization, scoring and application of updates.

Both factor matrices live in one state table ``(side, id, features[, acc])`` with
``side`` 0 for users and 1 for items, so one aggregation or join serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.functions.arrays import array_type, dot
from ratingloom.functions.half import rounded_features
from ratingloom.functions.mixing import initial_value, parity_values
from ratingloom.operators.skew import hot_keys, salted_join, stage_hot_keys
from ratingloom.session import StagedTable

USER, ITEM = 0, 1
# Salts of the two initial matrices (fixed values).
USER_SALT, ITEM_SALT = 1, 2
# A rating table without columns of its own.
RATING_TYPES = {"rec_id": "bigint", "user_id": "int", "item_id": "int", "rating": "double"}


def init_state(spark: SparkSession, num_users: int, num_items: int, width: int, method: str = "mix",
               precision: str = "double", accumulators: bool = False) -> DataFrame:
    """``(side, id, features[, acc])`` for all ids of both dimensions, features uniform in [0, 0.1)."""
    side = (F.col("id") >= num_users).cast("int")
    rows = spark.range(num_users + num_items).select(
        side.alias("side"), (F.col("id") - side * num_users).cast("int").alias("id"))
    salt = F.when(F.col("side") == USER, USER_SALT).otherwise(ITEM_SALT)
    if method == "parity":
        # Both sides begin with the same draws, as two generators with the default seed do.
        values = parity_values(F.col("id"), width).cast("array<double>")
    else:
        values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                             lambda k: initial_value(F.col("id"), k, salt, method))
    columns = ["side", "id", rounded_features(values, precision).alias("features")]
    if accumulators:
        zero = F.lit(0.0).cast("double")
        columns.append(F.array_repeat(zero, width).cast(array_type(precision)).alias("acc"))
    return rows.select(*columns)


def side_of(state: DataFrame, side: int) -> DataFrame:
    return state.where(F.col("side") == side).drop("side")


class RatingSkew:
    """Hot users and hot items of a rating table (None: there are none), shared by all joins on it."""

    def __init__(self, users: DataFrame | None = None, items: DataFrame | None = None,
                 tables: tuple[StagedTable, ...] = ()):
        self.users = users
        self.items = items
        self._tables = tables

    def drop(self) -> None:
        """Delete what ``staged`` wrote."""
        for table in self._tables:
            table.drop()

    @classmethod
    def of(cls, ratings: DataFrame, **limits) -> RatingSkew:
        return cls(hot_keys(ratings, "user_id", **limits), hot_keys(ratings, "item_id", **limits))

    @classmethod
    def staged(cls, ratings: DataFrame, **limits) -> RatingSkew:
        """As ``of``, but counted and written now, for runs that join again and again."""
        tables = [stage_hot_keys(ratings, key, **limits) for key in ("user_id", "item_id")]
        return cls(*[table and table.df for table in tables], tuple(t for t in tables if t))


def attach_factors(ratings: DataFrame, state: DataFrame, skew: RatingSkew | None = None,
                   how: str = "inner", salt: str = "rec_id") -> DataFrame:
    """Ratings with the ``p`` (user) and ``q`` (item) arrays of their factor rows.

    Without ``skew`` these are plain joins, whose large partitions Spark splits by itself; hot ids
    are salted where they were counted before. No factor table is broadcast, see ``salted_join``.
    """
    skew = skew or RatingSkew()
    users = side_of(state, USER).select(F.col("id").alias("user_id"), F.col("features").alias("p"))
    items = side_of(state, ITEM).select(F.col("id").alias("item_id"), F.col("features").alias("q"))
    with_users = salted_join(ratings, users, "user_id", skew.users, F.col(salt), how)
    return salted_join(with_users, items, "item_id", skew.items, F.col(salt), how)


def predict(ratings: DataFrame, state: DataFrame, skew: RatingSkew | None = None,
            cold_start: str = "drop", width: int | None = None) -> DataFrame:
    """Add ``prediction`` (inner product) and ``residual`` (prediction - rating, if rated).

    Ids outside the model are dropped, or kept with a NaN prediction (``cold_start='nan'``). Plain rating
    tables meet factor rows of a known, large ``width`` on a grid, or stream them if they are many, where that moves
    less than a factor array per rating.
    """
    if cold_start not in ("drop", "nan"):
        raise ValueError("cold_start must be 'drop' or 'nan'")
    if width and cold_start == "drop" and dict(ratings.dtypes) == RATING_TYPES:
        from ratingloom.plans import grid, streamed

        found = grid.wide_pass(ratings, state, width)
        if found:
            scored = (streamed.predictions(ratings, state, found, width) if isinstance(found, streamed.Sizes)
                      else grid.grid_predict(found, state, width))
            return scored.select(*ratings.columns, "prediction", "residual")
    joined = attach_factors(ratings, state, skew, "inner" if cold_start == "drop" else "left")
    scored = joined.withColumn("prediction", F.coalesce(dot(F.col("p"), F.col("q"), width), F.lit(float("nan"))))
    scored = scored.drop("p", "q")
    if "rating" in ratings.columns:
        scored = scored.withColumn("residual", F.col("prediction") - F.col("rating"))
    return scored


def apply_step(state: DataFrame, gradients: DataFrame, learning_rate: float, regularization: float,
               precision: str = "double", carry: tuple[str, ...] = ()) -> DataFrame:
    """One descent step on the touched rows: ``x -= lr * (gradient + lambda * x)``.

    The left join keeps rows without a gradient exactly as they are. Columns of ``gradients`` named by ``carry`` stay.
    """
    sums = ["gradient", *carry]
    joined = state.join(gradients.select("side", "id", *sums).hint("shuffle_hash"), ["side", "id"], "left")
    return joined.select("side", "id", stepped_features(learning_rate, regularization, precision).alias("features"), *carry)


def stepped_features(learning_rate: float, regularization: float, precision: str = "double") -> Column:
    """``features`` after a step by ``gradient``; without a gradient they stay exactly as they are."""
    lr, lam = F.lit(float(learning_rate)), F.lit(float(regularization))
    moved = F.zip_with("features", "gradient", lambda x, g: x - lr * (g + lam * x))
    return F.coalesce(rounded_features(moved, precision), F.col("features"))


def explode_features(table: DataFrame, *keys: str, column: str = "features") -> DataFrame:
    """``(keys..., k, value)``: one row per array element."""
    return table.select(*keys, F.posexplode(column).alias("k", "value"))
