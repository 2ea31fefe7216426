"""Reading a rating set: choice of format by name, dimensions, and load checks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.profiles import dimensions
from ratingloom.sources import coo_binary, coo_text


@dataclass(frozen=True)
class RatingSet:
    """``ratings`` with the dimensions of its header: ``(num_users, num_items, num_records)``.

    ``surplus`` has one row ``(num_surplus)``, the records left out because no header announces them.
    """

    ratings: DataFrame
    dims: DataFrame
    surplus: DataFrame | None = None

    def check(self) -> DataFrame:
        return check_ratings(self.ratings, self.dims, self.surplus)

    def require_valid(self) -> RatingSet:
        """Raise if any load check fails."""
        row = self.check().first()
        if not row.valid:
            failed = {k: v for k, v in row.asDict().items() if k.startswith("bad_") and v}
            raise ValueError(f"rating set rejected: {failed}")
        if row.surplus_records:
            warnings.warn(f"{row.surplus_records} records beyond the announced number are left out", stacklevel=2)
        return self


def _merged(headers: DataFrame) -> DataFrame:
    """Dimensions of all files together. Files of one set must agree on users and items."""
    agree = ((F.min("num_users") == F.max("num_users")) & (F.min("num_items") == F.max("num_items")))
    message = F.lit("the headers of the files disagree on the number of users or items")
    return headers.agg(
        F.when(agree, F.max("num_users")).otherwise(F.raise_error(message)).cast("long").alias("num_users"),
        F.max("num_items").cast("long").alias("num_items"),
        F.sum("num_records").alias("num_records"))


def read_ratings(spark: SparkSession, path: str, id_base: int | None = None, layout: str = "narrow") -> RatingSet:
    """Read ``.txt``, ``.bin`` or ``.parquet``; any other name is taken for text, with a warning.

    ``id_base`` is the smallest id in the file. It defaults to 1 for the wide binary layout and
    to 0 otherwise.
    """
    suffix = path.rstrip("/")
    if suffix.endswith(".bin"):
        return RatingSet(coo_binary.read_coo_binary(spark, path, layout, id_base),
                         _merged(coo_binary.read_header(spark, path, layout)))
    if suffix.endswith(".parquet"):
        stored = spark.read.parquet(path)
        return RatingSet(stored, dimensions(stored))
    if not suffix.endswith(".txt"):
        warnings.warn(f"unrecognized file type of {path!r}; reading it as text", stacklevel=2)
    text = coo_text.CooText(spark, path)
    return RatingSet(text.records(id_base or 0), _merged(text.header()), text.surplus())


def check_ratings(ratings: DataFrame, dims: DataFrame, surplus: DataFrame | None = None) -> DataFrame:
    """One row of counts over the whole set, and ``valid`` if none of the ``bad_`` ones is set.

    ``dims`` has one row ``(num_users, num_items, num_records)``, ``surplus`` one row ``(num_surplus)``:
    records that were left out as no header announces them. They are counted, not a fault.
    """
    limit = {name: dims.select(name).scalar() for name in ("num_users", "num_items", "num_records")}
    user, item, rating = F.col("user_id"), F.col("item_id"), F.col("rating")
    flags = {"bad_null_ids": user.isNull() | item.isNull(), "bad_null_ratings": rating.isNull(),
             "bad_negative_users": user < 0, "bad_negative_items": item < 0,
             "bad_large_users": user >= limit["num_users"], "bad_large_items": item >= limit["num_items"]}
    flagged = ratings.select(*[test.alias(name) for name, test in flags.items()])
    counted = flagged.agg(F.count("*").alias("records"), *[F.count_if(name).alias(name) for name in flags])
    result = counted.select("*", (limit["num_records"] - F.col("records")).alias("bad_missing_records"),
                            (surplus.scalar() if surplus else F.lit(0).cast("long")).alias("surplus_records"))
    bad = [c for c in result.columns if c.startswith("bad_")]
    return result.withColumn("valid", F.greatest(*[F.abs(F.col(c)) for c in bad]) == 0)
