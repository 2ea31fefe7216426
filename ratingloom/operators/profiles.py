"""Per-user views of a rating table: dimensions, counts, deduplication, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.functions.number_text import general_format

# Item ids, and so entries, that one profile row covers at most.
MAX_PROFILE_ENTRIES = 100_000


def dimensions(ratings: DataFrame) -> DataFrame:
    """One row ``(num_users, num_items, num_records)`` from the ids themselves."""
    return ratings.agg(
        (F.coalesce(F.max("user_id"), F.lit(-1)) + 1).cast("long").alias("num_users"),
        (F.coalesce(F.max("item_id"), F.lit(-1)) + 1).cast("long").alias("num_items"),
        F.count("*").alias("num_records"))


def rebase_ids(ratings: DataFrame, id_base: int) -> DataFrame:
    """Shift ids that start at ``id_base`` to start at 0; ids beyond 31 bits become null, which checks count."""
    return ratings.withColumns({"user_id": (F.col("user_id") - id_base).try_cast("int"),
                                "item_id": (F.col("item_id") - id_base).try_cast("int")})


def user_counts(ratings: DataFrame, num_users: int) -> DataFrame:
    """Records per user, with a 0 for every user of the dimension without any."""
    users = ratings.sparkSession.range(num_users).select(F.col("id").cast("int").alias("user_id"))
    counts = ratings.groupBy("user_id").agg(F.count("*").alias("cnt"))
    return users.join(counts, "user_id", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def dedupe_last(ratings: DataFrame, order: str = "rec_id") -> DataFrame:
    """Of records with the same user and item keep the last one in ``order``.

    ``max_by`` combines on the map side, so a pair repeated without bound still
    reaches the reducer as one row per map task.
    """
    return ratings.groupBy("user_id", "item_id").agg(
        F.max_by("rating", order).alias("rating"), F.max(order).alias(order))


def _profile_parts(deduped: DataFrame, max_entries: int) -> DataFrame:
    """Add ``part``: the range of ``max_entries`` item ids. Deduplicated, it can not hold more entries."""
    return deduped.withColumn("part", F.floor(F.col("item_id") / max_entries).cast("int"))


def user_profiles(ratings: DataFrame, order: str = "rec_id",
                  max_entries: int = MAX_PROFILE_ENTRIES) -> DataFrame:
    """``(user_id, part, profile)`` with ``profile`` a map from item id to rating.

    A user has one row for each range of ``max_entries`` item ids with ratings, whatever the
    length of the profile: part k covers the ids from ``k * max_entries`` on.
    """
    parts = _profile_parts(dedupe_last(ratings, order), max_entries)
    return parts.groupBy("user_id", "part").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("item_id", "rating")))).alias("profile"))


def profile_text(ratings: DataFrame, order: str = "rec_id",
                 max_entries: int = MAX_PROFILE_ENTRIES) -> DataFrame:
    """``(user_id, part, text)``: ``id count item rating item rating ...`` in item order.

    The first part of a user begins with id and count, later ones continue the list.
    """
    deduped = dedupe_last(ratings, order)
    entry = F.struct("item_id", F.concat_ws(
        " ", F.col("item_id").cast("string"), general_format(F.col("rating"), 6)).alias("entry"))
    lines = _profile_parts(deduped, max_entries).groupBy("user_id", "part").agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"))
    # One row a part: the window sees few and small rows of a user.
    parts = Window.partitionBy("user_id")
    lines = lines.withColumns({"_count": F.sum(F.size("_entries")).over(parts), "_first": F.min("part").over(parts)})
    body = F.concat_ws(" ", F.transform("_entries", lambda e: e["entry"]))
    head = F.concat_ws(" ", F.col("user_id").cast("string"), F.col("_count").cast("string"), body)
    return lines.select("user_id", "part", F.when(F.col("part") == F.col("_first"), head).otherwise(body).alias("text"))
