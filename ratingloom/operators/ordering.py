"""Record order: seeded permutations, dense positions, batches, per-user offsets.

A single global window would run as one task. Positions are therefore computed in two
levels: rows are numbered inside many small ordered buckets, and each bucket's base is
the running total of the bucket sizes before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.functions.bijection import Bijection
from ratingloom.functions.mixing import shuffle_key, shuffle_prefix
from ratingloom.session import StagedTable, stage

# Consecutive keys that share one sub-bucket of a shuffle prefix: 2**30 dense keys over
# ~10,000 prefixes leave about 100,000 rows per bucket at any table size.
SUB_BUCKET_BITS = 30
# Ranges of positions, where these are known without sorting.
MAX_PREFIXES = 10_000


def range_positions(df: DataFrame, order: list[str], keep: list[str], position: str = "rec_id",
                    partitions: int | None = None) -> StagedTable:
    """Dense 0-based position of every row in the order of ``order`` (a unique key).

    The range partitioning is sampled, so its outcome is written once and the offsets
    are counted on what was written: a recomputed task can not shift positions.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = (df.repartitionByRange(count, *order).sortWithinPartitions(*order)
              .select(*keep, F.spark_partition_id().alias("_part"), in_partition.alias("_index")))
    written = stage(ranged, position)
    # One row per range partition: the driver turns at most ``count`` sizes into offsets.
    sizes = written.df.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").toArrow()
    rows = sizes.column("n").to_numpy()
    bases = spark.createDataFrame(pa.table({
        "_part": sizes.column("_part"), "_base": pa.array(np.cumsum(rows) - rows, pa.int64())}))
    placed = (written.df.join(F.broadcast(bases), "_part")
              .select((F.col("_base") + F.col("_index")).alias(position), *keep))
    return StagedTable(placed, written.path)


def _bucket_bases(sizes: DataFrame, prefix: str, sub: str, size: str) -> DataFrame:
    """Running total of ``size`` before each ``(prefix, sub)`` bucket."""
    inside = Window.partitionBy(prefix).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy(prefix).rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy(prefix).agg(F.sum(size).alias("_total"))
    # Prefixes are few by construction (see shuffle_prefix), so one task can sum them.
    starts = totals.select(prefix, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_start"))
    local = sizes.select(prefix, sub, F.coalesce(F.sum(size).over(inside), F.lit(0)).alias("_local"))
    return local.join(starts, prefix).select(
        prefix, sub, (F.col("_start") + F.col("_local")).alias("_base"))


def _bucketed(df: DataFrame, key: str, seed: int, method: str, shuffle: Bijection | None = None) -> DataFrame:
    if shuffle:
        # Positions are known: buckets are ranges of them.
        width = max(1, -(-shuffle.size // MAX_PREFIXES))
        return (df.withColumn("_order", shuffle.position(F.col(key)))
                .withColumn("_prefix", F.floor(F.col("_order") / width)).withColumn("_sub", F.lit(0)))
    order = shuffle_key(F.col(key), seed, method)
    return (df.withColumn("_order", order)
            .withColumn("_prefix", shuffle_prefix(F.col("_order"), method))
            .withColumn("_sub", F.shiftright(F.col(key).cast("long"), SUB_BUCKET_BITS)
                        if method == "mix" else F.shiftright(F.col("_order"), 40)))


def shuffled_positions(df: DataFrame, key: str, seed: int, position: str = "pos",
                       method: str = "mix") -> DataFrame:
    """Add the dense position of each row in a seeded random permutation of ``key``.

    Everything derives from the key, so no sampling and no materialisation is needed and
    any recomputation gives the same permutation. ``key`` must be unique. With ``bijective`` the
    position is arithmetic on the key: no sort and no shuffle, and as dense as the keys are, which must not be negative.
    """
    if method == "bijective":
        last = df.agg(F.max(key).alias("last")).first().last
        return df.withColumn(position, Bijection(0 if last is None else last + 1, seed).position(F.col(key)))
    rows = _bucketed(df, key, seed, method)
    bucket = ["_prefix", "_sub"]
    sizes = (_bucketed(df.select(key), key, seed, method)
             .groupBy(*bucket).agg(F.count("*").alias("_n")))
    order = Window.partitionBy(*bucket).orderBy("_order", key)
    numbered = rows.withColumn("_index", F.row_number().over(order) - 1)
    placed = numbered.join(_bucket_bases(sizes, "_prefix", "_sub", "_n"), bucket)
    return placed.select(*df.columns, (F.col("_base") + F.col("_index")).alias(position))


def batch_numbers(positioned: DataFrame, batch_size: int | Column, position: str = "pos") -> DataFrame:
    """Add ``batch``: the mini-batch a record belongs to. The last batch may be short."""
    size = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    return positioned.withColumn("batch", F.floor(F.col(position) / size))


def user_offsets(ratings: DataFrame, num_users: int, seed: int, method: str = "mix") -> DataFrame:
    """``(user_id, pos, base, cnt)``: users in shuffled order with their record offsets.

    ``base`` is the number of records of all users before this one. Users without
    records are kept with a count of 0.
    """
    spark = ratings.sparkSession
    shuffle = Bijection(num_users, seed) if method == "bijective" else None
    counts = ratings.groupBy("user_id").agg(F.count("*").alias("cnt"))
    users = spark.range(num_users).select(F.col("id").cast("int").alias("user_id"))
    counted = (users.join(counts, "user_id", "left")
               .withColumn("cnt", F.coalesce("cnt", F.lit(0))))
    rows = _bucketed(counted, "user_id", seed, method, shuffle)
    bucket = ["_prefix", "_sub"]
    sizes = rows.groupBy(*bucket).agg(F.sum("cnt").alias("_n"), F.count("*").alias("_users"))
    order = Window.partitionBy(*bucket).orderBy("_order", "user_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = (rows.withColumn("_index", F.row_number().over(order) - 1)
                .withColumn("_before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0))))
    by_records = _bucket_bases(sizes, "_prefix", "_sub", "_n")
    by_users = _bucket_bases(sizes, "_prefix", "_sub", "_users").withColumnRenamed("_base", "_first")
    placed = numbered.join(by_records, bucket).join(by_users, bucket)
    return placed.select("user_id", (F.col("_first") + F.col("_index")).alias("pos"),
                         (F.col("_base") + F.col("_before")).alias("base"), "cnt")
