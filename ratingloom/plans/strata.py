"""Sequential descent (plain and adaptive) distributed by strata.

Users and items are hashed to P blocks each. A stratum pairs every user block with one
item block, so its P blocks share no factor row and can run in parallel; P strata cover
all ratings (Gemulla et al., KDD 2011). The result equals a one-by-one run in
(stratum, block, position) order.

A row that holds more than 1/(2P) of the ratings makes its block the bottleneck. On demand it
is split into copies, each with its own share of the ratings and its own block, and the
copies are averaged by their record counts after the epoch. All other rows stay exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import half_rows
from ratingloom.functions.arrays import array_type, scaled, sum_arrays
from ratingloom.functions.half import rounded_features
from ratingloom.functions.mixing import block_of
from ratingloom.operators.factors import ITEM, USER
from ratingloom.operators.skew import hot_keys
from ratingloom.plans import exchange, kernels
from ratingloom.session import StagedTable, stage

# Executors need only Spark, numpy and pyarrow: the task code travels with the job.
for _module in (exchange, kernels):
    cloudpickle.register_pickle_by_value(_module)

# A copy's key is ``id * COPY_SPAN + copy``.
COPY_BITS = 20
COPY_SPAN = 1 << COPY_BITS
# Blocks that should be able to run at once, unless they got too small.
PARALLELISM = 64
MAX_BLOCK_RECORDS = 2_000_000
MIN_BLOCK_RECORDS = 50_000
MAX_BLOCK_BYTES = 256 << 20
# Rows with fewer records are never split, however small the table.
MIN_SPLIT_RECORDS = 10_000
# Strata chained in one job; then the state is written to keep recovery short.
STRATA_PER_JOB = 32


def choose_blocks(num_records: int, num_rows: int, width: int, parallelism: int = PARALLELISM) -> int:
    """Blocks per side: ``parallelism`` while blocks stay worthwhile, more to bound their size.

    Blocks decide the order of the records, so the number follows from the data and this
    parameter, never from the cluster at hand.
    """
    for_size = math.ceil(math.sqrt(num_records / MAX_BLOCK_RECORDS))
    for_memory = math.ceil(num_rows * width * 16 / MAX_BLOCK_BYTES)
    worthwhile = math.ceil(math.sqrt(num_records / MIN_BLOCK_RECORDS))
    return max(1, for_size, for_memory, min(parallelism, worthwhile))


def split_copies(records: DataFrame, key: str, side: int, copies: DataFrame) -> DataFrame:
    """Add ``_copy``: which copy of a split row a record belongs to (0 for whole rows)."""
    joined = records.join(F.broadcast(copies), key, "left")
    spread = F.pmod(F.xxhash64("rec_id", F.lit(side)), F.col("copies"))
    return joined.withColumn("_copy", F.coalesce(spread, F.lit(0)).cast("long")).drop("copies")


class BlockedRatings:
    """Ratings laid out by (stratum, block), written once and reused by every epoch."""

    def __init__(self, tables: dict[str, StagedTable], blocks: int, cache: bool):
        """``tables`` are ``ratings`` and, where rows were split, ``users``, ``items`` and ``weights`` of the copies."""
        self.tables = tables
        self.table = tables["ratings"]
        self.blocks = blocks
        self.split = "weights" in tables
        self.cache = cache
        self._strata: dict[int, DataFrame] = {}

    @classmethod
    def of(cls, ratings: DataFrame, blocks: int, precision: str = "double", cache: bool = False,
           min_split: int = MIN_SPLIT_RECORDS, split_hot: bool = False, root: str | None = None) -> BlockedRatings:
        """``ratings`` has ``rec_id, user_id, item_id, rating`` and the training order ``pos``.

        Every row is exact, and a block may hold all records of its most frequent id. With ``split_hot``
        a row with more than 1/(2P) of the records, and more than ``min_split``, is trained as several
        copies that are averaged. Tables lie under ``root`` if given.
        """
        # Counting, sampling and laying out each scan the ratings; sort them only once.
        ordered = stage(ratings.select("rec_id", "user_id", "item_id", "rating", "pos"), "ordered-ratings")
        ratings = ordered.df
        copies = {}
        if split_hot:
            # At most 2P rows per side can exceed the limit: small enough to write and broadcast.
            limits = {"min_rows": min_split, "max_keys": 2 * blocks}
            for side, key in ((USER, "user_id"), (ITEM, "item_id")):
                copies[side] = stage(hot_keys(ratings, key, **limits), f"split-{key}", root=root)
        split = not all(table.df.isEmpty() for table in copies.values())

        kind = "double" if precision == "double" else "float"
        assigned = ratings.withColumns({"_uc": F.lit(0).cast("long"), "_ic": F.lit(0).cast("long")})
        if split:
            assigned = split_copies(ratings, "user_id", USER, copies[USER].df).withColumnsRenamed({"_copy": "_uc"})
            assigned = split_copies(assigned, "item_id", ITEM, copies[ITEM].df).withColumnsRenamed({"_copy": "_ic"})
        assigned = (assigned
                    .withColumn("block", block_of(F.col("user_id"), F.col("_uc"), blocks))
                    .withColumn("_other", block_of(F.col("item_id"), F.col("_ic"), blocks))
                    .select(F.pmod(F.col("_other") - F.col("block"), F.lit(blocks)).cast("int").alias("stratum"),
                            "block",
                            (F.col("user_id").cast("long") * COPY_SPAN + F.col("_uc")).alias("user_key"),
                            (F.col("item_id").cast("long") * COPY_SPAN + F.col("_ic")).alias("item_key"),
                            F.col("rating").cast(kind).alias("rating"), F.col("pos").cast("long").alias("pos")))
        # The range layout both satisfies the grouping and keeps few files per stratum.
        waves = (assigned.repartitionByRange("stratum", "block").groupBy("stratum", "block")
                 .applyInArrow(exchange.add_waves, "stratum int, block int, user_key long, item_key long, "
                                                   f"rating {kind}, pos long, wave int"))
        tables = {"ratings": stage(waves, "blocked-ratings", ["stratum"], root)}
        ordered.drop()
        if split:
            weights = cls._copy_weights(tables["ratings"].df, copies[USER].df, copies[ITEM].df)
            tables |= {"users": copies[USER], "items": copies[ITEM], "weights": stage(weights, "copy-weights", root=root)}
        return cls(tables, blocks, cache)

    @staticmethod
    def _copy_weights(table: DataFrame, user_copies: DataFrame, item_copies: DataFrame) -> DataFrame:
        """Records of each copy: ``(side, key, n)``, at most about 4P rows a side."""
        parts = []
        for side, key, column, copies in ((USER, "user_key", "user_id", user_copies),
                                          (ITEM, "item_key", "item_id", item_copies)):
            hot = table.withColumn(column, _id_of(key)).join(
                F.broadcast(copies), column, "left_semi")
            parts.append(hot.groupBy(F.lit(side).alias("side"), F.col(key).alias("key"))
                         .agg(F.count("*").alias("n")))
        return parts[0].unionByName(parts[1])

    def stratum(self, number: int) -> DataFrame:
        """The stratum's ratings, one task per block."""
        if number not in self._strata:
            rows = self.table.df.where(F.col("stratum") == number).drop("stratum")
            placed = rows.repartitionById(self.blocks, "block")
            self._strata[number] = placed.persist(StorageLevel.MEMORY_AND_DISK) if self.cache else placed
        return self._strata[number]

    def release(self) -> None:
        if self.cache:
            for rows in self._strata.values():
                rows.unpersist()
        self._strata.clear()

    def drop(self) -> None:
        for table in self.tables.values():
            table.drop()

    def expand(self, state: DataFrame) -> DataFrame:
        """Factor rows with ``key`` and home ``block``; split rows once per copy."""
        lists = [c for c in state.columns if c not in ("side", "id")]
        copy = F.lit(0).cast("long")
        if self.split:
            last = F.coalesce("copies", F.lit(1)).cast("long") - 1
            state = state.join(F.broadcast(self._split_rows()), ["side", "id"], "left").withColumn(
                "_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            copy = F.col("_copy")
        return state.select("side", (F.col("id").cast("long") * COPY_SPAN + copy).alias("key"),
                            block_of(F.col("id"), copy, self.blocks).alias("home"), *lists)

    def collapse(self, expanded: DataFrame, width: int, precision: str) -> DataFrame:
        """Back to one row per id; copies are averaged, weighted by their record counts."""
        lists = [c for c in expanded.columns if c not in ("side", "key", "home")]
        rows = expanded.withColumn("id", _id_of("key"))
        if not self.split:
            return rows.select("side", "id", *lists)
        marked = rows.join(F.broadcast(self._split_rows()), ["side", "id"], "left")
        whole = marked.where(F.col("copies").isNull()).select("side", "id", *lists)
        # Copies without a record have no weight and drop out.
        copies = marked.where(F.col("copies").isNotNull()).join(F.broadcast(self.tables["weights"].df), ["side", "key"])
        rounding = lambda mean: rounded_features(mean, precision)
        return whole.unionByName(average_copies(copies, ["side", "id"], lists, width, rounding))

    def _split_rows(self) -> DataFrame:
        """``(side, id, copies)`` of the split rows, at most 2P a side."""
        sides = [self.tables[name].df.select(F.lit(side).alias("side"), F.col(key).alias("id"), "copies")
                 for name, side, key in (("users", USER, "user_id"), ("items", ITEM, "item_id"))]
        return sides[0].unionByName(sides[1])


def _id_of(key: str) -> Column:
    return F.shiftright(F.col(key), COPY_BITS).cast("int")


def average_copies(copies: DataFrame, keys: list[str], lists: list[str], width: int,
                   rounding: Callable[[Column], Column]) -> DataFrame:
    """Record-weighted mean of each row's copies (``n`` records each), combined on the map side."""
    result = None
    for column in lists:
        weighted = copies.select(*keys, "n", scaled(F.col("n").cast("double"), F.col(column)).alias(column))
        summed = sum_arrays(weighted, keys, column, width, [F.sum("n").alias("_total")])
        mean = F.transform(column, lambda x: x / F.col("_total"))
        part = summed.select(*keys, rounding(mean).alias(column))
        result = part if result is None else result.join(part, keys)
    return result


def square_error(ratings: BlockedRatings, state: DataFrame, width: int) -> DataFrame:
    """One row ``(square_error_sum, num_records, rmse)`` over the laid-out ratings.

    The ratings stay where they lie; a factor row travels once a stratum instead of once a rating.
    """
    score = exchange.BlockScore(width)

    def block(key, factor_rows, records):
        return score.errors(factor_rows, records)

    rows = ratings.expand(state.select("side", "id", "features"))
    parts = []
    for number in range(ratings.blocks):
        records = ratings.stratum(number).select("block", "user_key", "item_key", "rating")
        parts.append(_met(rows, number, ratings.blocks).groupBy("block").cogroup(records.groupBy("block"))
                     .applyInArrow(block, "square_error_sum double, num_records long"))
    total = reduce(DataFrame.unionByName, parts).agg(
        F.sum("square_error_sum").alias("square_error_sum"), F.coalesce(F.sum("num_records"), F.lit(0)).alias("num_records"))
    return total.withColumn("rmse", F.sqrt(F.try_divide("square_error_sum", "num_records")))


def _met(rows: DataFrame, number: int, blocks: int) -> DataFrame:
    """Factor rows at the block where a stratum needs them."""
    # User blocks stay put; item blocks move on by one block per stratum.
    meeting = F.when(F.col("side") == USER, F.col("home")).otherwise(
        F.pmod(F.col("home") - number, F.lit(blocks))).cast("int")
    return rows.withColumn("block", meeting).repartitionById(blocks, "block")


def stratified_epoch(ratings: BlockedRatings, state: DataFrame, rule: str, width: int, learning_rate: float,
                     regularization: float, precision: str = "double", batch_size: int = 1,
                     root: str | None = None) -> StagedTable:
    """One pass over all ratings. ``rule`` is 'sgd', 'adagrad' or 'minibatch'.

    With 'minibatch' the batches are consecutive records of a block instead of the whole table.
    """
    update = exchange.BlockUpdate(rule, width, float(learning_rate), float(regularization), precision, batch_size)
    return stratified_pass(ratings, state, update, precision, root)


def stratified_pass(ratings: BlockedRatings, state: DataFrame, update: exchange.BlockUpdate, precision: str,
                    root: str | None = None) -> StagedTable:
    """Apply ``update`` to all blocks, stratum after stratum."""
    blocks, lists = ratings.blocks, list(update.lists)
    # Half rows travel and are written as two bytes a value.
    kind = "binary" if precision == "half" else array_type(precision)
    schema = "side int, key long, home int" + "".join(f", {name} {kind}" for name in lists)

    def step(key, factor_rows, records):
        return update(factor_rows.drop_columns("block"), records)

    current = ratings.expand(state)
    if precision == "half":
        current = half_rows.packed(current, lists)
    written: StagedTable | None = None
    for number in range(blocks):
        current = (_met(current, number, blocks).groupBy("block").cogroup(ratings.stratum(number).groupBy("block"))
                   .applyInArrow(step, schema))
        if (number + 1) % STRATA_PER_JOB == 0 and number + 1 < blocks:
            following = stage(current, "strata-state")
            if written:
                written.drop()
            written, current = following, following.df
    if precision == "half" and ratings.split:
        current = half_rows.unpacked(current, lists)
    last = ratings.collapse(current, update.lists["features"], precision)
    if precision == "half":
        result = stage(half_rows.packed(last, lists) if ratings.split else last, "factors", root=root)
        result = StagedTable(half_rows.unpacked(result.df, lists), result.path)
    else:
        result = stage(last, "factors", root=root)
    if written:
        written.drop()
    return result
