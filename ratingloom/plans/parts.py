"""Ratings cut into parts that are processed independently of each other.

A part's task receives its ratings together with one copy of every factor row they touch.
What travels is those rows, not a factor array per rating.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.factors import ITEM, USER
from ratingloom.operators.skew import salted_join, stage_hot_keys
from ratingloom.plans import exchange
from ratingloom.session import StagedTable, stage

# Parts get a task each up to this multiple of the session's shuffle partitions.
PARTS_PER_PARTITION = 4
# Records of a task that runs many parts: a task sorts them with the rows they touch, so its memory is bounded by this.
MAX_TASK_RECORDS = 250_000


def _node(side: Column, key: Column) -> Column:
    """One id space for both sides."""
    return (key.cast("long") * 2 + side).alias("node")


class PartedRatings:
    """Ratings laid out by part, with the factor rows that each part touches."""

    def __init__(self, records: StagedTable, touched: StagedTable, hot: StagedTable | None, num_parts: int, cache: bool):
        self.tables = {"records": records, "touched": touched, "hot": hot}
        self.table = records
        self.touched = touched
        self.hot = hot and hot.df
        self.num_parts = num_parts
        self._partitions = -(-records.df.count() // MAX_TASK_RECORDS)
        self.cache = cache
        placed = self._place(records.df)
        self.records = placed.persist(StorageLevel.MEMORY_AND_DISK) if cache else placed

    @classmethod
    def of(cls, parts: DataFrame, precision: str = "double", ordered: bool = True,
           cache: bool = False, root: str | None = None) -> PartedRatings:
        """``parts`` has ``part, user_id, item_id, rating`` and the order ``pos`` (if ``ordered``) or ``rec_id``."""
        kind = "double" if precision == "double" else "float"
        keyed = parts.select(F.col("part").cast("int").alias("part"), F.col("user_id").cast("long").alias("user_key"),
                             F.col("item_id").cast("long").alias("item_key"),
                             F.col("rating").cast(kind).alias("rating"),
                             F.col("pos" if ordered else "rec_id").cast("long"))
        if ordered:
            keyed = keyed.groupBy("part").applyInArrow(
                exchange.add_waves,
                f"part int, user_key long, item_key long, rating {kind}, pos long, wave int")
        records = stage(keyed, "parted-ratings", root=root)
        sides = [records.df.groupBy("part", F.lit(side).alias("side"), F.col(column).alias("key"))
                 .agg(F.count("*").alias("n")) for side, column in ((USER, "user_key"), (ITEM, "item_key"))]
        counted = sides[0].unionByName(sides[1])
        touched = stage(counted.select("*", _node(F.col("side"), F.col("key"))), "touched-rows", root=root)
        hot = stage_hot_keys(touched.df, "node", root=root)
        last = records.df.agg(F.max("part").alias("last")).first().last
        return cls(records, touched, hot, 1 if last is None else last + 1, cache)

    def _place(self, rows: DataFrame) -> DataFrame:
        """Bring the rows of a part together: a task of its own, or hashed when parts outnumber tasks."""
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if self.num_parts <= PARTS_PER_PARTITION * partitions:
            return rows.repartitionById(self.num_parts, "part")
        return rows.repartition(max(partitions, min(self.num_parts, self._partitions)), "part")

    def meet(self, state: DataFrame):
        """Cogroup of the touched factor rows ``(part, side, key, n, features)`` and the records, by part."""
        rows = state.select(_node(F.col("side"), F.col("id")), "features")
        copies = salted_join(self.touched.df, rows, "node", self.hot, F.col("part"))
        placed = self._place(copies.select("part", "side", "key", "n", "features"))
        return placed.groupBy("part").cogroup(self.records.groupBy("part"))

    def release(self) -> None:
        if self.cache:
            self.records.unpersist()

    def drop(self) -> None:
        for table in self.tables.values():
            if table:
                table.drop()
