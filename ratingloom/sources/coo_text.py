"""Coordinate-format text: ``%`` comments, a header line, then ``user item rating`` lines.

Lines of a split file arrive in many tasks, while both the header and the record order
depend on the line number. Tasks read fixed byte ranges that begin at line breaks; a first
pass counts the lines of each range, and a line's number follows from its place in the range.

Where tasks can not open the files themselves (patterns, packed files, stores that only Spark
reads), Spark's text reader gives the byte at which a block starts and the order of rows
inside it. How it splits files may change between two reads, so lines are then written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.session import stage
from ratingloom.sources import text_ranges


def _split(lines: DataFrame) -> DataFrame:
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return lines.select("file", "block", "line_id", *[F.get(tokens, F.lit(k)).alias(f"t{k}") for k in range(3)])


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, line_id, t0, t1, t2)`` of all lines that are neither comments nor blank."""
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kept = text.where(~F.startswith("value", F.lit("%")) & (F.trim(F.translate("value", "\t\r", "  ")) != ""))
    # Increasing within a task; a task reads each of its blocks from start to end.
    return _split(kept.withColumn("line_id", F.monotonically_increasing_id()))


def _token(position: int, kind: str, prefix: str = "t") -> F.Column:
    """A token as ``kind``, or null if it is missing or malformed."""
    return F.col(f"{prefix}{position}").try_cast(kind)


class CooText:
    """Text files of one rating set, read by fixed byte ranges where tasks can open them, else written once."""

    def __init__(self, spark: SparkSession, path: str | list[str], range_bytes: int = text_ranges.DEFAULT_RANGE_BYTES):
        if isinstance(path, str) and text_ranges.reachable(path):
            self._written = None
            self._lines = _split(text_ranges.read_lines(spark, path, range_bytes))
        else:
            self._written = stage(_lines(spark, path), "text-lines")
            self._lines = self._written.df
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sizes = self._lines.groupBy("file", "block").agg(
            F.count("*").alias("n"), F.min("line_id").alias("first"),
            *[F.min_by(f"t{k}", "line_id").alias(f"h{k}") for k in range(3)])
        self.blocks = stage(sizes.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "text-blocks")

    def drop(self) -> None:
        """Delete what was written; readers of ``records`` must be done."""
        if self._written:
            self._written.drop()
        self.blocks.drop()

    def header(self) -> DataFrame:
        """``(file, num_users, num_items, num_records)``, one row per file."""
        return self.blocks.df.where(F.col("base") == 0).select(
            "file", _token(0, "int", "h").alias("num_users"), _token(1, "int", "h").alias("num_items"),
            _token(2, "long", "h").alias("num_records"))

    def surplus(self) -> DataFrame:
        """One row ``(num_surplus)``: record lines beyond what the headers announce."""
        lines = self.blocks.df.groupBy("file").agg((F.sum("n") - 1).alias("records")).join(self.header(), "file")
        beyond = F.greatest(F.col("records") - F.coalesce("num_records", F.lit(0)), F.lit(0))
        return lines.agg(F.coalesce(F.sum(beyond), F.lit(0)).alias("num_surplus"))

    def records(self, id_base: int = 0) -> DataFrame:
        """``(rec_id, user_id, item_id, rating)`` in file order, ids shifted to start at 0.

        Lines beyond the number a header announces are left out and counted by ``surplus``. Malformed
        values become null, for ``check_ratings`` to report. Several files are read in the order of
        their names.
        """
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        # One row per file, so one task can number the files.
        starts = self.header().select("file", "num_records").withColumn(
            "start", F.coalesce(F.sum("num_records").over(before), F.lit(0)))
        index = self.blocks.df.select("file", "block", "first", "base").join(starts, "file")
        number = F.col("base") + F.col("line_id") - F.col("first")
        # A row a block of some megabytes: small enough to broadcast as a rule; Spark decides by size.
        numbered = self._lines.join(index, ["file", "block"]).withColumn("number", number)
        return numbered.where((F.col("number") > 0) & (F.col("number") <= F.col("num_records"))).select(
            (F.col("start") + F.col("number") - 1).alias("rec_id"),
            (_token(0, "long") - id_base).try_cast("int").alias("user_id"),
            (_token(1, "long") - id_base).try_cast("int").alias("item_id"),
            _token(2, "float").alias("rating"))
