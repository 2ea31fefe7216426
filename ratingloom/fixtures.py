"""The rating tables that the registered queries run on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.operators.ordering import range_positions
from ratingloom.sources import part_files

# Every tenth record is held out for testing.
TEST_EVERY = 10

_RECORD_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_written: dict[tuple[str, str], DataFrame] = {}


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rec_id, user_id, item_id, rating)``: customers rating the parts they ordered.

    Positions need one global sort, so the table is written once per session and folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_RECORD_ORDER)
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
        # One plan at every size: a broadcast of small tables would make figures of two sizes incomparable.
        joined = lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            *_RECORD_ORDER,
            F.col("o_custkey").cast("int").alias("user_id"),
            F.col("l_partkey").cast("int").alias("item_id"),
            (1 + (F.col("l_quantity").cast("long") - 1) % 5).cast("double").alias("rating"))
        _written[key] = range_positions(joined, _RECORD_ORDER, ["user_id", "item_id", "rating"]).df
    return _written[key]


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where(F.col("rec_id") % TEST_EVERY != 0)


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).where(F.col("rec_id") % TEST_EVERY == 0)


def write_coo_text(records: DataFrame, dims, path: str, files: int = 1) -> str:
    """Write ``records`` in ``rec_id`` order as coordinate text, each file with its own header."""
    spark = records.sparkSession
    total = max(1, dims.num_records)
    placed = records.select(F.floor(F.col("rec_id") * files / total).cast("int").alias("file"),
                            (F.col("rec_id") + 1).alias("line"),
                            F.concat_ws("\t", "user_id", "item_id", "rating").alias("value"))
    counts = placed.groupBy("file").agg(F.count("*").alias("n"))
    headers = counts.select("file", F.lit(0).cast("long").alias("line"), F.concat_ws(
        " ", F.lit(dims.num_users), F.lit(dims.num_items), F.col("n")).alias("value"))
    comments = spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(-1).cast("long").alias("line"),
                                         F.lit("% user item rating").alias("value"))
    lines = placed.unionByName(headers).unionByName(comments)
    lines.repartitionById(files, "file").sortWithinPartitions("line").select("value").write.text(path)
    return path


def file_count(num_records: int) -> int:
    """Files for a written table: four, or one a million records."""
    return max(4, -(-num_records // 1_000_000))


def write_coo_binary(records: DataFrame, dims, path: str, layout: str, id_base: int, files: int = 1) -> str:
    """Write ``records`` in ``rec_id`` order as coordinate binary files, one task per file."""
    part_files.register(records.sparkSession)
    total = max(1, dims.num_records)
    placed = (records.withColumn("file", F.floor(F.col("rec_id") * files / total).cast("int"))
              .repartitionById(files, "file").sortWithinPartitions("rec_id").select("user_id", "item_id", "rating"))
    (placed.write.format("coo_binary_files").mode("append").option("layout", layout).option("idBase", id_base)
     .option("numUsers", dims.num_users).option("numItems", dims.num_items).save(path))
    return path
