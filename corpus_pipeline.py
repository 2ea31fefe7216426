"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

All stages but the last return the columns of their input. Null and empty texts pass the
filters unless the classifier rejects them. A row is known by its id and text, so that rows with
null or shared ids are judged apart; repeated rows of one document leave one. Columns beside
``doc_id``, ``text`` and ``n_chars`` are carried along untouched, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.decontaminate import contaminated
from ratingloom.llm.jaccard import near_duplicates
from ratingloom.llm.line_dedup import WHOLE, dedup_lines
from ratingloom.llm.packing import pack_documents
from ratingloom.llm.quality_model import THRESHOLD, fit_quality, quality_score
from ratingloom.llm.tables import text_column
from ratingloom.llm.token_ids import tokenizer_path
from ratingloom.session import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier rejects."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(spark, model) >= THRESHOLD)


def _columns(names: list[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in names]


def _row_key() -> Column:
    """Tells documents apart by id and text: ids may be null or shared."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_column())


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the row key in place of the id."""
    return docs.select(_row_key().alias("doc_id"), text_column().alias("text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines of repeated three-line windows; a document of which no line is left goes.

    Columns that are named like the counts of the line operator pass through.
    """
    own = {name: f"__own_{name}" for name in ("n_lines", "n_removed_lines") if name in docs.columns}
    cut = dedup_lines(docs.withColumnsRenamed(own), WHOLE).where("n_lines = 0 or n_removed_lines < n_lines")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{own.get(name, name)}`").alias(name) for name in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group: one of the smallest id, nulls first.

    Rows with the same id and text are one document. Rows with null or shared ids are told apart by their texts.
    """
    groups = near_duplicates(_keyed(docs)).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    ids = docs.select(_row_key().alias("__key"), F.col("doc_id").cast("long").alias("__id"))
    rows = ids.groupBy("__key").agg(F.min("__id").alias("__id"), F.count("*").alias("__rows"))
    known = stage(groups.join(rows, "__key"), "groups")
    first = F.min(F.struct(F.col("__id"), F.col("__key"))).alias("first")
    chosen = known.df.groupBy("component_id").agg(first).select(F.col("first.__key").alias("__key"))
    kept = stage(chosen.join(known.df.select("__key", "__rows"), "__key"), "kept")
    held = docs.withColumn("__key", _row_key())
    single = held.join(kept.df.where("__rows = 1").select("__key"), "__key", "left_semi")
    several = held.join(kept.df.where("__rows > 1").select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return single.unionByName(several).select(*_columns(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text overlaps with an item of the benchmark, and no other row of their id."""
    found = contaminated(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = stage(found.select(F.col("doc_id").alias("__key")).distinct(), "leaked")
    return docs.withColumn("__key", _row_key()).join(leaked.df, "__key", "left_anti").select(*_columns(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Compression, similarity and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = None
    for name, function in STAGES:
        kept = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if previous is not None:
            previous.drop()
        docs, previous = kept.df, kept
    return docs
