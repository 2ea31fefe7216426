"""Run configurations and quality targets from text files."""

from __future__ import annotations

import warnings
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.config import RunConfig

KEYS = {f.name: ("double" if f.type == "float" else "int") for f in fields(RunConfig)}


def _words(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(run, words, line_id)`` of all lines that are neither blank nor ``#`` or ``%`` comments."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("run"))
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    content = text.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").rlike("^[#%]"))
    return content.select("run", F.split("line", " ").alias("words"),
                          F.monotonically_increasing_id().alias("line_id"))


def read_run_configs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``run`` (the file's name) and the eleven parameters, defaults filled in.

    The last line of a key counts. Unknown keys are ignored; ``unknown_keys`` lists them.
    """
    pairs = _words(spark, path).select(
        "run", "line_id", F.col("words")[0].alias("key"), F.get("words", F.lit(1)).alias("text"))
    # Files without a known key still make a row, with all defaults.
    wide = pairs.groupBy("run").pivot("key", list(KEYS)).agg(F.max_by("text", "line_id"))
    defaults = RunConfig().to_dict()
    return wide.select("run", *[
        F.coalesce(F.col(name).cast(kind), F.lit(defaults[name]).cast(kind)).alias(name)
        for name, kind in KEYS.items()])


def unknown_keys(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(run, key)`` of configuration lines whose key is not a parameter."""
    keys = _words(spark, path).select("run", F.col("words")[0].alias("key"))
    return keys.where(~F.col("key").isin(list(KEYS))).distinct()


def read_run_config(spark: SparkSession, path: str) -> RunConfig:
    """The configuration of one file. A missing file means the defaults, with a warning."""
    from pyspark.errors import AnalysisException
    try:
        rows = read_run_configs(spark, path).take(2)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"configuration file {path!r} not found; using defaults", stacklevel=2)
        return RunConfig()
    if len(rows) > 1:
        raise ValueError(f"{path!r} holds several configurations; use read_run_configs")
    unknown = sorted(row.key for row in unknown_keys(spark, path).collect())  # the keys of one file
    if unknown:
        warnings.warn(f"{len(unknown)} unrecognized configuration keys in {path!r}: {', '.join(unknown)}", stacklevel=2)
    return RunConfig.from_row(rows[0]) if rows else RunConfig()


def read_targets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(dataset, target_rmse)`` from lines of a name and a number."""
    return _words(spark, path).select(
        F.col("words")[0].alias("dataset"), F.get("words", F.lit(1)).try_cast("double").alias("target_rmse"))
