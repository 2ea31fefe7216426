"""Sinks that show all of their files or none."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ratingloom import fixtures, read_ratings
from ratingloom.operators import profiles
from ratingloom.sources import part_files
from ratingloom.sources.factor_text import write_factor_text


@F.udf(StringType())
def breaking(value):
    if value == "57":
        raise ValueError("lost")
    return value


@pytest.mark.parametrize("layout", ["narrow", "wide"])
def test_binary_round_trip(spark, tmp_path, make_ratings, layout):
    records = make_ratings([(n % 7, n % 5, float(n % 3)) for n in range(100)])
    path = fixtures.write_coo_binary(records, profiles.dimensions(records).first(), str(tmp_path / "r.bin"), layout,
                                     {"narrow": 0, "wide": 1}[layout], files=3)
    assert sorted(os.listdir(path)) == [f"part-{k:05d}.bin" for k in range(3)] and os.listdir(tmp_path) == ["r.bin"]
    back = read_ratings(spark, path, layout=layout).require_valid().ratings
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))


def test_failed_task_leaves_nothing(spark, tmp_path):
    part_files.register(spark)
    lines = spark.range(0, 100, 1, 4).select(breaking(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="lost"):
        lines.write.format("line_files").mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_single_file_is_ordered(spark, tmp_path):
    rows = [(n, [n / 8.0, -1.0]) for n in range(30)]
    factors = spark.createDataFrame(rows, "id int, features array<double>").repartition(5)
    path = write_factor_text(factors, str(tmp_path), "user", single=True)
    assert os.path.isfile(path) and os.listdir(tmp_path) == [os.path.basename(path)]
    lines = open(path).read().splitlines()
    assert [float(line.split()[0]) for line in lines] == [float(f"{n / 8.0:.2g}") for n in range(30)]
    folder = write_factor_text(factors, str(tmp_path / "parts"), "user")
    names = sorted(os.listdir(folder))
    assert "".join(open(f"{folder}/{n}").read() for n in names).splitlines() == lines


def test_empty_tables(spark, tmp_path):
    part_files.register(spark)
    none = spark.createDataFrame([], "value string")
    none.write.format("line_files").mode("append").save(str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []
    none.coalesce(1).write.format("line_files").mode("append").option("single", "true").save(str(tmp_path / "one.txt"))
