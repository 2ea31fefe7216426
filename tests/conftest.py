from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_ratings(spark):
    """Build a ratings table from ``(user, item, rating)`` triples, numbered in order."""
    def build(triples):
        rows = [(n, int(u), int(i), float(r)) for n, (u, i, r) in enumerate(triples)]
        return spark.createDataFrame(rows, "rec_id long, user_id int, item_id int, rating double")
    return build
