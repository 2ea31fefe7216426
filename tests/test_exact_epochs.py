"""Queries of sequential descent fold all records one by one, whatever share of them one id has."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ratingloom.plans import strata

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", ["sgd_epoch", "train_trace"])
def test_frequent_ids_are_not_split(spark, monkeypatch, name):
    plain, build, split = entry.fixtures.train, strata.BlockedRatings.of.__func__, []

    def skewed(spark, sf_dir):
        # Half of the records are of one user; few records, so the least number of a split row is lowered, too.
        hot = F.when(F.col("rec_id") % 2 == 0, 0).otherwise(F.col("user_id")).cast("int")
        return plain(spark, sf_dir).where("rec_id < 600").withColumn("user_id", hot)

    def of(cls, *args, **options):
        ratings = build(cls, *args, **{**options, "min_split": 10})
        split.append(ratings.split)
        return ratings

    monkeypatch.setattr(entry.fixtures, "train", skewed)
    monkeypatch.setattr(strata.BlockedRatings, "of", classmethod(of))
    entry.queries()[name](spark, SF_DIR).count()
    assert split == [False]
