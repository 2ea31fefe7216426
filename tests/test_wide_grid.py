"""Wide rows meet the ratings on a grid, and tasks that run many parts stay bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.operators import factors
from ratingloom.operators.gradients import gradient_sums
from ratingloom.plans import batch_gd, exchange, grid, local_sgd, parts

WIDTH = 70


@pytest.fixture
def ratings(make_ratings, monkeypatch):
    monkeypatch.setattr(grid, "MIN_JOIN_BYTES", 0)
    rng = np.random.default_rng(3)
    made = make_ratings(zip(rng.integers(0, 9, 200), rng.integers(0, 8, 200), rng.integers(1, 6, 200)))
    number = F.col("rec_id")
    return made.withColumns({"rating": F.when(number != 5, F.col("rating")),
                             "user_id": F.when(number != 9, F.col("user_id"))})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_predictions_come_from_cells(spark, ratings):
    state = factors.init_state(spark, 9, 7, WIDTH)
    scored = factors.predict(ratings, state, width=WIDTH)
    assert "FlatMapCoGroupsInArrow" in _plan(scored)
    plain = factors.predict(ratings, state).select(scored.columns)
    expected = {r.rec_id: r for r in plain.collect()}
    found = {r.rec_id: r for r in scored.collect()}
    assert found.keys() == expected.keys() and 9 not in found
    for key, row in found.items():
        assert row[:4] == expected[key][:4] and abs(row.prediction - expected[key].prediction) < 1e-12
        assert (row.residual is None) == (expected[key].residual is None) == (key == 5)


def test_wide_epoch_sums_in_cells(spark, ratings):
    state = factors.init_state(spark, 9, 8, WIDTH)
    rated = ratings.where(F.col("rating").isNotNull())
    stepped = batch_gd.gd_epoch(rated, state, WIDTH, 0.02, 0.05)
    assert "FlatMapCoGroupsInArrow" in _plan(stepped)
    plain = factors.apply_step(state, gradient_sums(rated, state, WIDTH), 0.02, 0.05)
    expected = {(r.side, r.id): r.features for r in plain.collect()}
    found = {(r.side, r.id): r.features for r in stepped.collect()}
    assert found.keys() == expected.keys()
    assert all(np.allclose(found[key], expected[key], rtol=0, atol=1e-12) for key in found)


def test_chunks_are_bounded_in_bytes():
    assert exchange.BlockScore(4).chunk == exchange.SCORE_CHUNK
    assert exchange.BlockScore(128).chunk * 128 * 8 == exchange.SCORE_BYTES


def test_tasks_of_many_parts_grow_in_number(spark, make_ratings, monkeypatch):
    monkeypatch.setattr(parts, "MAX_TASK_RECORDS", 10, raising=False)
    records = make_ratings([(n % 17, n % 13, 3) for n in range(400)]).withColumn("pos", F.col("rec_id"))
    laid_out = parts.PartedRatings.of(local_sgd.parts_by_record(records, 4))
    assert laid_out.num_parts == 100 and laid_out.records.rdd.getNumPartitions() == 40
