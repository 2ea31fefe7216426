"""Errors come from passes and layouts that a run has anyway, and passes are compiled."""

import pytest
from pyspark.sql import functions as F

from ratingloom import Engine, RunConfig, fit
from ratingloom.operators import factors, gradients, metrics
from ratingloom.operators.skew import hot_keys
from ratingloom.plans import grid, strata, training
from ratingloom.plans.runs import RunState, Run, batch_step

WIDTH = 3


def _ratings(spark, rows=300):
    return spark.range(rows).select(
        F.col("id").alias("rec_id"), (F.col("id") * F.col("id") % 7).cast("int").alias("user_id"),
        (F.col("id") % 11).cast("int").alias("item_id"), (1.0 + F.col("id") % 5).alias("rating"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _count_passes(monkeypatch):
    passes = []
    plain = metrics.square_error
    monkeypatch.setattr(training, "square_error", lambda *args: passes.append(1) or plain(*args))
    return passes


def test_batch_descent_tells_errors_on_its_way(spark, monkeypatch):
    ratings = _ratings(spark)
    def config(epochs):
        return RunConfig(gd_mode=0, num_features=WIDTH, learning_rate=0.01, max_num_iterations=epochs, precision=2, show_train_rmse=1)
    passes = _count_passes(monkeypatch)
    rows = fit(ratings, None, config(3), Engine(init="mix")).metrics.orderBy("iter").collect()
    assert len(passes) == 1
    alone = [fit(ratings, None, config(n), Engine(init="mix")) for n in range(4)]
    expected = [metrics.square_error(ratings, model.state).first().rmse for model in alone]
    assert [row.train_rmse for row in rows] == pytest.approx(expected, rel=1e-12)
    assert alone[3].state.columns == ["side", "id", "features"]


def test_grid_gradients_tell_errors(spark):
    ratings = _ratings(spark).withColumn("rating", F.when(F.col("rec_id") % 9 > 0, F.col("rating")))
    state = factors.init_state(spark, 7, 10, WIDTH)
    sums = [F.sum("square").alias("square"), F.sum("rated").alias("rated")]
    expected = metrics.square_error(ratings, state).first()
    for found in (grid.grid_gradients(grid.grid_ratings(ratings, 2), state, WIDTH), gradients.gradient_sums(ratings, state, WIDTH)):
        total = found.agg(*sums).first()
        assert total.rated == expected.num_records
        assert total.square == pytest.approx(expected.square_error_sum, rel=1e-12)


def test_strata_score_their_own_blocks(spark, monkeypatch):
    ratings = _ratings(spark)
    passes = _count_passes(monkeypatch)
    config = RunConfig(gd_mode=2, num_features=WIDTH, max_num_iterations=1, precision=2, show_train_rmse=1)
    model = fit(ratings, None, config, Engine(init="mix", blocks=3))
    assert not passes
    assert model.metrics.orderBy("iter").collect()[1].train_rmse == pytest.approx(
        metrics.square_error(ratings, model.state).first().rmse, rel=1e-12)


def test_copies_of_split_rows_are_scored(spark):
    ratings = _ratings(spark).withColumn("pos", F.col("rec_id"))
    laid = strata.BlockedRatings.of(ratings, 2, min_split=20, split_hot=True)
    assert laid.split
    state = factors.init_state(spark, 7, 11, WIDTH)
    found, expected = strata.square_error(laid, state, WIDTH).first(), metrics.square_error(ratings, state).first()
    assert found.num_records == expected.num_records
    assert found.rmse == pytest.approx(expected.rmse, rel=1e-12)


def test_narrow_passes_have_no_lambdas(spark):
    ratings, state = _ratings(spark), factors.init_state(spark, 7, 11, WIDTH).localCheckpoint()
    assert "lambda" not in _plan(gradients.gradient_sums(ratings, state, WIDTH))
    assert "lambda" not in _plan(metrics.square_error(ratings, state, None, WIDTH))


def test_batch_steps_of_runs(spark):
    ratings = _ratings(spark)
    runs = [Run(name, RunConfig(gd_mode=0, num_features=width, learning_rate=0.02, precision=precision, max_num_iterations=1))
            for name, width, precision in (("a", 2, 2), ("b", 3, 1))]
    state = RunState.initial(spark, runs, 5, 11, "mix")
    moved = RunState(runs, batch_step(state, ratings, factors.RatingSkew()))
    for run in runs:
        alone = fit(ratings, None, run.config, Engine(init="mix")).state
        want = {(r.side, r.id): r.features for r in alone.collect()}
        for row in moved.of(run).collect():
            assert row.features == pytest.approx(want[row.side, row.id], rel=1e-6)


def test_hot_keys_are_sought_in_full_slots(spark):
    keys = spark.range(1000).select(F.when(F.col("id") < 400, 3).when(F.col("id") < 500, None).otherwise(F.col("id")).alias("key"))
    found = hot_keys(keys, "key", min_rows=90)
    assert "_slot" in _plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == [(3, 5), (None, 2)]
