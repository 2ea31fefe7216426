"""Large wide tables are streamed: each factor row is written and shuffled once a side, whatever the number of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom import Engine, RunConfig, fit
from ratingloom.operators import factors, metrics
from ratingloom.operators.gradients import gradient_sums
from ratingloom.plans import batch_gd, feature_shards, grid, streamed
from ratingloom.session import Folder, shared_root

WIDTH = 70


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _values(state):
    return {(r.side, r.id): r.features for r in state.collect()}


def _close(found, expected):
    assert found.keys() == expected.keys()
    assert all(np.allclose(found[key], expected[key], rtol=0, atol=1e-12) for key in found)


@pytest.fixture(params=["even", "hot"])
def ratings(request, make_ratings, monkeypatch):
    """With null ratings, ids unknown to the model, rows without ratings and, if hot, ids that lie in several blocks."""
    monkeypatch.setattr(grid, "MIN_JOIN_BYTES", 0)
    monkeypatch.setattr(grid, "MAX_COPIED_BYTES", 0)
    if request.param == "hot":
        monkeypatch.setattr(streamed, "MIN_SPLIT_RECORDS", 10)
    rng = np.random.default_rng(4)
    made = make_ratings(zip(rng.integers(0, 30, 400), rng.integers(0, 25, 400), rng.integers(1, 6, 400)))
    number = F.col("rec_id")
    return made.withColumns({"rating": F.when(number % 50 != 5, F.col("rating")),
                             "user_id": F.when(number % 3 == 0, 2).when(number != 9, F.col("user_id")),
                             "item_id": F.when(number % 4 == 0, 3).when(number != 10, F.col("item_id"))})


@pytest.mark.parametrize("num_users,num_items", [(29, 40), (40, 24)])
def test_streamed_predictions(spark, ratings, num_users, num_items):
    state = factors.init_state(spark, num_users, num_items, WIDTH)
    scored = factors.predict(ratings, state, width=WIDTH)
    assert "MapInArrow" in _plan(scored) and "CoGroup" not in _plan(scored)
    expected = {r.rec_id: r for r in factors.predict(ratings, state).select(scored.columns).collect()}
    found = {r.rec_id: r for r in scored.collect()}
    assert found.keys() == expected.keys() and len(found) > 300
    for key, row in found.items():
        assert row[:4] == expected[key][:4] and abs(row.prediction - expected[key].prediction) < 1e-12
        assert (row.residual is None) == (expected[key].residual is None) == (key % 50 == 5)


@pytest.mark.parametrize("precision", ["double", "single"])
def test_streamed_epoch(spark, ratings, precision):
    state = factors.init_state(spark, 29, 40, WIDTH, precision=precision)
    stepped = batch_gd.gd_epoch(ratings, state, WIDTH, 0.02, 0.05, precision, carry=("square", "rated"))
    assert "MapInArrow" in _plan(stepped) and "CoGroup" not in _plan(stepped)
    assert stepped.select("side", "id", "features").dtypes == state.dtypes
    rated = ratings.where(F.col("rating").isNotNull())
    plain = factors.apply_step(state, gradient_sums(rated, state, WIDTH), 0.02, 0.05, precision)
    found, expected = _values(stepped), _values(plain)
    assert found.keys() == expected.keys()
    for key in found:
        assert np.allclose(found[key], expected[key], rtol=0, atol=1e-12 if precision == "double" else 1e-7)
    error = metrics.square_error(rated, state).first()
    total = stepped.agg(F.sum("square").alias("square"), F.sum("rated").alias("rated")).first()
    assert total.rated == error.num_records
    assert total.square == pytest.approx(error.square_error_sum, rel=1e-12 if precision == "double" else 1e-6)


@pytest.mark.parametrize("slice_width", [4, 11])
def test_streamed_slices(spark, ratings, slice_width):
    rated = ratings.where(F.col("rating").isNotNull())
    state = factors.init_state(spark, 29, 40, 11)
    done = feature_shards.sharded_epoch(rated, feature_shards.sliced(state, slice_width), slice_width, 0.02, 0.05)
    plain = factors.apply_step(state, gradient_sums(rated, state, 11), 0.02, 0.05)
    _close(_values(feature_shards.joined_slices(done)), _values(plain))


def test_rows_without_a_rating_known(spark, make_ratings):
    """Of an id all of whose ratings are null a slice has no values; ids without ratings keep theirs."""
    ratings = make_ratings([(0, 0, 3), (1, 0, 4)]).withColumn("rating", F.when(F.col("user_id") == 0, F.col("rating")))
    slices = feature_shards.sliced(factors.init_state(spark, 3, 1, 5), 3)
    before = {(r.side, r.id, r.shard): r.features for r in slices.collect()}
    done = {(r.side, r.id, r.shard): r.features for r in feature_shards.sharded_epoch(ratings, slices, 3, 0.02, 0.05).collect()}
    assert done[0, 1, 0] == [None] * 3 and done[0, 1, 1] == [None] * 2
    assert done[0, 2, 0] == before[0, 2, 0] and done[0, 0, 1] != before[0, 0, 1] and None not in done[1, 0, 1]


def test_rows_travel_once_whatever_the_blocks(spark, make_ratings, monkeypatch):
    monkeypatch.setattr(grid, "MIN_JOIN_BYTES", 0)
    monkeypatch.setattr(grid, "MAX_COPIED_BYTES", 0)
    rng = np.random.default_rng(5)
    ratings = make_ratings(zip(rng.integers(0, 300, 9000), rng.integers(0, 300, 9000), rng.integers(1, 6, 9000)))
    state = factors.init_state(spark, 300, 300, 128, "hash")
    context = spark.sparkContext._jsc.sc()

    def shuffled(blocks):
        monkeypatch.setattr(streamed, "num_blocks", lambda *_: blocks)
        monkeypatch.setattr(grid, "grid_size", lambda *_: blocks)
        context.listenerBus().waitUntilEmpty()
        before = context.statusStore().executorSummary("driver").totalShuffleWrite()
        moved = batch_gd.gd_epoch(ratings, state, 128, 0.02, 0.05)
        moved.write.format("noop").mode("overwrite").save()
        slices = feature_shards.sliced(state, 32)
        feature_shards.sharded_epoch(ratings, slices, 32, 0.02, 0.05).write.format("noop").mode("overwrite").save()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite() - before

    few, many = shuffled(2), shuffled(8)
    assert many < 1.5 * few
    # Twice: whole rows and slices. A rating takes some bytes, and never a row.
    assert many < 2 * (600 * 128 * 8 * 1.2 + 2 * 9000 * 64)


def test_wide_training_leaves_no_rows_behind(spark, ratings):
    def lying():
        return {name for name in Folder(spark, f"{shared_root(spark)}/ratingloom").names() if name.startswith("streamed-rows")}

    before = lying()
    rated = ratings.where(F.col("rating").isNotNull() & F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    config = RunConfig(gd_mode=0, num_features=WIDTH, learning_rate=0.01, max_num_iterations=2, precision=2)
    model = fit(rated, None, config, Engine(init="mix"))
    state = factors.init_state(spark, 30, 25, WIDTH)
    for _ in range(2):
        state = factors.apply_step(state, gradient_sums(rated, state, WIDTH), 0.01, config.regularization_factor).localCheckpoint()
    _close(_values(model.state), _values(state))
    assert lying() == before


def test_blocks_are_bounded():
    assert streamed.num_blocks(0, 0, 8) == 8
    assert streamed.num_blocks(216_000_000, 5_400_000 * 1024, 8) == 56
    assert streamed.num_blocks(1000, 1000 * streamed.MAX_OWN_BYTES, 8) == 1000
