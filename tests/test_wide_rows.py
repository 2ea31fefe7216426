"""Feature slices, two-byte rows and the minimal standard start."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.functions import half_rows
from ratingloom.functions.half import rounded_features
from ratingloom.operators import factors
from ratingloom.plans import batch_gd, feature_shards, strata

WIDTH = 11


@pytest.fixture
def ratings(make_ratings):
    rng = np.random.default_rng(8)
    return make_ratings(zip(rng.integers(0, 19, 300), rng.integers(0, 13, 300), rng.integers(1, 6, 300)))


def values(state):
    return {(r.side, r.id): r.features for r in state.collect()}


@pytest.mark.parametrize("slice_width", [1, 4, 11, 50])
def test_sharded_epoch_equals_whole_rows(spark, ratings, slice_width):
    state = factors.init_state(spark, 20, 13, WIDTH)
    slices = feature_shards.sliced(state, slice_width)
    assert max(len(r.features) for r in slices.collect()) <= slice_width
    done = feature_shards.sharded_epoch(ratings, slices, slice_width, 0.02, 0.05)
    whole, expected = values(feature_shards.joined_slices(done)), values(batch_gd.gd_epoch(ratings, state, WIDTH, 0.02, 0.05))
    assert whole.keys() == expected.keys()
    for key in whole:
        assert np.allclose(whole[key], expected[key], rtol=0, atol=1e-12)


def test_sharded_errors_equal_plain_ones(spark, ratings):
    state = factors.init_state(spark, 20, 13, WIDTH)
    plain = {r.rec_id: r.residual for r in factors.predict(ratings, state).collect()}
    found = feature_shards.errors(ratings, feature_shards.sliced(state, 3)).collect()
    assert len(found) == 300 and all(abs(plain[r.rec_id] - r.residual) < 1e-12 for r in found)


def test_packed_rows_come_back(spark):
    rows = [(1, [0.0, 1.5, -2.0 ** -24, 65504.0]), (2, []), (3, [float("inf"), 0.1])]
    table = spark.createDataFrame(rows, "id int, features array<float>").select(
        "id", rounded_features(F.col("features"), "half").alias("features"))
    packed = half_rows.packed(table, ["features"])
    assert {r.id: len(r.features) for r in packed.collect()} == {1: 8, 2: 0, 3: 4}
    assert sorted(half_rows.unpacked(packed, ["features"]).collect()) == sorted(table.collect())


def _shuffled(spark, work):
    """Bytes that ``work`` wrote to the shuffle."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    work()
    return total() - before


def _stored(spark, path):
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return system.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(system).getLength()


@pytest.mark.parametrize("rule", ["sgd", "adagrad"])
def test_half_rows_move_half_the_bytes(spark, ratings, rule):
    rng = np.random.default_rng(1)
    rows = [(side, n, rng.random(128).astype(np.float32).astype(float).tolist()) for side in (0, 1) for n in range(900)]
    singles = spark.createDataFrame(rows, "side int, id int, features array<float>")
    if rule == "adagrad":
        singles = singles.withColumn("acc", F.col("features"))
    placed = ratings.withColumn("pos", F.col("rec_id"))
    moved, stored = {}, {}
    for precision in ("half", "single"):
        laid_out = strata.BlockedRatings.of(placed, 2, precision)
        lists = [rounded_features(F.col(c), precision).alias(c) for c in singles.columns[2:]]
        state, done = singles.select("side", "id", *lists), []
        moved[precision] = _shuffled(spark, lambda: done.append(
            strata.stratified_epoch(laid_out, state, rule, 128, 0.02, 0.05, precision)))
        stored[precision] = _stored(spark, done[0].path)
    assert moved["half"] <= 0.6 * moved["single"]
    assert stored["half"] <= 0.6 * stored["single"]


def test_parity_start(spark):
    """Both sides draw from the first number on, in row order."""
    width, draws, seed = 5, [], 1
    for _ in range(9 * width):
        seed = seed * 16807 % 2147483647
        draw = np.float32(seed - 1) / np.float32(2147483646.0)
        draws.append(np.float32(min(draw, np.nextafter(np.float32(1), np.float32(0))) * np.float32(0.1)))
    state = factors.init_state(spark, 9, 6, width, "parity", "single")
    for row in state.collect():
        assert row.features == [float(v) for v in draws[row.id * width: (row.id + 1) * width]]


def test_parity_jumps_far(spark):
    from ratingloom.functions.mixing import parity_values
    row = spark.range(10 ** 12, 10 ** 12 + 1).select(parity_values(F.col("id"), 2).alias("v")).first()
    first = pow(16807, 2 * 10 ** 12 + 1, 2147483647)
    expected = np.float32(np.float32(first - 1) / np.float32(2147483646.0)) * np.float32(0.1)
    assert row.v[0] == float(np.float32(expected))
