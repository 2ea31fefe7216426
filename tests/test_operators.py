from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import serial
from ratingloom.functions.half import to_half
from ratingloom.functions.number_text import general_format
from ratingloom.operators import factors, metrics, ordering, profiles
from ratingloom.operators.skew import hot_keys


def test_half_rounding_matches_ieee(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([
        rng.normal(size=2000), rng.normal(size=2000) * 1e-6, rng.uniform(-7e4, 7e4, 2000), 2.0 ** np.arange(-26, 17),
        [0.0, -0.0, 65503.9, 65519.99, 65520.0, -65520.0, 1e9, np.inf, -np.inf, 2.0**-24, 2.0**-25, 3 * 2.0**-25]])
    table = spark.createDataFrame([(n, float(v)) for n, v in enumerate(values)], "n int, v double")
    got = np.array([r.h for r in table.select("n", to_half(F.col("v")).alias("h")).orderBy("n").collect()])
    with np.errstate(over="ignore"):
        expected = values.astype(np.float16).astype(np.float64)
    np.testing.assert_array_equal(got, expected)
    nan = spark.range(1).select(to_half(F.lit(float("nan"))).alias("h")).first().h
    assert np.isnan(nan)


@pytest.mark.parametrize("digits, width", [(2, 10), (6, 0)])
def test_number_text_matches_c(spark, digits, width):
    rng = np.random.default_rng(2)
    values = np.concatenate([
        rng.normal(size=500), 10 ** rng.uniform(-9, 9, 500), -(10 ** rng.uniform(-9, 9, 500)),
        [0.0, -0.0, 0.125, 0.375, 0.5, 1, 5, 10, 12.5, 99.5, 99.4, 100, 123456, 1234567, 0.0001, 0.00009999, 1e-5,
         9.96e-5, 3.5, np.inf, -np.inf, np.nan]]).astype(np.float32)
    table = spark.createDataFrame([(n, float(v)) for n, v in enumerate(values)], "n int, v double")
    got = [r.t for r in table.select("n", general_format(F.col("v"), digits, width).alias("t")).orderBy("n").collect()]
    assert got == [f"%{width or ''}.{digits}g" % v for v in values]


@pytest.mark.parametrize("method", ["mix", "hash"])
def test_shuffle_is_a_seeded_permutation(spark, method):
    table = spark.range(3000).withColumnRenamed("id", "rec_id")
    runs = []
    for seed, partitions in ((1, 3), (1, 7), (2, 3)):
        placed = ordering.shuffled_positions(table.repartition(partitions), "rec_id", seed, method=method)
        runs.append([r.rec_id for r in placed.orderBy("pos").collect()])
        assert [r.pos for r in placed.orderBy("pos").select("pos").collect()] == list(range(3000))
    assert runs[0] == runs[1] != runs[2]
    assert sorted(runs[0]) == list(range(3000)) != runs[0]


def test_positions_over_many_sub_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SUB_BUCKET_BITS", 5)
    table = spark.range(12000).withColumnRenamed("id", "rec_id")
    placed = ordering.shuffled_positions(table, "rec_id", 4).orderBy("pos").collect()
    expected = sorted(range(12000), key=lambda n: ((n * 7919 + 4) % 10007, n))
    assert [(r.rec_id, r.pos) for r in placed] == [(n, pos) for pos, n in enumerate(expected)]


def test_range_positions_follow_the_order(spark):
    rng = np.random.default_rng(4)
    # One key holds half of the rows; the full order is still unique.
    rows = [(int(a) if a > 5 else 0, n, int(b)) for n, (a, b) in enumerate(rng.integers(0, 11, (500, 2)))]
    table = spark.createDataFrame(rows, "a int, n int, b int")
    placed = ordering.range_positions(table, ["a", "n"], ["n"], partitions=6).df.orderBy("rec_id").collect()
    assert [(r.rec_id, r.n) for r in placed] == [(k, n) for k, (_, n, _) in enumerate(sorted(rows))]


@pytest.mark.parametrize("method", ["mix", "hash"])
def test_user_offsets(make_ratings, method):
    ratings = make_ratings([(u % 7 * 3, u % 5, 1.0) for u in range(100)])
    placed = ordering.user_offsets(ratings, 25, 3, method).orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(25)) and sorted(r.user_id for r in placed) == list(range(25))
    base = 0
    for r in placed:
        assert r.base == base and r.cnt == (sum(u % 7 * 3 == r.user_id for u in range(100)))
        base += r.cnt
    assert base == 100
    counts = {r.user_id: r.cnt for r in profiles.user_counts(ratings, 25).collect()}
    assert counts == {r.user_id: r.cnt for r in placed}


def test_batches_with_a_short_last_one(spark):
    table = spark.range(10).withColumnRenamed("id", "pos")
    sizes = {r.batch: r["count"] for r in ordering.batch_numbers(table, 4).groupBy("batch").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 2}


def test_dedupe_and_profiles(make_ratings):
    ratings = make_ratings([(1, 5, 3.0), (0, 2, 1.0), (1, 5, 4.5), (1, 2, 2.0), (0, 2, 5.0)])
    latest = {(r.user_id, r.item_id): r.rating for r in profiles.dedupe_last(ratings).collect()}
    assert latest == {(1, 5): 4.5, (0, 2): 5.0, (1, 2): 2.0}
    maps = {(r.user_id, r.part): r.profile for r in profiles.user_profiles(ratings).collect()}
    assert maps == {(0, 0): {2: 5.0}, (1, 0): {2: 2.0, 5: 4.5}}
    texts = [r.text for r in profiles.profile_text(ratings).orderBy("user_id").collect()]
    assert texts == ["0 1 2 5", "1 2 2 2 5 4.5"]


def test_long_profiles_are_split_by_item_range(make_ratings):
    ratings = make_ratings([(0, i, i % 5 + 1) for i in range(3, 40)] + [(1, 7, 2.0)])
    parts = profiles.user_profiles(ratings, max_entries=10).orderBy("user_id", "part").collect()
    assert all(len(r.profile) <= 10 for r in parts)
    merged = {}
    for r in parts:
        if r.user_id == 0:
            assert not merged or max(merged) < min(r.profile)
            merged |= r.profile
    assert merged == {i: float(i % 5 + 1) for i in range(3, 40)}
    lines = profiles.profile_text(ratings, max_entries=10).where("user_id = 0").orderBy("part").collect()
    assert " ".join(r.text for r in lines) == "0 37 " + " ".join(f"{i} {i % 5 + 1}" for i in range(3, 40))


def test_dimensions(spark, make_ratings):
    assert tuple(profiles.dimensions(make_ratings([(3, 9, 1.0), (0, 2, 2.0)])).first()) == (4, 10, 2)
    assert tuple(profiles.dimensions(make_ratings([])).first()) == (0, 0, 0)


def test_initial_factors(spark):
    state = factors.init_state(spark, 5, 4, 3, accumulators=True)
    p, q = serial.matrices(state, 5, 4, 3)
    np.testing.assert_allclose(p, serial.initial(5, 3, 1), atol=1e-15)
    np.testing.assert_allclose(q, serial.initial(4, 3, 2), atol=1e-15)
    assert all(r.acc == [0.0] * 3 for r in state.collect())
    hashed, _ = serial.matrices(factors.init_state(spark, 2000, 1, 3, "hash"), 2000, 1, 3)
    assert hashed.min() >= 0 and hashed.max() < 0.1 and abs(hashed.mean() - 0.05) < 0.002
    assert len(np.unique(hashed)) == 6000


def test_single_precision_prediction_keeps_float_products(spark, make_ratings):
    state = factors.init_state(spark, 3, 3, 8, precision="single")
    p, q = serial.matrices(state, 3, 3, 8)
    got = factors.predict(make_ratings([(1, 2, 3.0)]), state).first().prediction
    products = p[1].astype(np.float32) * q[2].astype(np.float32)
    assert products.dtype == np.float32
    assert got == sum(products.astype(np.float64).tolist())


def test_hot_keys_are_few_and_need_many_rows(spark, make_ratings):
    ratings = make_ratings([(0, n, 1.0) for n in range(100)] + [(n, 0, 1.0) for n in range(1, 50)])
    assert [tuple(r) for r in hot_keys(ratings, "user_id", min_rows=30).collect()] == [(0, 4)]
    assert hot_keys(ratings, "user_id", min_rows=1, max_keys=1).count() <= 1
    assert hot_keys(ratings, "user_id").count() == 0


def test_epochs_to_target(spark):
    trace = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 2.0), ("a", 2, 1.0), ("b", 0, 5.0)],
                                  "dataset string, iter int, test_rmse double")
    goals = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "dataset string, target_rmse double")
    assert sorted(map(tuple, metrics.epochs_to_target(trace, goals).collect())) == [("a", 2.0, 1), ("b", 1.0, None)]


def test_rebase(make_ratings):
    row = profiles.rebase_ids(make_ratings([(1, 5, 2.0)]), 1).first()
    assert (row.user_id, row.item_id) == (0, 4)
