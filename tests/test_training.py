from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import serial
from ratingloom import Engine, RunConfig, fit
from ratingloom.operators import factors, ordering, profiles
from ratingloom.operators.gradients import gradient_sums
from ratingloom.operators.metrics import square_error
from ratingloom.plans import batch_gd, grid, local_sgd, strata
from ratingloom.plans.kernels import wave_numbers
from ratingloom.plans.parts import PartedRatings
from ratingloom.session import stage

USERS, ITEMS, WIDTH = 23, 17, 3


@pytest.fixture(scope="module")
def triples():
    rng = np.random.default_rng(7)
    return [(int(u), int(i), float(r)) for u, i, r in
            zip(rng.integers(0, USERS, 400), rng.integers(0, ITEMS, 400), rng.integers(1, 6, 400))]


@pytest.fixture
def state(spark):
    return factors.init_state(spark, USERS, ITEMS, WIDTH)


def positioned(ratings):
    return ratings.withColumn("pos", F.col("rec_id"))


def stratum_order(triples, blocks):
    """Record numbers in (stratum, block, position) order."""
    ub = serial.block([t[0] for t in triples], 0, blocks)
    ib = serial.block([t[1] for t in triples], 0, blocks)
    return sorted(range(len(triples)), key=lambda n: ((ib[n] - ub[n]) % blocks, ub[n], n))


def start():
    return serial.initial(USERS, WIDTH, 1), serial.initial(ITEMS, WIDTH, 2)


def test_waves_keep_serial_order():
    rng = np.random.default_rng(3)
    users, items = rng.integers(0, 9, 200), rng.integers(0, 5, 200)
    waves = wave_numbers(users, items)
    for n in range(200):
        earlier = [m for m in range(n) if users[m] == users[n] or items[m] == items[n]]
        assert waves[n] == 1 + max([waves[m] for m in earlier], default=0)
    assert len(wave_numbers(users[:0], items[:0])) == 0


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_stratified_sgd_equals_serial(make_ratings, triples, state, blocks):
    ratings = strata.BlockedRatings.of(positioned(make_ratings(triples)), blocks)
    done = strata.stratified_epoch(ratings, state, "sgd", WIDTH, 0.05, 0.02).df
    p, q = start()
    serial.sgd([triples[n] for n in stratum_order(triples, blocks)], p, q, 0.05, 0.02)
    got_p, got_q = serial.matrices(done, USERS, ITEMS, WIDTH)
    np.testing.assert_allclose(got_p, p, atol=1e-12)
    np.testing.assert_allclose(got_q, q, atol=1e-12)


def test_state_is_written_between_long_runs_of_strata(make_ratings, triples, state, monkeypatch):
    monkeypatch.setattr(strata, "STRATA_PER_JOB", 2)
    ratings = strata.BlockedRatings.of(positioned(make_ratings(triples)), 5)
    done = strata.stratified_epoch(ratings, state, "sgd", WIDTH, 0.05, 0.02).df
    p, q = start()
    serial.sgd([triples[n] for n in stratum_order(triples, 5)], p, q, 0.05, 0.02)
    np.testing.assert_allclose(serial.matrices(done, USERS, ITEMS, WIDTH)[0], p, atol=1e-12)


def test_stratified_adagrad_equals_serial_over_epochs(spark, make_ratings, triples):
    ratings = strata.BlockedRatings.of(positioned(make_ratings(triples)), 2, cache=True)
    table = factors.init_state(spark, USERS, ITEMS, WIDTH, accumulators=True)
    p, q = start()
    pa, qa = np.zeros_like(p), np.zeros_like(q)
    for _ in range(2):
        table = strata.stratified_epoch(ratings, table, "adagrad", WIDTH, 0.1, 0.05).df
        serial.adagrad([triples[n] for n in stratum_order(triples, 2)], p, q, pa, qa, 0.1, 0.05)
    ratings.release()
    for column, (users, items) in {"features": (p, q), "acc": (pa, qa)}.items():
        got_p, got_q = serial.matrices(table, USERS, ITEMS, WIDTH, column)
        np.testing.assert_allclose(got_p, users, atol=1e-10)
        np.testing.assert_allclose(got_q, items, atol=1e-10)


def test_adagrad_moves_nothing_without_gradient(spark, make_ratings):
    table = spark.createDataFrame([(0, 0, [0.0], [0.0]), (1, 0, [0.0], [0.0])],
                                  "side int, id int, features array<double>, acc array<double>")
    ratings = strata.BlockedRatings.of(positioned(make_ratings([(0, 0, 3.0)])), 1)
    done = strata.stratified_epoch(ratings, table, "adagrad", 1, 0.1, 0.05).df
    assert [r.features for r in done.collect()] == [[0.0], [0.0]]


def test_half_sgd_rounds_after_each_update(spark, make_ratings, triples):
    table = factors.init_state(spark, USERS, ITEMS, 2, precision="half")
    ratings = strata.BlockedRatings.of(positioned(make_ratings(triples)), 2, "half")
    done = strata.stratified_epoch(ratings, table, "sgd", 2, 0.05, 0.02, "half").df
    p, q = (serial.initial(n, 2, s).astype(np.float32).astype(np.float16).astype(np.float32)
            for n, s in ((USERS, 1), (ITEMS, 2)))
    serial.sgd([triples[n] for n in stratum_order(triples, 2)], p, q, 0.05, 0.02, np.float32, half=True)
    got_p, got_q = serial.matrices(done, USERS, ITEMS, 2)
    np.testing.assert_array_equal(got_p, p)
    np.testing.assert_array_equal(got_q, q)


@pytest.mark.parametrize("size", [1, 16, 1000])
def test_blockwise_minibatch_equals_serial(make_ratings, triples, state, size):
    ratings = strata.BlockedRatings.of(positioned(make_ratings(triples)), 2)
    done = strata.stratified_epoch(ratings, state, "minibatch", WIDTH, 0.02, 0.05, batch_size=size).df
    p, q = start()
    order = stratum_order(triples, 2)
    ub = serial.block([t[0] for t in triples], 0, 2)
    ib = serial.block([t[1] for t in triples], 0, 2)
    for cell in ((s, b) for s in range(2) for b in range(2)):
        inside = [triples[n] for n in order if ((ib[n] - ub[n]) % 2, ub[n]) == cell]
        serial.minibatch(inside, p, q, size, 0.02, 0.05)
    got_p, got_q = serial.matrices(done, USERS, ITEMS, WIDTH)
    np.testing.assert_allclose(got_p, p, atol=1e-12)
    np.testing.assert_allclose(got_q, q, atol=1e-12)


@pytest.mark.parametrize("size", [150, 400])
def test_dataframe_minibatch_equals_serial(make_ratings, triples, state, size):
    batched = ordering.batch_numbers(positioned(make_ratings(triples)), size)
    done = batch_gd.minibatch_epoch(batched, -(-400 // size), state, WIDTH, 0.01, 0.05).df
    p, q = start()
    serial.minibatch(triples, p, q, size, 0.01, 0.05)
    got_p, got_q = serial.matrices(done, USERS, ITEMS, WIDTH)
    np.testing.assert_allclose(got_p, p, atol=1e-12)
    np.testing.assert_allclose(got_q, q, atol=1e-12)


def test_wide_arrays_sum_like_narrow_ones(spark, make_ratings, triples, monkeypatch):
    from ratingloom.functions import arrays
    table = factors.init_state(spark, USERS, ITEMS, WIDTH)
    ratings = make_ratings(triples)
    narrow = serial.matrices(gradient_sums(ratings, table, WIDTH), USERS, ITEMS, WIDTH, "gradient")
    monkeypatch.setattr(arrays, "COLUMNWISE_WIDTH", 1)
    wide = serial.matrices(gradient_sums(ratings, table, WIDTH), USERS, ITEMS, WIDTH, "gradient")
    np.testing.assert_allclose(narrow[0], wide[0], atol=1e-12)
    np.testing.assert_allclose(narrow[1], wide[1], atol=1e-12)


@pytest.mark.parametrize("blocks", [1, 3])
def test_grid_equals_join(make_ratings, triples, state, blocks):
    ratings = make_ratings(triples)
    cells = grid.grid_ratings(ratings, blocks)
    joined = serial.matrices(batch_gd.gd_epoch(ratings, state, WIDTH, 0.01, 0.05), USERS, ITEMS, WIDTH)
    gridded = serial.matrices(grid.grid_epoch(cells, state, WIDTH, 0.01, 0.05), USERS, ITEMS, WIDTH)
    np.testing.assert_allclose(joined[0], gridded[0], atol=1e-12)
    np.testing.assert_allclose(joined[1], gridded[1], atol=1e-12)
    a, b = square_error(ratings, state).first(), grid.grid_square_error(cells, state, WIDTH).first()
    assert a.num_records == b.num_records == 400
    assert a.rmse == pytest.approx(b.rmse, abs=1e-12)


def test_grid_predictions_equal_joined_ones(make_ratings, triples, state):
    ratings = make_ratings(triples)
    gridded = grid.grid_predict(grid.grid_ratings(ratings, 2), state, WIDTH).orderBy("rec_id").collect()
    joined = factors.predict(ratings, state).orderBy("rec_id").collect()
    assert [(r.rec_id, r.user_id, r.item_id, r.rating) for r in gridded] == [
        (r.rec_id, r.user_id, r.item_id, r.rating) for r in joined]
    np.testing.assert_allclose([r.residual for r in gridded], [r.residual for r in joined], atol=1e-12)


def test_grid_leaves_out_unknown_ids(make_ratings, state):
    ratings = make_ratings([(0, 0, 3.0), (USERS + 5, 0, 1.0), (0, ITEMS + 9, 1.0)])
    row = grid.grid_square_error(grid.grid_ratings(ratings, 2), state, WIDTH).first()
    assert row.num_records == 1
    assert row.rmse == pytest.approx(square_error(ratings, state).first().rmse)


def test_local_sgd_averages_by_record_count(make_ratings, triples, state):
    parts = PartedRatings.of(local_sgd.parts_by_record(positioned(make_ratings(triples)), 150))
    done = local_sgd.local_epoch(parts, state, WIDTH, 0.05, 0.02).df
    sums = [np.zeros((USERS, WIDTH)), np.zeros((ITEMS, WIDTH))]
    counts = [np.zeros(USERS), np.zeros(ITEMS)]
    for first in range(0, 400, 150):
        chunk = triples[first:first + 150]
        p, q = start()
        serial.sgd(chunk, p, q, 0.05, 0.02)
        for side, (rows, matrix) in enumerate((([t[0] for t in chunk], p), ([t[1] for t in chunk], q))):
            n = np.bincount(rows, minlength=len(matrix))
            counts[side] += n
            sums[side] += n[:, None] * matrix
    for side, before in enumerate(start()):
        expected = np.where(counts[side][:, None] > 0, sums[side] / np.maximum(counts[side], 1)[:, None], before)
        np.testing.assert_allclose(serial.matrices(done, USERS, ITEMS, WIDTH)[side], expected, atol=1e-12)


def test_row_parts_keep_normal_users_whole(make_ratings, triples):
    deduped = profiles.dedupe_last(make_ratings(triples + [(0, i, 2.0) for i in range(ITEMS)]))
    offsets = ordering.user_offsets(deduped, USERS, 1)
    parts = local_sgd.parts_by_user(deduped, offsets, 15)
    counts = {r.user_id: r.cnt for r in offsets.collect()}
    spread = {r.user_id: r.n for r in parts.groupBy("user_id").agg(F.countDistinct("part").alias("n")).collect()}
    assert parts.count() == deduped.count()
    assert all(spread[u] == 1 for u in spread if counts[u] <= 15)
    assert spread[0] > 1  # 17 items do not fit in one part
    assert max(r["count"] for r in parts.groupBy("part").count().collect()) <= 45


def skewed(n=3000):
    """One user and one item hold a third of all ratings each, one pair a third of these."""
    rng = np.random.default_rng(5)
    users, items = rng.integers(1, 60, n), rng.integers(1, 60, n)
    users[: n // 3] = 0
    items[n // 4: n // 4 + n // 3] = 0
    return list(zip(users.tolist(), items.tolist(), rng.integers(1, 6, n).tolist()))


def test_hot_rows_are_split_and_every_rating_is_used(spark, make_ratings):
    triples = skewed()
    blocks = 4
    ratings = strata.BlockedRatings.of(positioned(make_ratings(triples)), blocks, min_split=10, split_hot=True)
    assert ratings.split
    sizes = ratings.table.df.groupBy("stratum", "block").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[1] == len(triples)
    # An unsplit run has a block with more than a third of a stratum's third; split ones stay near the mean.
    assert sizes[0] <= 5 * len(triples) / blocks**2
    table = factors.init_state(spark, 60, 60, WIDTH)
    before = square_error(make_ratings(triples), table).first().rmse
    for _ in range(3):
        table = strata.stratified_epoch(ratings, table, "sgd", WIDTH, 0.05, 0.01).df
    assert table.count() == 120 and table.select("side", "id").distinct().count() == 120
    assert square_error(make_ratings(triples), table).first().rmse < before / 2


def test_split_rows_are_the_weighted_mean_of_their_copies(spark, make_ratings):
    triples = [(0, i % 5, 3.0) for i in range(60)]
    ratings = strata.BlockedRatings.of(positioned(make_ratings(triples)), 2, min_split=10, split_hot=True)
    table = factors.init_state(spark, 1, 5, 2)
    placed = {r.pos: (r.user_key % strata.COPY_SPAN, r.item_key % strata.COPY_SPAN, r.stratum, r.block)
              for r in ratings.table.df.collect()}
    p = {c: serial.initial(1, 2, 1)[0] for c in {v[0] for v in placed.values()}}
    q = {(i, c): serial.initial(5, 2, 2)[i] for i in range(5) for c in {v[1] for v in placed.values()}}
    n_p, n_q = {}, {}
    for pos in sorted(placed, key=lambda x: (placed[x][2], placed[x][3], x)):
        uc, ic = placed[pos][:2]
        item = triples[pos][1]
        pu, qi = p[uc], q[item, ic]
        e = pu @ qi - 3.0
        p[uc], q[item, ic] = pu - 0.05 * (0.01 * pu + e * qi), qi - 0.05 * (0.01 * qi + e * pu)
        n_p[uc] = n_p.get(uc, 0) + 1
        n_q[item, ic] = n_q.get((item, ic), 0) + 1
    done = strata.stratified_epoch(ratings, table, "sgd", 2, 0.05, 0.01).df
    got_p, got_q = serial.matrices(done, 1, 5, 2)
    assert len(n_p) > 1
    np.testing.assert_allclose(got_p[0], sum(n * p[c] for c, n in n_p.items()) / 60, atol=1e-12)
    for item in range(5):
        copies = [(n, q[key]) for key, n in n_q.items() if key[0] == item]
        np.testing.assert_allclose(got_q[item], sum(n * x for n, x in copies) / sum(n for n, _ in copies), atol=1e-12)


def test_salted_joins_give_the_same_scores(make_ratings, state):
    triples = [(0, i % ITEMS, 2.0) for i in range(200)] + [(u, 0, 4.0) for u in range(USERS)]
    ratings = make_ratings(triples)
    skew = factors.RatingSkew.of(ratings, min_rows=10, max_keys=20)
    assert skew.users.first().copies > 1 and skew.items.count() > 0
    plain = {r.rec_id: r.prediction for r in factors.predict(ratings, state).collect()}
    salted = {r.rec_id: r.prediction for r in factors.predict(ratings, state, skew).collect()}
    assert len(salted) == len(triples) and salted == plain


def test_rate_zero_and_untouched_rows(make_ratings, state):
    before = serial.matrices(state, USERS, ITEMS, WIDTH)
    ratings = positioned(make_ratings([(1, 2, 5.0), (3, 4, 1.0)]))
    still = strata.stratified_epoch(strata.BlockedRatings.of(ratings, 2), state, "sgd", WIDTH, 0.0, 0.0).df
    np.testing.assert_array_equal(serial.matrices(still, USERS, ITEMS, WIDTH)[0], before[0])
    moved = serial.matrices(batch_gd.gd_epoch(ratings, state, WIDTH, 0.1, 0.1), USERS, ITEMS, WIDTH)
    changed = np.flatnonzero((moved[0] != before[0]).any(axis=1)).tolist()
    assert changed == [1, 3]


def test_result_does_not_depend_on_partitions(spark, make_ratings, triples, state):
    results = []
    for partitions in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        ratings = make_ratings(triples).repartition(int(partitions))
        ordered = ordering.shuffled_positions(ratings, "rec_id", 5, method="hash")
        done = strata.stratified_epoch(strata.BlockedRatings.of(ordered, 3), state, "sgd", WIDTH, 0.05, 0.02).df
        results.append(serial.matrices(done, USERS, ITEMS, WIDTH))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    np.testing.assert_array_equal(results[0][0], results[1][0])
    np.testing.assert_array_equal(results[0][1], results[1][1])


def planted(rank=3, users=40, items=30):
    rng = np.random.default_rng(11)
    a, b = rng.uniform(0.2, 1.2, (users, rank)), rng.uniform(0.2, 1.2, (items, rank))
    return [(u, i, float(a[u] @ b[i])) for u in range(users) for i in range(items) if rng.random() < 0.7]


@pytest.mark.parametrize("options, plan", [
    ({"gd_mode": 0, "learning_rate": 0.01}, "gd"),
    ({"gd_mode": 1, "batch_size": 300, "learning_rate": 0.02}, "minibatch"),
    ({"gd_mode": 1, "batch_size": 8, "learning_rate": 0.03}, "blockwise_minibatch"),
    ({"gd_mode": 1, "learning_rate": 0.05}, "sgd"),
    ({"gd_mode": 1, "learning_rate": 0.05, "decomp_mode": 0}, "local_sgd"),
    ({"gd_mode": 1, "learning_rate": 0.05, "decomp_mode": 0, "lock": 1}, "sgd"),
    ({"gd_mode": 1, "learning_rate": 0.05, "decomp_mode": 1}, "row_sgd"),
    ({"gd_mode": 1, "learning_rate": 0.05, "precision": 0}, "sgd"),
    ({"gd_mode": 2, "precision": 0}, "adagrad"),
    ({"gd_mode": 2, "precision": 1}, "adagrad"),
])
def test_every_mode_converges(make_ratings, options, plan):
    settings = {"num_features": 4, "max_num_iterations": 2, "regularization_factor": 0.001, "precision": 2,
                "show_train_rmse": 1, "show_test_rmse": 1} | options
    ratings = make_ratings(planted())
    train, test = ratings.where("rec_id % 10 <> 0"), ratings.where("rec_id % 10 = 0")
    model = fit(train, test, RunConfig(**settings), Engine(blocks=2, records_per_part=400,
                batching="blockwise" if plan == "blockwise_minibatch" else "global"), 40, 30)
    trace = model.metrics.orderBy("iter").collect()
    assert model.plan == plan
    assert [r.iter for r in trace] == [0, 1, 2]
    assert trace[0].epoch_seconds is None and trace[2].epoch_seconds > 0
    assert trace[2].train_rmse < trace[1].train_rmse < trace[0].train_rmse
    assert trace[2].test_rmse < trace[0].test_rmse
    assert model.evaluate(test).first().rmse == pytest.approx(trace[2].test_rmse, rel=1e-6)


def test_batch_descent_by_grid_equals_joins(make_ratings, monkeypatch):
    config = RunConfig(gd_mode=0, num_features=3, learning_rate=0.01, max_num_iterations=2, precision=2,
                       show_train_rmse=1)
    ratings = make_ratings([(u % 40, u * 7 % 30, u % 5 + 1) for u in range(2000)])
    joined = [r.train_rmse for r in fit(ratings, None, config).metrics.orderBy("iter").collect()]
    monkeypatch.setattr(grid, "MIN_JOIN_BYTES", 0)
    gridded = [r.train_rmse for r in fit(ratings, None, config).metrics.orderBy("iter").collect()]
    np.testing.assert_allclose(gridded, joined, rtol=1e-10)


def test_adagrad_recovers_a_planted_matrix(make_ratings):
    config = RunConfig(num_features=4, max_num_iterations=15, regularization_factor=0.0, precision=1,
                       show_train_rmse=1)
    model = fit(make_ratings(planted()), None, config, Engine(blocks=1))
    assert model.metrics.orderBy(F.desc("iter")).first().train_rmse < 0.15


def test_model_round_trip_and_cold_start(spark, make_ratings, tmp_path, monkeypatch):
    ratings = make_ratings(planted())
    model = fit(ratings, None, RunConfig(num_features=2, max_num_iterations=1), Engine(blocks=2))
    model.save(str(tmp_path / "model"))
    loaded = type(model).load(spark, str(tmp_path / "model"))
    assert loaded.config == model.config
    unknown = make_ratings([(0, 0, 1.0), (999, 0, 1.0), (0, 999, 1.0)])
    assert loaded.predict(unknown).count() == 1
    kept = loaded.predict(unknown, cold_start="nan").orderBy("rec_id").collect()
    assert [np.isnan(r.prediction) for r in kept] == [False, True, True]
    row = loaded.evaluate(unknown).first()
    assert (row.num_records, row.num_dropped) == (1, 2)
    many = make_ratings([(u % 40, u * 7 % 30, 2.0) for u in range(2000)] + [(999, 0, 1.0)])
    assert not grid.pays_off(2001, 70, 2, loaded._blocks(2001))
    monkeypatch.setattr(grid, "MIN_JOIN_BYTES", 0)
    assert grid.pays_off(2001, 70, 2, loaded._blocks(2001))
    by_join = square_error(many, loaded.state).first().rmse
    row = loaded.evaluate(many).first()
    assert (row.num_records, row.num_dropped) == (2000, 1) and row.rmse == pytest.approx(by_join, rel=1e-9)
    assert loaded.predict_on_grid(many).count() == 2000
    with pytest.raises(ValueError, match="cold_start"):
        loaded.predict(unknown, cold_start="zero")


def test_ids_beyond_the_dimensions_are_rejected(make_ratings):
    with pytest.raises(ValueError, match="beyond"):
        fit(make_ratings([(5, 5, 1.0)]), num_users=3, num_items=10)


def test_block_sizes_follow_the_data():
    assert strata.choose_blocks(1000, 100, 8, 8) == 1
    assert strata.choose_blocks(540_000, 35_000, 32, 8) == 4
    big = strata.choose_blocks(8 * 10**12, 10**9, 128, 4000)
    assert 8 * 10**12 / big**2 <= strata.MAX_BLOCK_RECORDS
    assert local_sgd.part_records(128) * 2 * 8 * 128 <= local_sgd.MAX_PART_BYTES
