from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.functions.bijection import Bijection
from ratingloom.operators import ordering


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 100, 999, 4097])
@pytest.mark.parametrize("seed", [0, 13])
def test_positions_are_a_permutation(spark, size, seed):
    shuffle = Bijection(size, seed)
    expected = shuffle.positions(np.arange(size))
    assert sorted(expected.tolist()) == list(range(size))
    rows = spark.range(size).select("id", shuffle.position(F.col("id")).alias("pos")).collect()
    assert {r.id: r.pos for r in rows} == dict(enumerate(expected.tolist()))


def test_walks_leave_the_cells_beyond():
    walks = [Bijection(size, seed).walk for size in range(2, 60) for seed in range(5)]
    assert max(walks) > 1


def test_large_ranges_and_foreign_ids(spark):
    shuffle = Bijection(10 ** 13 + 7, 5)
    ids = np.array([0, 1, 12345678901, 10 ** 13 + 6])
    found = spark.createDataFrame([(int(i),) for i in ids] + [(None,), (-1,), (10 ** 13 + 7,)], "id long").select(
        shuffle.position(F.col("id")).alias("pos"))
    assert [r.pos for r in found.collect()] == shuffle.positions(ids).tolist() + [None] * 3


def test_shuffle_spreads():
    pos = Bijection(10_000, 3).positions(np.arange(10_000))
    assert abs(np.corrcoef(np.arange(10_000), pos)[0, 1]) < 0.05
    assert abs(np.corrcoef(pos[:-1], pos[1:])[0, 1]) < 0.05


def test_plan_has_no_exchange(spark):
    rows = spark.range(1000).withColumnRenamed("id", "rec_id")
    shuffled = ordering.shuffled_positions(rows, "rec_id", 13, method="bijective")
    assert "Exchange" not in shuffled._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in shuffled.collect()) == list(range(1000))


def test_offsets_follow_the_bijection(spark, make_ratings):
    triples = [(n * 7 % 11, n % 5, 1.0) for n in range(60)]
    rows = {r.user_id: r for r in ordering.user_offsets(make_ratings(triples), 14, 3, "bijective").collect()}
    place = dict(enumerate(Bijection(14, 3).positions(np.arange(14)).tolist()))
    counts = {u: sum(t[0] == u for t in triples) for u in range(14)}
    for user, row in rows.items():
        assert (row.pos, row.cnt) == (place[user], counts[user])
        assert row.base == sum(counts[u] for u in range(14) if place[u] < place[user])
