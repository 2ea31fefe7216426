from __future__ import annotations

import math
import random

import numpy as np
import pytest

from ratingloom.operators import factors, metrics


def total(spark, values, partitions=3):
    frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(partitions)
    return metrics.exact_sum(frame, "x").first()


def test_same_bits_on_any_partitioning(spark):
    rng = random.Random(2)
    values = [rng.random() ** 20 * 10.0 ** rng.randrange(-30, 30) for _ in range(3000)]
    found = {np.float64(total(spark, values, n).total).tobytes() for n in (1, 7, 64)}
    assert len(found) == 1
    assert np.frombuffer(found.pop())[0] == pytest.approx(math.fsum(values), rel=1e-15)


@pytest.mark.parametrize("value", [0.0, 1.0, 2.0 ** -1074, 2.0 ** -1022, math.nextafter(1.0, 0.0), math.nextafter(2.0, 3.0),
                                   math.nextafter(8.0, 0.0), 1.7976931348623157e308, 3.0 * 2.0 ** 1000, 0.1])
def test_single_values_come_back(spark, value):
    assert total(spark, [value]).total == value


def test_powers_of_two_beside_the_logarithm(spark):
    values = [math.nextafter(2.0 ** e, side) for e in range(-60, 60, 7) for side in (0.0, math.inf)]
    assert total(spark, values).total == pytest.approx(math.fsum(values), rel=1e-15)


def test_odd_values(spark):
    row = total(spark, [1.0, None, 2.0])
    assert (row.total, row.n) == (3.0, 2)
    assert total(spark, [1.0, math.inf]).total == math.inf
    assert math.isnan(total(spark, [1.0, math.nan]).total)
    empty = total(spark, [])
    assert (empty.total, empty.n) == (None, 0)


def test_error_equals_plain_error(spark, make_ratings):
    ratings = make_ratings([(n % 9, n % 7, float(n % 5)) for n in range(200)])
    state = factors.init_state(spark, 9, 7, 4)
    plain = metrics.square_error(ratings, state).first()
    rows = [metrics.square_error_exact(ratings.repartition(n), state).first() for n in (1, 7, 64)]
    assert rows[0] == rows[1] == rows[2]
    assert rows[0].num_records == plain.num_records
    assert rows[0].rmse == pytest.approx(plain.rmse, rel=1e-12)
