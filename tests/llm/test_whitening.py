"""Exact whitening next to plain integer arithmetic and numpy's symmetric solver."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from ratingloom.llm import queries
from ratingloom.llm import whitening as wh

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, component string, whitened int"


def expanded(matrix):
    """Coefficients by traces of powers (Faddeev and LeVerrier), in integers."""
    size, coefficients = len(matrix), [1]
    unit = np.array([[int(i == j) for j in range(size)] for i in range(size)], dtype=object).reshape(size, size)
    power = unit * 0
    for k in range(1, size + 1):
        power = matrix @ power + coefficients[-1] * unit
        total = sum((matrix @ power).diagonal())
        assert total % k == 0
        coefficients.append(-total // k)
    return coefficients


def integers(vector):
    return [math.floor(Fraction(c) * 1024) + 100_000 for c in vector]


def plain(rows):
    """``(n, x by row, covariance)`` in exact numbers, for rows of one length."""
    kept = [(key, integers(v)) for key, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(column) for column in zip(*(x for _, x in kept))]
    centred = [[n * c - s for c, s in zip(x, sums)] for _, x in kept]
    return kept, n, sums, centred


def compare(found, rows, count=8):
    kept, n, sums, centred = plain(rows)
    size = len(sums)
    covariance = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n ** 3)) for j in range(size)]
                           for i in range(size)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(count, int((values > 1e-9 * values[0]).sum()))
    by_row = {}
    for row in found:
        by_row.setdefault((row.vec_id, row.deviation_exact), []).append(row)
    wanted = {}
    for (key, _), r in zip(kept, centred):
        wanted.setdefault((key, str(sum(c * c for c in r))), []).append(np.array(r, dtype=float) / n)
    assert set(by_row) == set(wanted)
    for key, group in wanted.items():
        mine = by_row[key]
        assert len(mine) == count * len(group)
        assert all(r.n == n and (r.deviation is None or str(r.deviation) == key[1]) for r in mine)
        for k in range(count):
            ours = sorted(r.whitened for r in mine if r.component == k + 1)
            theirs = [row @ vectors[:, k] / math.sqrt(values[k]) for row in group]
            assert (np.allclose(ours, sorted(theirs), atol=1e-6)
                    or np.allclose(ours, sorted(-t for t in theirs), atol=1e-6))
    for row in found:
        assert row.explained == pytest.approx(values[row.component - 1] / values.sum(), rel=1e-9)
        assert row.identity_error < 1e-6


def test_polynomial(spark):
    rng = random.Random(1)
    for size, top in ((1, 9), (2, 5), (7, 10 ** 12), (12, 10 ** 30)):
        rows = np.array([[rng.randrange(-top, top) for _ in range(size)] for _ in range(2 * size)], dtype=object)
        matrix = rows.T @ rows
        assert wh.characteristic_polynomial(spark, matrix) == expanded(matrix)


def test_polynomial_without_pivots():
    """Columns that are done before the reduction reaches them."""
    matrix = np.array([[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 5, 0], [1, 0, 0, 7]], dtype=object)
    moduli = wh.primes(3)
    found = wh.polynomials_modulo(np.array([matrix.tolist()] * 3, np.int64), np.array(moduli, np.int64))
    for q, residues in zip(moduli, found.tolist()):
        assert residues == [c % q for c in expanded(matrix)]


def test_roots_with_multiplicity():
    diagonal = np.array([[int(i == j) * (7, 7, 7, 4, 1, 0)[i] for j in range(6)] for i in range(6)], dtype=object)
    roots, bits = wh.largest_roots(expanded(diagonal), 8)
    assert [round(r / (1 << bits), 9) for r in roots] == [7, 7, 7, 4, 1]
    vectors = wh.components(diagonal, roots, bits)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-15
    assert np.abs(diagonal.astype(float) @ vectors - vectors * [7, 7, 7, 4, 1]).max() < 1e-14


def test_close_roots():
    """Two eigenvalues that differ in the thirteenth digit still get their own vectors."""
    big = 10 ** 13
    matrix = np.array([[big + 1, 1, 0], [1, big + 3, 2], [0, 2, 5]], dtype=object)
    roots, bits = wh.largest_roots(expanded(matrix), 2)
    vectors = wh.components(matrix, roots, bits)
    exact = [(Fraction(r, 1 << bits), v) for r, v in zip(roots, vectors.T)]
    for root, vector in exact:
        product = [sum(int(matrix[i, j]) * Fraction(float(vector[j])) for j in range(3)) for i in range(3)]
        assert max(abs(p - root * Fraction(float(v))) for p, v in zip(product, vector)) < Fraction(1, 100)


@pytest.mark.parametrize("top", [100, 1 << 25, (1 << 62) - 1])
def test_products(top):
    rng = random.Random(top)
    matrix = np.array([[rng.randrange(-top, top) for _ in range(4)] for _ in range(200)], np.int64)
    assert (wh.exact_products(matrix) == matrix.astype(object).T @ matrix.astype(object)).all()


def awkward():
    rng = random.Random(4)
    rows = [(k % 40, [rng.gauss(0, 0.1 * (j + 1)) for j in range(5)]) for k in range(60)]
    rows += [(None, [0.5, -0.25, 0.125, 1.0, 2.0])] * 3 + [rows[0]] * 2
    return rows, [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0]), (3, [float("nan")] * 5), (4, [math.inf] + [0.0] * 4)]


def test_awkward_rows(spark):
    rows, unusable = awkward()
    others = [(8, []), (9, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows + unusable + others], SCHEMA).repartition(6)
    compare(wh.whiten(table).collect(), rows)


def test_large_entries(spark):
    """Deviations beyond a long stay exact as digits."""
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) * 2.0 ** 40 for _ in range(3)]) for k in range(30)]
    found = wh.whiten(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)).collect()
    assert all(row.deviation is None for row in found)
    compare(found, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]])
def test_nothing_varies(spark, rows):
    assert wh.whiten(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)).count() == 0


def test_fewer_components(spark):
    rows = [(k, [float(k), 2.0 * k, 1.0]) for k in range(5)]
    found = wh.whiten(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)).collect()
    assert {row.component for row in found} == {1}
    compare(found, rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op11_exact_whitening(spark, SF_DIR).collect()
    assert len(found) == 8 * len(rows)
    compare(found, rows)
