"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

1. Entries become integers and tasks add up exact scatter sums, which leave them in limbs of 30 bits.
2. ``n**2`` times the covariance is an integer matrix. Its characteristic polynomial is computed modulo
   many primes by Hessenberg reduction, in Spark tasks, and put together by Chinese remaindering.
3. All roots are real and none is negative, so Descartes' rule counts the roots above a point exactly. Bisection
   isolates the largest ones and the sign of the polynomial refines them far beyond double precision.
4. Inverse iteration on the null space, in decimal arithmetic, gives a unit vector for each root.
5. Tasks project ``n * x - sum`` on the components; the covariance of the result is measured.

Only sums of the size of the matrix reach the driver, however many vectors there are.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ratingloom.session import stage, task_slots

SCALE = 1024
SHIFT = 100_000
#: Integers beyond this are cut there, so that sums with the shift stay 64-bit.
MOST = 1 << 62
LIMB = 30
#: Bits of a root beyond its leading one, and digits of the arithmetic that finds components.
ROOT_BITS = 140
DIGITS = 110
_ROWS = 4096


def integer_matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and ``floor(1024 * entry)`` of the usable vectors, for each length apart.

    A vector that is null or holds a null or an entry that is not finite is left out.
    """
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lists = column.drop_null()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.fill_null(lists.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    usable = bad[ends] == bad[ends - lengths]
    for length in np.unique(lengths[usable]).tolist():
        chosen = np.flatnonzero(usable & (lengths == length))
        places = (ends - lengths)[chosen, None] + np.arange(length)
        with np.errstate(over="ignore"):
            found = np.clip(np.floor(entries[places] * SCALE), -float(MOST), float(MOST))
        yield rows[chosen], found.astype(np.int64)


def exact_products(matrix: np.ndarray) -> np.ndarray:
    """``matrix.T @ matrix`` in Python integers, of at most ``_ROWS`` rows."""
    if len(matrix) == 0 or np.abs(matrix).max() < 1 << 20:
        # Sums of 2**12 products below 2**40 are exact in doubles.
        values = matrix.astype(np.float64)
        return (values.T @ values).astype(np.int64).astype(object)
    limbs = [(matrix >> (20 * k)) & 0xFFFFF for k in range(3)] + [matrix >> 60]
    total = 0
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            part = (left.astype(np.float64).T @ right.astype(np.float64)).astype(np.int64).astype(object)
            total = total + part * (1 << 20 * (a + b))
    return total


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of the vectors with a 1 behind them, by length, as limbs of the upper triangle."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, matrix in integer_matrices(batch.column(0)):
            wide = np.concatenate([matrix, np.ones((len(matrix), 1), np.int64)], axis=1)
            for first in range(0, len(wide), _ROWS):
                products = exact_products(wide[first: first + _ROWS])
                totals[matrix.shape[1]] = totals.get(matrix.shape[1], 0) + products
    for length, total in totals.items():
        rows, columns = np.triu_indices(length + 1)
        values = total[rows, columns]
        limb = 0
        while len(values):
            # The last limb keeps the sign.
            last = [-(1 << LIMB) <= v < 1 << LIMB for v in values]
            out = [v if end else v & ((1 << LIMB) - 1) for v, end in zip(values, last)]
            yield pa.record_batch({
                "length": pa.array([length] * len(out), pa.int32()), "i": pa.array(rows, pa.int32()),
                "j": pa.array(columns, pa.int32()), "limb": pa.array([limb] * len(out), pa.int32()),
                "value": pa.array([int(v) for v in out], pa.int64())})
            more = ~np.array(last)
            rows, columns, limb = rows[more], columns[more], limb + 1
            values = np.array([v >> LIMB for v in values[more]], dtype=object)


def scatter(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their sums and their sums of products (Python integers), for the commonest length."""
    parts = vectors.mapInArrow(_scatter, "length int, i int, j int, limb int, value long")
    sums = parts.groupBy("length", "i", "j", "limb").agg(F.sum("value").alias("value")).collect()
    if not sums:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    totals: dict[int, np.ndarray] = {}
    for row in sums:
        total = totals.setdefault(row.length, np.full((row.length + 1, row.length + 1), 0, dtype=object))
        total[row.i, row.j] += row.value << (LIMB * row.limb)
    length = max(totals, key=lambda d: (totals[d][d, d], d))
    total = totals[length]
    total = total + np.triu(total, 1).T
    return total[length, length], total[:length, length], total[:length, :length]


def primes(count: int) -> list[int]:
    """The largest primes below 2**31."""
    def is_prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        # These bases decide all numbers below 3.4e14.
        for base in (2, 3, 5, 7, 11, 13, 17):
            x = pow(base, odd, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
                return False
        return True

    found, n = [], (1 << 31) - 1
    while len(found) < count:
        if is_prime(n):
            found.append(n)
        n -= 2
    return found


def polynomials_modulo(matrices: np.ndarray, moduli: np.ndarray) -> np.ndarray:
    """Characteristic polynomials, highest power first, of one matrix for each prime: Hessenberg form, then its recurrence."""
    h, count, size = matrices.copy(), len(moduli), matrices.shape[1]
    p = moduli.astype(np.int64)
    every = np.arange(count)

    def inverses(values: np.ndarray) -> np.ndarray:
        return np.array([pow(v, -1, q) if v else 0 for v, q in zip(values.tolist(), p.tolist())], np.int64)

    for k in range(1, size - 1):
        pivot = k + (h[:, k:, k - 1] != 0).argmax(axis=1)
        h[every, k], h[every, pivot] = h[every, pivot], h[every, k]
        columns = h[every, :, k].copy()
        h[every, :, k] = h[every, :, pivot]
        h[every, :, pivot] = columns
        # Without a pivot the column is done, and all factors are zero.
        factors = h[:, k + 1:, k - 1] * inverses(h[:, k, k - 1])[:, None] % p[:, None]
        h[:, k + 1:] = (h[:, k + 1:] - factors[:, :, None] * h[:, k, None, :]) % p[:, None, None]
        moved = (h[:, :, k + 1:] * factors[:, None, :] % p[:, None, None]).sum(axis=2)
        h[:, :, k] = (h[:, :, k] + moved) % p[:, None]
    # leading[k] is the polynomial of the first k rows and columns, lowest power first.
    leading = np.zeros((size + 1, count, size + 1), np.int64)
    leading[0, :, 0] = 1
    for k in range(size):
        now = -(h[:, k, k, None] * leading[k] % p[:, None])
        now[:, 1:] += leading[k][:, :-1]
        product = np.ones(count, np.int64)
        for i in range(k - 1, -1, -1):
            product = product * h[:, i + 1, i] % p
            now -= (h[:, i, k] * product % p)[:, None] * leading[i] % p[:, None]
        leading[k + 1] = now % p[:, None]
    return leading[size][:, ::-1]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, highest power first, of a symmetric matrix without negative eigenvalues."""
    size, trace = len(matrix), sum(int(matrix[k, k]) for k in range(len(matrix)))
    # The k-th coefficient is a sum of products of k eigenvalues: at most what equal ones would give.
    bound = max(math.comb(size, k) * (trace // max(size, 1) + 1) ** k for k in range(size + 1))
    moduli = primes(bound.bit_length() // 30 + 2)
    entries = matrix.tolist()

    def run(batches):
        for batch in batches:
            some = [moduli[k] for k in batch.column(0).to_pylist()]
            reduced = np.array([[[v % q for v in row] for row in entries] for q in some], np.int64)
            found = polynomials_modulo(reduced.reshape(len(some), size, size), np.array(some, np.int64))
            yield pa.record_batch({"prime": pa.array(some, pa.int64()),
                                   "residues": pa.array(found.tolist(), pa.list_(pa.int64()))})

    tasks = min(len(moduli), task_slots(spark))
    rows = spark.range(0, len(moduli), 1, tasks).mapInArrow(run, "prime long, residues array<long>").collect()
    product = math.prod(moduli)
    coefficients = [0] * (size + 1)
    for row in rows:
        others = product // row.prime
        weight = others * pow(others, -1, row.prime)
        for k, residue in enumerate(row.residues):
            coefficients[k] += residue * weight
    coefficients = [c % product for c in coefficients]
    return [c - product if c > product // 2 else c for c in coefficients]


def roots_above(coefficients: list[int], point: int) -> int:
    """Roots greater than ``point``, with multiplicity, of a polynomial whose roots are all real."""
    shifted = list(coefficients)
    for last in range(len(shifted) - 1, 0, -1):
        for k in range(1, last + 1):
            shifted[k] += point * shifted[k - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], count: int) -> tuple[list[int], int]:
    """The largest positive roots, falling, as integers over ``2**bits``, and ``bits``; multiple roots repeat."""
    count = min(count, roots_above(coefficients, 0))
    if count == 0:
        return [], 0
    # Grow the unit until the smallest wanted root has ROOT_BITS.
    top = abs(coefficients[1]) + 1
    low, high = -ROOT_BITS, top.bit_length()
    while high - low > 1:
        middle = (low + high) // 2
        bits = max(0, -middle)
        scaled = [c << (bits * k) for k, c in enumerate(coefficients)]
        if roots_above(scaled, 1 << (middle + bits)) >= count:
            low = middle
        else:
            high = middle
    bits = max(0, ROOT_BITS - low)
    scaled = [c << (bits * k) for k, c in enumerate(coefficients)]

    def value(point: int) -> int:
        total = 0
        for c in scaled:
            total = total * point + c
        return total

    found: list[int] = []
    # Half-open ranges with the number of roots above either end, largest first.
    ranges = [(0, top << bits, roots_above(scaled, 0), 0)]
    while ranges and len(found) < count:
        low, high, above_low, above_high = ranges.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if high - low == 1:
            found += [high] * inside
            continue
        if inside == 1 and value(high) != 0:
            # One simple root: the sign tells on which side it is.
            sign = value(high) > 0
            while high - low > 1:
                middle = (low + high) // 2
                now = value(middle)
                if now == 0 or (now > 0) == sign:
                    high = middle
                else:
                    low = middle
            found.append(high)
            continue
        middle = (low + high) // 2
        above = roots_above(scaled, middle)
        ranges += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found[:count], bits


def components(matrix: np.ndarray, roots: list[int], bits: int) -> np.ndarray:
    """Unit eigenvectors of the roots, one a column, in doubles.

    Two steps of inverse iteration, each vector kept apart from those before it, which also
    spans the null space of a root that occurs several times.
    """
    size, found = len(matrix), []
    with decimal.localcontext() as context:
        context.prec = DIGITS
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        exact = np.array([[Decimal(int(v)) for v in row] for row in matrix], dtype=object).reshape(size, size)
        unit = Decimal(1 << bits)
        scale = max((abs(v) for v in exact.ravel()), default=Decimal(1)) or Decimal(1)
        for number, root in enumerate(roots):
            shifted = exact.copy()
            for k in range(size):
                shifted[k, k] -= Decimal(root) / unit
            solve = _solver(shifted, scale.scaleb(-DIGITS + 10))
            vector = np.array([Decimal(1 + (k * (number + 3) + number) % 11) for k in range(size)], dtype=object)
            for _ in range(2):
                vector = solve(vector)
                vector = vector / max(abs(v) for v in vector)
                for other in found:
                    vector = vector - other * (other @ vector)
                vector = vector / (vector @ vector).sqrt()
            found.append(vector)
    return np.array([[float(v) for v in vector] for vector in found]).reshape(len(roots), size).T


def _solver(matrix: np.ndarray, least: Decimal):
    """Solve by elimination with row exchanges; a vanished pivot counts as ``least``."""
    lu, size, order = matrix.copy(), len(matrix), list(range(len(matrix)))
    for k in range(size):
        pivot = max(range(k, size), key=lambda i: abs(lu[i, k]))
        if pivot != k:
            lu[[k, pivot]] = lu[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if abs(lu[k, k]) < least:
            lu[k, k] = least
        for i in range(k + 1, size):
            if lu[i, k]:
                lu[i, k] = lu[i, k] / lu[k, k]
                lu[i, k + 1:] = lu[i, k + 1:] - lu[i, k] * lu[k, k + 1:]

    def solve(right: np.ndarray) -> np.ndarray:
        x = right[order].copy()
        for i in range(1, size):
            x[i] = x[i] - lu[i, :i] @ x[:i]
        for i in range(size - 1, -1, -1):
            x[i] = (x[i] - (lu[i, i + 1:] @ x[i + 1:] if i + 1 < size else 0)) / lu[i, i]
        return x

    return solve


@dataclass
class Whitening:
    """A fitted whitening: ``roots`` are eigenvalues of ``n**2`` times the covariance, over ``2**bits``."""

    n: int
    sums: list[int]
    trace: int
    roots: list[int]
    bits: int
    components: np.ndarray

    @property
    def explained(self) -> list[float]:
        """Share of the variance of each component."""
        return [root / (self.trace << self.bits) for root in self.roots]

    @property
    def eigenvalues(self) -> list[float]:
        return [root / ((self.n * self.n) << self.bits) for root in self.roots]

    def projection(self) -> np.ndarray:
        """Takes ``n * x - sum`` to whitened values; ``n`` cancels against the root."""
        scales = [math.sqrt(root / (1 << self.bits)) for root in self.roots]
        return self.components / np.array(scales).reshape(1, -1)

    def transform(self, table: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
        """``keep``, ``deviation`` (null beyond a long), ``deviation_exact`` (digits) and ``whitened`` of each usable row."""
        projection, length = self.projection(), len(self.sums)
        n, sums = self.n, self.sums
        columns = table.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{vector}`").cast("array<double>").alias("_vector"))
        schema = columns.drop("_vector").schema.add("deviation", "long").add("deviation_exact", "string").add(
            "whitened", ArrayType(DoubleType()))

        def run(batches):
            for batch in batches:
                for rows, matrix in integer_matrices(batch.column(batch.num_columns - 1)):
                    if matrix.shape[1] != length:
                        continue
                    centred, squares = _centred(matrix, n, sums)
                    values = centred @ projection
                    kept = [batch.column(k).take(pa.array(rows)) for k in range(batch.num_columns - 1)]
                    offsets = pa.array(np.arange(len(rows) + 1) * values.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()),
                         pa.array(list(map(str, squares)), pa.string()),
                         pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.float64()))],
                        [*keep, "deviation", "deviation_exact", "whitened"])

        return columns.mapInArrow(run, schema)


def _centred(matrix: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """``n * x - sums`` as doubles, rounded once, and the exact sum of its squares for each row."""
    largest = n * int(np.abs(matrix).max(initial=0)) + max(map(abs, sums), default=0)
    if largest < 1 << 62:
        centred = matrix * n - np.array(sums, np.int64)
        if matrix.shape[1] * largest ** 2 < 1 << 63:
            return centred.astype(np.float64), (centred * centred).sum(axis=1).tolist()
        exact = centred.astype(object)
    else:
        exact = matrix.astype(object) * n - np.array(sums, dtype=object)
    squares = (exact * exact).sum(axis=1) if matrix.shape[1] else np.zeros(len(matrix), object)
    return exact.astype(np.float64), [int(s) for s in squares]


def fit_whitening(vectors: DataFrame, count: int = 8) -> Whitening:
    """Fit on the one array column of ``vectors``; components without variance are left out.

    Vectors that are null, hold nulls or entries that are not finite, or have another length than
    most vectors (the longer one of equally common lengths counts) take no part.
    """
    spark = vectors.sparkSession
    column = vectors.columns[0]
    vectors = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("_vector"))
    n, sums, products = scatter(vectors)
    matrix = products * n - np.outer(sums, sums) if len(sums) else products
    trace = int(sum(matrix.diagonal())) if len(sums) else 0
    roots, bits = ([], 0) if trace == 0 else largest_roots(characteristic_polynomial(spark, matrix), count)
    return Whitening(n, [int(s) for s in sums], trace, roots, bits, components(matrix, roots, bits))


def identity_error(whitened: DataFrame, count: int) -> float | None:
    """Largest entry of the difference between the covariance of ``whitened`` and the identity."""
    if count == 0:
        return None
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    row = whitened.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs)).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(row, pairs))


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = 8) -> DataFrame:
    """Fit on ``table`` and return one row for each usable vector and component, repeated and null keys included.

    ``(key, component, n, deviation, whitened, explained, identity_error, deviation_exact)``; no rows where no
    vector is usable or nothing varies, fewer components where fewer have variance.
    """
    model = fit_whitening(table.select(F.col(f"`{vector}`")), count)
    wide = stage(model.transform(table, vector, (key,)), "whitened").df
    error = identity_error(wide, len(model.roots))
    shares = F.array(*map(F.lit, model.explained)).cast("array<double>")
    rows = wide.select(F.col(f"`{key}`"), "deviation", "deviation_exact", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(F.col(f"`{key}`"), (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                       "deviation", "whitened", shares[F.col("place")].alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"), "deviation_exact")
