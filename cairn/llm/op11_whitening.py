"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter (11).

Every entry c becomes the integer floor(256 c); the fit list is each distinct integer vector once.
With n vectors, sums S and products G, the scatter M = n G - S S' is an integer matrix and M / n^2
the covariance, without any rounding.

1. Tasks add up products of their vectors exactly (matrix products of limbs that doubles hold).
2. The polynomial det(x I - M) is found modulo many primes, a prime at a time in Spark tasks: M is
   brought to Hessenberg form and the recurrence over its leading blocks gives the coefficients.
   Chinese remaindering joins them; a bound on the coefficients of a matrix without negative
   eigenvalues says how many primes are needed.
3. All roots are real and none is negative, so the sign changes of the polynomial moved to a point
   are exactly the number of roots beyond that point (with multiplicity): bisection over dyadic points
   isolates the largest roots, exact signs refine them to ``ROOT_BITS`` bits.
4. Inverse iteration in ``DIGITS`` decimal digits finds the null space of M - root I: one vector
   for a simple root, an orthonormal basis for roots that agree to ``CLUSTER_BITS`` bits.

Only matrices of dimension by dimension and a list of residues reach the driver; neither grows
with the rows.  The scatter is summed by ranges of rows that tasks stream through.

Vectors that are null, empty or hold null or non-finite entries take no part; of vectors of several
lengths those of the commonest length (ties: the longest) take part.  Entries beyond 64 bits count
as the largest of 64 bits.  Repeated rows and null ids each get their rows.  Components with eigenvalue 0
cannot be whitened and are left out, so a table with fewer than two different vectors, or an empty one,
gives no rows.  A deviation beyond 64 bits is null.  Of the input's columns only the id and the
vector are read, so others may have any name.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize

SCALE = 256
#: Rows whose products are added at once, and bits of a limb: sums stay below 2**53.
BLOCK_ROWS, LIMB_BITS = 4096, 20
#: Bits of the parts in which tasks hand on their sums.
PART_BITS, PARTS = 40, 5
ROOT_BITS, CLUSTER_BITS, DIGITS = 240, 96, 140


@dataclass(frozen=True)
class Whitening:
    """``components[k]`` (unit length) has the scatter's eigenvalue ``eigenvalues[k]`` = n^2 e."""

    n: int
    sums: tuple[int, ...]
    trace: int
    eigenvalues: tuple[Fraction, ...]
    components: tuple[tuple[float, ...], ...]


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, x) with usable vectors of the commonest length."""
    value = F.col(vector)
    fine = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                    & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    usable = df.filter(value.isNotNull() & (F.size(value) > 0) & fine).select(
        key, F.transform(value, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    common = (usable.groupBy(F.size("x").alias("d")).count()
              .orderBy(F.desc("count"), F.desc("d")).first())
    return usable.filter(F.size("x") == (common["d"] if common else -1))


# --- 1. exact scatter

def _as_matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x in Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK_ROWS):
        block = x[at:at + BLOCK_ROWS]
        if _largest(block) < 1 << LIMB_BITS:
            limbs = [block.astype(np.float64)]
        else:
            limbs, rest = [], block
            for _ in range(3):
                limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
                rest = rest >> LIMB_BITS
            limbs.append(rest.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB_BITS * (i + j))
    return total


def _partial_products(batches):
    total = None
    for batch in batches:
        x = _as_matrix(batch.column(0))
        z = np.hstack([np.ones((len(x), 1), np.int64), x])   # row 0 of the products: n and the sums
        got = exact_products(z)
        total = got if total is None else total + got
    if total is None:
        return
    i, j = np.triu_indices(len(total))
    mask = (1 << PART_BITS) - 1
    values = [int(v) for v in total[i, j]]
    parts = []
    for k in range(PARTS):
        last = k == PARTS - 1
        parts.append(pa.array([v if last else v & mask for v in values], pa.int64()))
        values = [v >> PART_BITS for v in values]
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *parts],
                                     names=["i", "j", *[f"p{k}" for k in range(PARTS)]])


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, M) of the rows ``x``."""
    spark = fit.sparkSession
    schema = "i int, j int, " + ", ".join(f"p{k} long" for k in range(PARTS))
    parts = fit.select("x").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(_partial_products, schema)
    sums = parts.groupBy("i", "j").agg(*[F.sum(F.col(f"p{k}").cast("decimal(38,0)")).alias(f"p{k}")
                                         for k in range(PARTS)]).collect()
    d = max((r["j"] for r in sums), default=0)
    full = np.zeros((d + 1, d + 1), object)
    for r in sums:
        value = sum(int(r[f"p{k}"]) << PART_BITS * k for k in range(PARTS))
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = value
    n, s = int(full[0, 0]), full[0, 1:]
    return n, [int(v) for v in s], n * full[1:, 1:] - np.outer(s, s)


# --- 2. characteristic polynomial

def _is_prime(n: int) -> bool:
    """Certain for n < 2**32 with these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(product: int) -> list[int]:
    """The largest primes under 2**31 whose product is greater than ``product``."""
    out, have, candidate = [], 1, (1 << 31) - 1
    while have <= product:
        if _is_prime(candidate):
            out.append(candidate)
            have *= candidate
        candidate -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo the prime ``p``, constant first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - factor[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * factor[None, :] % p).sum(axis=1)) % p
    # of the leading blocks: the last column is expanded, with products of the subdiagonal
    blocks = np.zeros((d + 1, d + 1), np.int64)
    blocks[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = blocks[k - 1, :-1]
        weights = np.empty(k, np.int64)
        run = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        blocks[k] = (new - (blocks[:k] * weights[:, None] % p).sum(axis=0)) % p
    return blocks[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, constant first, of a matrix without negative eigenvalues."""
    d, trace = len(matrix), int(np.trace(matrix))
    # the sum of the k-row minors is at most that of k equal eigenvalues
    bound = max((math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1)), default=1)
    primes = primes_above(2 * bound)

    def work(batches):
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array([polynomial_mod(matrix, p) for p in ps], pa.list_(pa.int64()))],
                names=["p", "c"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
            .mapInArrow(work, "p long, c array<long>").collect())
    whole = math.prod(r["p"] for r in rows)
    out = [0] * (d + 1)
    for r in rows:
        rest = whole // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        for i, c in enumerate(r["c"]):
            out[i] += c * unit
    out = [c % whole for c in out]
    return [c - whole if c > whole // 2 else c for c in out]


# --- 3. roots

def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times those of ``poly``."""
    d = len(poly) - 1
    return [c << bits * (d - i) for i, c in enumerate(poly)]


def roots_beyond(poly: list[int], point: int, bits: int = 0) -> int:
    """Number of roots over point / 2**bits, each as often as it counts; all roots are real."""
    c = _scaled(poly, bits)
    for i in range(len(c) - 1):            # synthetic division, again and again: poly(x + point)
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(scaled: list[int], point: int) -> int:
    v = 0
    for c in reversed(scaled):
        v = v * point + c
    return v


def largest_roots(poly: list[int], count: int) -> list[tuple[Fraction, int]]:
    """The ``count`` largest positive roots, falling, as (value, how often it counts).

    Roots that agree to ``CLUSTER_BITS`` bits are one entry; the last entry may reach over ``count``.
    """
    while len(poly) > 1 and poly[0] == 0:   # roots at 0 are of no use
        poly = poly[1:]
    out: list[tuple[Fraction, int]] = []
    found, top = 0, max(1, -poly[-2]).bit_length() if len(poly) > 1 else 0
    while found < min(count, len(poly) - 1):
        low, high, bits = 0, 1 << top, 0    # the next root is in (low, high] / 2**bits
        n_low, n_high = len(poly) - 1, 0
        while not (n_high == found and n_low == found + 1):
            if high - low == 1 and high.bit_length() > CLUSTER_BITS:
                break
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            n = roots_beyond(poly, middle, bits)
            if n > found:
                low, n_low = middle, n
            else:
                high, n_high = middle, n
        size = n_low - found
        if size == 1:                       # one root inside: its sign change
            while high.bit_length() <= ROOT_BITS or high - low > 1:
                if high - low == 1:
                    low, high, bits = 2 * low, 2 * high, bits + 1
                scaled = _scaled(poly, bits)
                middle = (low + high) // 2
                v = _value(scaled, middle)
                if v == 0:
                    low, high = middle, middle
                    break
                # beyond the k-th largest root the sign is that of (-1)**(roots further out)
                if (v > 0) == (found % 2 == 0):
                    high = middle
                else:
                    low = middle
        out.append((Fraction(low + high, 2 << bits), size))
        found += size
    return out


# --- 4. components

def null_space(matrix: np.ndarray, root: Fraction, size: int) -> list[list[float]]:
    """Orthonormal vectors that span the null space of matrix - root I, which has ``size`` dimensions."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object).reshape(d, d)
        # a little beside the root, so that no pivot is 0 but the last ones are tiny
        a[np.arange(d), np.arange(d)] -= shift * (1 + Decimal(10) ** (-DIGITS // 2))
        order = np.arange(d)
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if pivot != k:
                a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if a[k, k] == 0:
                a[k, k] = shift * Decimal(10) ** -DIGITS
            a[k + 1:, k] /= a[k, k]
            if k + 1 < d:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])

        def solve(v):
            v = v[order].copy()
            for k in range(1, d):
                v[k] -= (a[k, :k] * v[:k]).sum()
            for k in range(d - 1, -1, -1):
                v[k] = (v[k] - (a[k, k + 1:] * v[k + 1:]).sum()) / a[k, k]
            return v

        numbers, basis = random.Random(11), []
        for _ in range(size):
            v = np.array([Decimal(numbers.randint(-10 ** 6, 10 ** 6)) for _ in range(d)], object)
            for _ in range(3):
                v = solve(v)
                for _ in range(2):
                    for b in basis:
                        v = v - (v * b).sum() * b
                    v = v / (v * v).sum().sqrt()
            basis.append(v)
        out = []
        for v in basis:
            lead = max(range(d), key=lambda i: (abs(v[i]), -i))
            out.append([float(c if v[lead] > 0 else -c) for c in v])
        return out


def fit(rows: DataFrame, components: int = 4) -> tuple[Whitening, DataFrame]:
    """The whitening of the distinct vectors of ``rows`` (column ``x``), and the list of these."""
    spark = rows.sparkSession
    distinct = materialize(rows.select("x").distinct(), "whitening-fit")
    n, sums, matrix = scatter(distinct)
    trace = int(np.trace(matrix)) if len(matrix) else 0
    if n < 2 or trace == 0:
        return Whitening(n, tuple(sums), trace, (), ()), distinct
    common = math.gcd(*[int(v) for v in matrix.flat])
    small = matrix // common
    found = largest_roots(characteristic_polynomial(spark, small), min(components, len(matrix)))
    clusters = [(k, root, size) for k, (root, size) in enumerate(found)]

    def work(batches):
        for batch in batches:
            ks = batch.column(0).to_pylist()
            vectors = [null_space(small, clusters[k][1], clusters[k][2]) for k in ks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int32()), pa.array(vectors, pa.list_(pa.list_(pa.float64())))], names=["k", "v"])

    got = (spark.createDataFrame([(k,) for k, _, _ in clusters], "k int").repartition(len(clusters), "k")
           .mapInArrow(work, "k int, v array<array<double>>").collect())
    vectors = {r["k"]: r["v"] for r in got}
    pairs = [(root * common, tuple(v)) for k, root, _ in clusters for v in vectors[k]][:components]
    return Whitening(n, tuple(sums), trace, tuple(r for r, _ in pairs), tuple(v for _, v in pairs)), distinct


def _root_of(value: Fraction) -> float:
    with localcontext() as context:
        context.prec = 40
        return float((Decimal(value.numerator) / Decimal(value.denominator)).sqrt())


def _projected(model: Whitening):
    """(matrix of vectors) -> (whitened values, exact squared deviations)."""
    sums = np.array(model.sums, object)
    small = max([abs(s) for s in model.sums], default=0)
    vectors = np.array(model.components, np.float64).T
    lengths = np.array([_root_of(e) for e in model.eigenvalues])

    def run(x: np.ndarray):
        bound = _largest(x) * model.n + small
        if bound * bound * x.shape[1] < 1 << 63:
            y = x * model.n - sums.astype(np.int64)
            deviation = (y * y).sum(axis=1).tolist()
        else:
            y = x.astype(object) * model.n - sums
            deviation = [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]
        return y.astype(np.float64) @ vectors / lengths, deviation

    return run


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.components)

    def work(batches):
        project = _projected(model)
        for batch in batches:
            w, _ = project(_as_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    whitened = distinct.select("x").mapInArrow(work, ", ".join(f"w{i} double" for i in range(k)))
    mean = whitened.agg(*[F.avg(f"w{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = whitened.agg(*[F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def transform(rows: DataFrame, model: Whitening, key: str = "vec_id", error: float | None = None) -> DataFrame:
    """One row per row of ``rows`` (key, x) and component: key, component, n, deviation, whitened,
    explained, identity_error."""
    k = len(model.components)
    kind = rows.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    shares = [float(e / model.trace) for e in model.eigenvalues]

    def work(batches):
        project = _projected(model)
        for batch in batches:
            w, deviation = project(_as_matrix(batch.column(1)))
            n = len(w)
            each = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, model.n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                pa.array(w.reshape(-1)), pa.array(np.tile(shares, n)),
                pa.array([error] * (n * k), pa.float64())],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(work, schema)


def whiten(df: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened values of all usable rows of ``df`` on the largest components."""
    rows = quantised(df, key, vector)
    model, distinct = fit(rows, components)
    error = identity_error(model, distinct) if model.components else None
    return transform(rows, model, key, error)
