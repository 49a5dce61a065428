"""Whitening (11) against numpy's eigenvectors, exact integer sums and polynomials with known roots."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import op11_whitening as op


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    if extra:
        for c in ("x", "component", "n", "d", "i", "k", "p0", "whitened"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def integers(v):
    return [math.floor(256 * c) for c in v]


def brute(vectors):
    """n, sums, deviation by vector, eigenvalues and eigenvectors (falling) of the distinct vectors."""
    unique = sorted({tuple(integers(v)) for v in vectors})
    x = np.array(unique, float)
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    n, sums = len(unique), [sum(c) for c in zip(*unique)]
    return n, sums, value[::-1], vector[:, ::-1]


@pytest.mark.parametrize("dims", [2, 5, 16])
def test_whitened_values_equal_those_of_floating_eigenvectors(spark, dims):
    r = np.random.default_rng(dims)
    base = (r.normal(size=(60, dims)) * np.linspace(0.2, 2, dims)).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(7, base[3]), (None, base[4])] + [(500 + i, base[0]) for i in range(40)]
    got = op.whiten(table(spark, rows, extra=True)).collect()
    n, sums, value, vector = brute(base)
    k = min(4, dims)
    assert len(got) == k * len(rows) and {g["n"] for g in got} == {n}
    want_share = value / value.sum()
    sign = {}
    by_vector = {}
    for g in got:
        by_vector.setdefault((g["vec_id"], g["deviation"]), {})[g["component"]] = g
    source = {}
    for i, v in rows:
        x = integers(v)
        source[(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)))] = np.array(x, float)
    assert set(by_vector) == set(source)
    for key, parts in by_vector.items():
        for c, g in parts.items():
            want = (source[key] - np.array(sums) / n) @ vector[:, c - 1] / math.sqrt(value[c - 1])
            if abs(want) > 1e-3:
                sign.setdefault(c, math.copysign(1, want * g["whitened"]))
                assert g["whitened"] == pytest.approx(sign[c] * want, abs=1e-9)
            assert g["explained"] == pytest.approx(want_share[c - 1], rel=1e-9)
            assert 0 <= g["identity_error"] < 1e-9


def test_polynomial_by_primes_is_exact(spark):
    r = np.random.default_rng(2)
    for d in (1, 2, 3, 9):
        a = r.integers(-10 ** 9, 10 ** 9, (d, d)).astype(object)
        m = a @ a.T
        if d == 9:
            m[:, 4] = m[4, :] = 0      # columns that need no step or another pivot
        got = op.characteristic_polynomial(spark, m)
        # Faddeev and LeVerrier's recurrence, in whole numbers
        c, b = [1], np.zeros((d, d), object)
        for k in range(1, d + 1):
            b = m @ b + c[-1] * np.eye(d, dtype=int).astype(object)
            c.append(-int(np.trace(m @ b)) // k)
        assert got == c[::-1]


def test_primes_and_hessenberg_with_a_permuted_pivot():
    ps = op.primes_above(10 ** 40)
    assert len(set(ps)) == len(ps) and math.prod(ps) > 10 ** 40
    assert all(p % q for p in ps for q in range(3, 46400, 2))
    m = np.array([[2, 0, 1], [0, 3, 1], [1, 1, 4]], object)
    p = ps[0]
    assert op.polynomial_mod(m, p) == [c % p for c in (-19, 24, -9, 1)]


def poly_of(roots):
    c = [1]
    for r in roots:
        c = [(a if i else 0) for i, a in enumerate([0] + c)]
        for i in range(len(c) - 1):
            c[i] -= r * c[i + 1]
    return c


def test_roots_are_isolated_and_counted():
    roots = [0, 0, 1, 5, 5, 9, 10 ** 12, 10 ** 12 + 1]
    poly = poly_of(roots)
    for point in (0, 1, 4, 5, 9, 10 ** 12):
        assert op.roots_beyond(poly, point) == sum(r > point for r in roots)
    got = op.largest_roots(poly, 5)
    assert [m for _, m in got] == [1, 1, 1, 2]
    for (value, _), want in zip(got, (10 ** 12 + 1, 10 ** 12, 9, 5)):
        assert abs(value - want) <= Fraction(want, 1 << op.CLUSTER_BITS - 2)
    assert op.largest_roots(poly_of([0, 0, 3]), 4) == [(3, 1)]
    assert op.largest_roots([0, 0, 1], 4) == []


def test_equal_and_close_eigenvalues(spark):
    axes = [[1.0 if i == j else 0.0 for i in range(5)] for j in range(5)]
    got = op.whiten(table(spark, [(j, a) for j, a in enumerate(axes)])).collect()
    # four equal eigenvalues: any orthonormal basis whitens
    assert len(got) == 20
    assert all(g["explained"] == pytest.approx(0.25, rel=1e-12) and g["identity_error"] < 1e-12 for g in got)
    w = {(g["vec_id"], g["component"]): g["whitened"] for g in got}
    for a in range(1, 5):
        for b in range(1, 5):
            assert sum(w[i, a] * w[i, b] for i in range(5)) / 5 == pytest.approx(float(a == b), abs=1e-9)
    # eigenvalues that differ in the ninth digit have their own directions
    big = [(0, [40000.0, 0.0]), (1, [-40000.0, 0.0]), (2, [0.0, 39999.99609375]), (3, [0.0, -39999.99609375])]
    for g in op.whiten(table(spark, big)).collect():
        assert abs(g["whitened"]) == pytest.approx(math.sqrt(2) if (g["vec_id"] < 2) == (g["component"] == 1) else 0, abs=1e-9)


def test_sums_beyond_64_bits_stay_exact():
    r = np.random.default_rng(5)
    x = r.integers(-2 ** 62, 2 ** 62, (50, 3))
    x[0] = [-2 ** 63, 2 ** 63 - 1, 0]
    want = x.astype(object).T @ x.astype(object)
    assert (op.exact_products(x) == want).all()
    assert (op.exact_products(x % 1000) == (x % 1000).astype(object).T @ (x % 1000).astype(object)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (2, [1.5, -1.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [1.0, nan, 0.0]),
            (7, [inf, 0.0, 0.0]), (8, [1.0, 2.0]), (2, [1.5, -1.0, 0.0]), (None, [0.5, 1.0, 2.0])]
    got = op.whiten(table(spark, rows, extra=True)).collect()
    # two different vectors: one component, the two at +1 and -1
    assert sorted((g["vec_id"] or -1, g["component"]) for g in got) == [(-1, 1), (1, 1), (2, 1), (2, 1)]
    assert all(abs(g["whitened"]) == pytest.approx(1) and g["explained"] == 1.0 and g["n"] == 2 for g in got)
    huge = op.whiten(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])])).collect()
    assert len(huge) == 6 and all(g["deviation"] is None for g in huge if g["vec_id"] < 3)
    for none in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = op.whiten(table(spark, none))
        assert df.collect() == []
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
