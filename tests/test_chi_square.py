"""Chi-square on counts that products of 64-bit margins cannot hold, and on sparse tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cairn.operators import stats

SCHEMA = "r string, c string, n long"


def exact(cells, yates):
    """chi2 in rational arithmetic over the whole grid."""
    rows, cols = {}, {}
    for (r, c), o in cells.items():
        rows[r] = rows.get(r, 0) + o
        cols[c] = cols.get(c, 0) + o
    n, total = sum(rows.values()), Fraction(0)
    for r in rows:
        for c in cols:
            e = Fraction(rows[r] * cols[c], n)
            d = abs(cells.get((r, c), 0) - e)
            total += (max(d - Fraction(1, 2), 0) if yates and len(rows) == len(cols) == 2 else d) ** 2 / e
    return float(total)


CASES = {
    "2x2 above 3e9": {("a", "x"): 4_000_000_000, ("a", "y"): 3_900_000_000, ("b", "x"): 3_900_000_000, ("b", "y"): 4_000_000_123},
    "2x2 near 1e18, nearly independent": {("a", "x"): 10 ** 18, ("a", "y"): 10 ** 18 + 10 ** 9, ("b", "x"): 10 ** 18, ("b", "y"): 10 ** 18},
    "2x2 with an empty cell": {("a", "x"): 5, ("a", "y"): 7, ("b", "y"): 11},
    "3x4 sparse and large": {("a", "w"): 5 * 10 ** 9, ("b", "x"): 7 * 10 ** 9, ("c", "y"): 3, ("c", "z"): 4 * 10 ** 10, ("a", "z"): 1},
    "3x2": {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5, ("c", "x"): 1, ("c", "y"): 2},
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("yates", [True, False])
def test_equals_rational_arithmetic(spark, name, yates):
    cells = CASES[name]
    df = spark.createDataFrame([(r, c, o) for (r, c), o in cells.items()], SCHEMA)
    got = stats.chi_square_test(df, "r", "c", yates=yates, count_col="n").first()
    want = exact(cells, yates)
    assert got["chi2"] == pytest.approx(want, rel=1e-9, abs=1e-4)
    small = min(len({r for r, _ in cells}), len({c for _, c in cells})) - 1
    v = stats.cramers_v(df, "r", "c", yates=yates, count_col="n").first()["cramers_v"]
    assert v == pytest.approx(math.sqrt(want / (sum(cells.values()) * small)), rel=1e-9)


def test_many_groups_and_values(spark):
    r = np.random.default_rng(1)
    rows = [(int(g), str(a), str(b)) for g, a, b in zip(r.integers(0, 5, 3000), r.integers(0, 40, 3000), r.integers(0, 30, 3000))]
    got = stats.chi_square_test(spark.createDataFrame(rows, "g int, r string, c string"), "r", "c", by=["g"]).collect()
    for x in got:
        cells = {}
        for g, a, b in rows:
            if g == x["g"]:
                cells[a, b] = cells.get((a, b), 0) + 1
        assert x["chi2"] == pytest.approx(exact(cells, False), abs=1e-3)
    assert len(got) == 5


def test_one_row_or_column_and_no_rows(spark):
    one = spark.createDataFrame([("a", "x", 3), ("a", "y", 4)], SCHEMA)
    got = stats.chi_square_test(one, "r", "c", count_col="n").first()
    assert (got["chi2"], got["p_value"], got["dof"], got["cramers_v"]) == (0.0, 1.0, 0, 0.0)
    assert stats.chi_square_test(one.limit(0), "r", "c", count_col="n").count() <= 1
