"""The reference's statistics tests restated (plain bools), plus edge cases and
p-values pinned to published table values."""

import math

import numpy as np
import pandas as pd
import pytest

from cairn.functions.dist import chi2_sf, mwu_exact_sf, norm_sf, t_sf_two_sided
from cairn.operators import stats as S

RNG = np.random.default_rng(0)
A = RNG.normal(50, 10, 100)
B = RNG.normal(60, 10, 100)
C = RNG.normal(50.1, 10, 100)


@pytest.fixture(scope="module")
def groups(spark):
    pdf = pd.DataFrame({"g": ["A"] * 100 + ["B"] * 100 + ["C"] * 100, "v": np.r_[A, B, C]})
    return spark.createDataFrame(pdf)


def one(df):
    rows = df.toPandas()
    assert len(rows) == 1
    return rows.iloc[0]


def test_describe_keys_count_and_missing(spark):
    s = pd.Series(A.copy())
    s.iloc[:10] = np.nan
    r = one(S.describe_numeric(spark.createDataFrame(pd.DataFrame({"v": s})), "v", num_buckets=3))
    for k in S.DESCRIBE_KEYS:
        assert k in r.index
    assert r["count"] == 90 and r["missing"] == 10 and r["missing_pct"] == 10.0
    assert r["mean"] == round(s.mean(), 4) and r["median"] == round(s.median(), 4)
    assert r["skewness"] == round(s.skew(), 4) and r["kurtosis"] == round(s.kurtosis(), 4)


def test_describe_constant_and_empty(spark):
    r = one(S.describe_numeric(spark.createDataFrame(pd.DataFrame({"v": [5.0] * 10})), "v"))
    assert r["std"] == 0.0 and r["skewness"] == 0.0 and r["kurtosis"] == 0.0 and r["iqr"] == 0.0
    empty = spark.createDataFrame([], "v double")
    assert S.describe_numeric(empty, "v").count() in (0, 1)


def test_ttest_detects_difference(groups):
    r = one(S.two_sample_ttest(groups, "v", "g", "A", "B"))
    assert r["significant"] is True or r["significant"] == True  # noqa: E712
    assert isinstance(bool(r["significant"]), bool) and r["p_value"] < 0.05
    for k in ["t_stat", "p_value", "significant", "cohen_d", "effect_size", "interpretation"]:
        assert k in r.index
    assert r["effect_size"] in ["negligible", "small", "medium", "large"]


def test_ttest_no_difference(groups):
    r = one(S.two_sample_ttest(groups, "v", "g", "A", "C"))
    assert not r["significant"]
    assert r["interpretation"].startswith("No significant difference (p=")


def test_ttest_degenerate_groups(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": ["A"] * 50 + ["B"], "v": [5.0] * 51}))
    r = one(S.two_sample_ttest(df, "v", "g", "A", "B"))
    assert pd.isna(r["t_stat"]) and pd.isna(r["p_value"]) and not r["significant"]


def test_mann_whitney(groups):
    r = one(S.mann_whitney_test(groups, "v", "g", "A", "B", num_buckets=3))
    assert r["significant"]
    assert r["median_a"] == round(float(np.median(A)), 4)
    assert r["median_b"] == round(float(np.median(B)), 4)


def test_mann_whitney_all_tied_and_exact(spark):
    tied = spark.createDataFrame(pd.DataFrame({"g": ["A"] * 20 + ["B"] * 20, "v": [1.0] * 40}))
    assert one(S.mann_whitney_test(tied, "v", "g", "A", "B"))["p_value"] == 1.0
    small = spark.createDataFrame(pd.DataFrame({"g": ["A"] * 3 + ["B"] * 4, "v": [1.5, 2.7, 9.1, 3.3, 4.4, 5.5, 0.2]}))
    r = one(S.mann_whitney_test(small, "v", "g", "A", "B"))
    assert r["u_stat"] == 6.0 and r["p_value"] == 1.0


def test_mann_whitney_exact_at_any_size(spark):
    from itertools import combinations
    from math import comb
    for m, n in ((1, 6), (2, 5), (3, 4), (4, 4), (5, 3)):
        us = [sum(c) - m * (m - 1) // 2 for c in combinations(range(m + n), m)]
        for u in range(-1, m * n + 2):
            assert abs(mwu_exact_sf(u, m, n) - sum(x >= u for x in us) / len(us)) < 1e-15
    assert mwu_exact_sf(8 * 1300, 8, 1300) == 1 / comb(1308, 8)
    assert abs(mwu_exact_sf(4 * 10 ** 9, 8, 10 ** 9) - 0.5) < 1e-8
    for value, p in ((20_000.5, 2 / 10_002), (4.5, 12 / 10_002)):  # a rare group of one against 10,001
        df = spark.range(10_001).selectExpr("'B' g", "cast(id as double) v").unionByName(
            spark.createDataFrame([("A", value)], "g string, v double"))
        assert one(S.mann_whitney_test(df, "v", "g", "A", "B"))["p_value"] == round(p, 6)


def test_cohens_d(spark):
    a = RNG.normal(0, 1, 200)
    b = RNG.normal(3, 1, 200)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 200 + ["b"] * 200, "v": np.r_[a, b]}))
    d = one(S.cohens_d(df, "v", "g", "a", "b"))["cohen_d"]
    assert abs(d) > 0.8 and d < 0  # signed: mean_a - mean_b
    zero = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 50 + ["b"] * 50, "v": [5.0] * 100}))
    assert one(S.cohens_d(zero, "v", "g", "a", "b"))["cohen_d"] == 0.0


def test_cramers_v_range_and_chi_square(spark):
    ct = pd.DataFrame({"r": RNG.choice(["A", "B", "C"], 200), "c": RNG.choice(["X", "Y"], 200)})
    v = one(S.cramers_v(spark.createDataFrame(ct), "r", "c"))["cramers_v"]
    assert 0.0 <= v <= 1.0
    rows = [("q0", "t0")] * 49 + [("q0", "t1")] * 9 + [("q1", "t0")] * 299 + [("q1", "t1")] * 42
    r = one(S.chi_square_test(spark.createDataFrame(pd.DataFrame(rows, columns=["r", "c"])), "r", "c"))
    # Yates-corrected 2x2 by hand
    tab = np.array([[49, 9], [299, 42]], float)
    e = np.outer(tab.sum(1), tab.sum(0)) / tab.sum()
    chi = (np.maximum(np.abs(tab - e) - 0.5, 0) ** 2 / e).sum()
    assert r["chi2"] == round(chi, 4) and r["dof"] == 1
    assert abs(r["p_value"] - chi2_sf(chi, 1)) < 1e-6


def test_chi_square_one_category_is_dof_zero(spark):
    df = spark.createDataFrame(pd.DataFrame({"r": ["a"] * 10, "c": ["x", "y"] * 5}))
    r = one(S.chi_square_test(df, "r", "c"))
    assert r["dof"] == 0 and r["chi2"] == 0.0 and r["p_value"] == 1.0 and r["cramers_v"] == 0.0


def test_effect_labels(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.6,), (0.9,), (-0.9,)], "d double")
    from pyspark.sql import functions as F
    got = [r.l for r in df.select(S.interpret_cohens_d(F.col("d")).alias("l")).collect()]
    assert got == ["negligible", "small", "medium", "large", "large"]


def test_tail_functions_published_values():
    assert abs(t_sf_two_sided(2.0, 10) - 0.0734) < 5e-5
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(chi2_sf(10.0, 4) - 0.0404) < 5e-5
    assert abs(norm_sf(1.959963984540054) - 0.025) < 1e-12
    assert abs(mwu_exact_sf(12, 3, 4) - 1 / 35) < 1e-15


def test_correlation_matches_pandas(spark):
    x = pd.DataFrame({"x": RNG.normal(size=300), "y": RNG.normal(size=300)})
    x["z"] = x.x * 0.5 + RNG.normal(size=300)
    x.loc[:9, "y"] = np.nan
    df = spark.createDataFrame(x)
    for method in ("pearson", "spearman"):
        m = S.correlation_matrix(df, ["x", "y", "z"], method=method, num_buckets=3).toPandas()
        ref = x.corr(method=method)
        for _, row in m.iterrows():
            assert abs(row["corr"] - ref.loc[row.col_a, row.col_b]) < 1e-9
        diag = m[m.col_a == m.col_b]
        assert (diag.p_value == 1.0).all()


def test_correlation_min_periods_and_constant(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(10.0), "b": [1.0] * 10}))
    m = S.correlation_matrix(df, ["a", "b"], min_periods=5).toPandas().set_index(["col_a", "col_b"])
    assert pd.isna(m.loc[("a", "b"), "corr"]) and pd.isna(m.loc[("b", "b"), "corr"])
    m2 = S.correlation_matrix(df, ["a", "b"], min_periods=30).toPandas().set_index(["col_a", "col_b"])
    assert m2.loc[("a", "b"), "p_value"] == 1.0 and pd.isna(m2.loc[("a", "a"), "corr"])


def test_kendall_matches_brute_force(spark):
    from cairn.operators.kendall import kendall_p_exact, kendall_pairs
    x = RNG.integers(0, 6, 120).astype(float)
    y = (x + RNG.integers(0, 4, 120)).astype(float)
    pdf = pd.DataFrame({"x": x, "y": y})

    def brute(a, b):
        n = len(a)
        s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i + 1, n))
        tot = n * (n - 1) / 2
        _, ta = np.unique(a, return_counts=True)
        _, tb = np.unique(b, return_counts=True)
        return s / math.sqrt((tot - (ta * (ta - 1) / 2).sum()) * (tot - (tb * (tb - 1) / 2).sum()))

    for bits, merge in ((20, 3), (2, 3), (3, 1)):  # one range, and several merges
        r = kendall_pairs(spark.createDataFrame(pdf), ["x", "y"], num_buckets=3, block_bits=bits,
                          merge_bits=merge).toPandas()
        got = r[(r.col_a == "x") & (r.col_b == "y")]["corr"].iloc[0]
        assert abs(got - brute(x, y)) < 1e-12
    # exact null distribution: n = 5, at most 2 discordant pairs -> 2 * 14 / 120
    assert abs(kendall_p_exact(5, 2) - 28 / 120) < 1e-15
    # every permutation of 6 values, and the far ends
    from itertools import combinations, permutations
    counts = [sum(a > b for a, b in combinations(p, 2)) for p in permutations(range(6))]
    for c in range(8):
        assert abs(kendall_p_exact(6, c) - min(1.0, 2 * sum(k <= c for k in counts) / 720)) < 1e-15
    assert kendall_p_exact(100, 1) == 2 / math.factorial(99) and kendall_p_exact(10 ** 6, 1) == 0.0


def test_kendall_continuous_columns_with_nulls_and_repeats(spark):
    """Continuous values, a third of the rows one point, NULL and NaN: an inversion count by a sorted list beside it."""
    from bisect import bisect_right, insort
    from cairn.operators.kendall import kendall_pairs
    rng = np.random.default_rng(11)
    n = 900
    x, y = rng.normal(size=n), rng.normal(size=n)
    y = x * 0.4 + y
    x[:300], y[:300] = 0.25, -0.5
    z = np.round(rng.normal(size=n), 1)
    rows = [(None if i % 17 == 0 else float(x[i]), float("nan") if i % 29 == 0 else float(y[i]), float(z[i]), 3.0)
            for i in range(n)]
    df = spark.createDataFrame(rows, "x double, y double, z double, c double")

    def tau(a, b):
        kept = sorted((r[a], r[b]) for r in rows if r[a] is not None and not math.isnan(r[a])
                      and r[b] is not None and not math.isnan(r[b]))
        seen, dis = [], 0
        for _, v in kept:                       # earlier points with a larger second value
            dis += len(seen) - bisect_right(seen, v)
            insort(seen, v)
        total = len(kept) * (len(kept) - 1) // 2

        def tied(values):
            return sum(k * (k - 1) // 2 for k in pd.Series(values).value_counts())

        tx, ty, both = tied([k[0] for k in kept]), tied([k[1] for k in kept]), tied(kept)
        return len(kept), (total - tx - ty + both - 2 * dis) / math.sqrt((total - tx) * (total - ty))

    r = kendall_pairs(df, ["x", "y", "z", "c"], num_buckets=5, block_bits=5, merge_bits=2).toPandas()
    got = {(a, b): (k, v) for a, b, k, v in zip(r.col_a, r.col_b, r.n, r["corr"])}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        want_n, want = tau(i, j)
        k, v = got["xyzc"[i], "xyzc"[j]]
        assert k == want_n and abs(v - want) < 1e-12
    assert got["x", "x"][1] == 1.0 and pd.isna(got["c", "c"][1]) and pd.isna(got["x", "c"][1])
    one = kendall_pairs(df, ["y"]).toPandas()
    assert list(one["corr"]) == [1.0] and list(one.n) == [sum(not math.isnan(r[1]) for r in rows)]
    assert kendall_pairs(df.limit(0), ["x", "y"]).toPandas().n.tolist() == [0, 0, 0]


def test_chi_square_from_contingency_table(spark):
    rows = [("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 5 + [("b", "y")] * 25
    raw = spark.createDataFrame(pd.DataFrame(rows, columns=["r", "c"]))
    table = S.crosstab(raw, "r", "c")
    a = S.chi_square_test(raw, "r", "c").toPandas().iloc[0]
    b = S.chi_square_test(table, "r", "c", count_col="n").toPandas().iloc[0]
    assert a["chi2"] == b["chi2"] and a["p_value"] == b["p_value"] and a["cramers_v"] == b["cramers_v"]
