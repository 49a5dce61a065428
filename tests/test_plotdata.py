import numpy as np
import pandas as pd
import pytest

from cairn.operators import plotdata as P

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def sample(spark):
    x = RNG.lognormal(3, 0.7, 2000)
    pdf = pd.DataFrame({"x": x, "g": RNG.choice(["a", "b", "c"], 2000)})
    return pdf, spark.createDataFrame(pdf)


def test_histogram_matches_numpy(sample):
    pdf, df = sample
    h = P.histogram(df, "x").toPandas()
    counts, edges = np.histogram(pdf.x, bins=40)
    assert len(h) == 40 and h["count"].sum() == len(pdf)
    assert (np.abs(h["count"].to_numpy() - counts) <= 1).all()  # edge rounding only
    assert np.allclose(h.bin_start, edges[:-1]) and np.allclose(h.bin_end, edges[1:])
    assert np.isclose(h["median"].iloc[0], pdf.x.median())


def test_kde_matches_gaussian_sum(sample):
    pdf, df = sample
    k = P.kde_curve(df, "x", gridsize=50).toPandas()
    x = pdf.x.to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(k.density, dens, rtol=1e-9)
    assert abs(np.trapezoid(k.density, k.x) - 1) < 0.05


def test_box_stats_match_numpy(sample):
    pdf, df = sample
    b = P.box_stats(df, "x", "g", num_buckets=3).toPandas().set_index("g")
    for g, s in pdf.groupby("g").x:
        q1, med, q3 = np.percentile(s, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = s[(s >= lo) & (s <= hi)]
        row = b.loc[g]
        assert np.isclose(row.q1, q1) and np.isclose(row["median"], med) and np.isclose(row.q3, q3)
        assert row.whisker_low == inside.min() and row.whisker_high == inside.max()
        assert row.n_fliers == ((s < lo) | (s > hi)).sum()
    assert list(b.sort_values("order").index) == list(pdf.groupby("g").x.median().sort_values(ascending=False).index)


@pytest.mark.parametrize("window", [3, 4])
def test_rolling_mean_and_pct_change_match_pandas(spark, window):
    v = pd.Series([10.0, 12.0, np.nan, 15.0, 11.0, 0.0, 9.0, 14.0])
    pdf = pd.DataFrame({"t": range(len(v)), "v": v})
    df = spark.createDataFrame(pdf)
    got = df.select("t", P.rolling_mean(df, "t", "v", window).alias("r"),
                    P.pct_change("t", "v").alias("p")).orderBy("t").toPandas()
    exp_r = v.rolling(window, center=True).mean()
    assert np.allclose(got.r.to_numpy(dtype=float), exp_r.to_numpy(), equal_nan=True)
    exp_p = v.ffill().pct_change(fill_method=None).replace([np.inf, -np.inf], np.nan)
    exp_p[v.isna()] = np.nan if False else exp_p[v.isna()]
    # pandas forward-fills the missing value; a zero previous value gives NULL here
    ours = got.p.to_numpy(dtype=float)
    assert np.allclose(ours[[1, 3, 4, 5, 7]], exp_p.to_numpy()[[1, 3, 4, 5, 7]], equal_nan=True)
    assert np.isnan(ours[6])  # previous value 0 -> NULL (pandas: inf)


def test_ranked_top_is_nlargest(spark):
    s = pd.Series([5.0, 9.0, np.nan, 7.0, 9.0, 1.0], index=list("abcdef"))
    df = spark.createDataFrame(pd.DataFrame({"k": s.index, "v": s.values}))
    got = P.ranked_top(df, "k", "v", n=3).toPandas()
    assert list(got.k) == list(s.nlargest(3).index) and list(got["rank"]) == [1, 2, 3]
