"""The kernel density's cell sums against kernels added one by one; Student's tail at many degrees of freedom."""

import math

import numpy as np
import pytest

from cairn.functions.dist import t_sf_two_sided
from cairn.functions.tails import t_two_sided_col
from cairn.operators.plotdata import kde_curve

SAMPLES = {
    "normal": np.random.default_rng(1).normal(5, 2, 4000),
    "two far groups": np.concatenate([np.random.default_rng(2).normal(0, 1, 500), np.random.default_rng(3).normal(1e6, 1, 500)]),
    "few values": np.repeat([1.0, 2.0, 7.5], [100, 50, 3]),
    "long tail": np.random.default_rng(4).pareto(1.2, 3000),
    "two rows": np.array([0.0, 3.0]),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_kde_equals_the_sum_of_kernels(spark, name):
    x = SAMPLES[name]
    got = kde_curve(spark.createDataFrame([(float(v),) for v in x], "v double").repartition(3), "v").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.array([np.exp(-0.5 * ((g - x) / h) ** 2).sum() for g in grid]) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["point"] for r in got] == list(range(200))
    assert np.allclose([r["x"] for r in got], grid, rtol=1e-12, atol=1e-9)
    assert np.allclose([r["density"] for r in got], want, rtol=1e-9, atol=1e-14 / h)


def test_kde_of_a_constant_or_nothing(spark):
    assert kde_curve(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v").collect() == []
    assert kde_curve(spark.createDataFrame([], "v double"), "v").collect() == []


def test_t_tail_meets_the_fraction_and_the_normal_limit(spark):
    ts = [0.0, 0.01, 0.5, 1.0, 1.96, 3.0, 5.0, 8.0]
    df = spark.createDataFrame([(t, d) for t in ts for d in (4999.0, 5000.0, 20_000.0, 300_000.0)], "t double, d double")
    for r in df.withColumn("p", t_two_sided_col("t", "d")).collect():
        assert r["p"] == pytest.approx(t_sf_two_sided(r["t"], r["d"]), rel=1e-7, abs=1e-12)
    far = spark.createDataFrame([(t, d) for t in ts for d in (1e9, 1e11, 1e13)], "t double, d double")
    for r in far.withColumn("p", t_two_sided_col("t", "d")).collect():
        assert r["p"] == pytest.approx(math.erfc(r["t"] / math.sqrt(2)), abs=1e-9, rel=1e-6)
