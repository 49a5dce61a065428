"""Exact quantiles by brackets against pandas and sorted lists."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.operators import quantiles
from cairn.operators.quantiles import Brackets, exact_quantiles, sketch
from cairn.plans.inspect import plan_text

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]
NAMES = ["q_0_0", "q_0_25", "q_0_5", "q_0_9", "q_1_0"]


@pytest.fixture(scope="module")
def values():
    r = np.random.default_rng(3)
    n = 20_000
    v = np.where(r.random(n) < 0.3, 7.0, np.round(r.normal(0, 50, n), 2))
    return pd.DataFrame({"k": np.where(r.random(n) < 0.5, "hot", r.choice(["a", "b", None], n)), "v": v, "i": r.integers(0, 9, n)})


def same(got, want):
    return all(a == pytest.approx(b, rel=1e-12, abs=1e-12) for a, b in zip(got, want))


@pytest.mark.parametrize("accuracy,fetch", [(10_000, 100_000), (100, 100_000), (100, 50), (20, 5)])
def test_equal_pandas_whatever_the_sketch_and_the_budget(spark, values, accuracy, fetch):
    """Coarse sketches miss ranks and small budgets force narrowing: results stay exact."""
    df = spark.createDataFrame(values).repartition(5)
    got = exact_quantiles(df, "v", PROBS, accuracy=accuracy, fetch=fetch).first()
    assert same([got[n] for n in NAMES], values.v.quantile(PROBS))
    by = {r["k"]: [r[n] for n in NAMES] for r in
          exact_quantiles(df, "v", PROBS, by=["k"], accuracy=accuracy, fetch=fetch).collect()}
    want = {k if isinstance(k, str) else None: g.v.quantile(PROBS) for k, g in values.groupby("k", dropna=False)}
    assert set(by) == set(want) and all(same(by[k], want[k]) for k in want)


def test_many_groups_take_the_ordered_pass(spark, values):
    df = spark.createDataFrame(values)
    few = exact_quantiles(df, "v", PROBS, by=["k", "i"])
    many = exact_quantiles(df, "v", PROBS, by=["k", "i"], max_groups=3, num_buckets=7)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_a_wrong_sketch_is_widened(spark):
    """Brackets that lie beside every rank: counting shows it and the search goes on."""
    data = [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    for wrong in ([900.0, 950.0], [-5.0, -4.0], [499.5, 499.6], [2000.0, 3000.0]):
        search = Brackets(df, "v", [0.5])
        search.start([{"n": 1000, "p": wrong}], "n", "p")
        assert search.run() == {(): [499.5]}
        assert search.passes <= 3


def test_odd_values(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, 5.0), (1, None), (2, None), (3, nan), (3, 1.0), (3, inf), (3, -inf), (4, -0.0), (4, 0.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: (r["q_0_0"], r["q_1_0"]) for r in exact_quantiles(df, "v", [0.0, 1.0], by=["k"]).collect()}
    assert set(got) == {1, 3, 4} and got[1] == (5.0, 5.0) and got[4] == (0.0, 0.0)
    assert got[3][0] == -inf and math.isnan(got[3][1])        # NaN is the largest value
    assert exact_quantiles(df.where("k = 2"), "v", [0.5]).collect() == []
    assert exact_quantiles(df.limit(0), "v", [0.5], by=["k"]).collect() == []
    big = spark.createDataFrame([(2 ** 53 + 1,), (2 ** 53 + 3,)], "v long")
    assert exact_quantiles(big, "v", [0.0, 1.0]).first()[1] == float(2 ** 53 + 3)


def test_random_small_groups(spark):
    r = random.Random(8)
    rows = [(g, float(r.choice([r.randint(0, 3), r.random() * 10]))) for g in range(60) for _ in range(r.randint(1, 40))]
    df = spark.createDataFrame(rows, "g int, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    got = {x["g"]: [x[n] for n in NAMES] for x in exact_quantiles(df, "v", PROBS, by=["g"], accuracy=50).collect()}
    assert all(same(got[g], x.v.quantile(PROBS)) for g, x in pdf.groupby("g"))


def test_rows_are_not_shuffled(spark, values, monkeypatch):
    """Each pass reduces rows to counts before its exchange, and there are two passes."""
    df = spark.createDataFrame(values)
    search = Brackets(df.where("v IS NOT NULL"), "v", [0.25, 0.5, 0.75])
    first = df.agg(F.count("v").alias("n"), sketch(F.col("v"), [0.25, 0.5, 0.75]).alias("p"))
    search.start(first.collect(), "n", "p")
    plans = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (plans.append(plan_text(self)), collect(self))[1])
    search.run()
    assert search.passes == len(plans) == 1
    assert "partial_count" in plans[0] and "Join" not in plans[0] and plans[0].count("Exchange") == 1
