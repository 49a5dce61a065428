"""Values that doubles cannot hold, NaN beside NULL, and tails at many degrees of freedom."""

import math

import pytest
from pyspark.sql import functions as F

from cairn.functions.tails import chi2_sf_col
from cairn.operators.ordered import ordered_window

BIG = 2 ** 53


def test_long_ids_with_nulls_pass_unchanged(spark):
    df = spark.createDataFrame([(1, BIG + 1), (2, None), (3, BIG + 2)], "k long, v long")
    got = {r["k"]: (r["v"], r["rank"]) for r in ordered_window(df, ["v"], ["k"], num_buckets=2).collect()}
    assert got == {1: (BIG + 1, 1), 3: (BIG + 2, 2), 2: (None, 3)}


def test_nan_and_null_have_their_own_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.nan), (3, None), (4, math.nan)], "k long, v double")
    got = {r["k"]: r["rank"] for r in ordered_window(df, ["v"], ["k"], num_buckets=3).collect()}
    assert got == {1: 1, 2: 2, 4: 2, 3: 4}


def test_whole_running_sums_are_exact(spark):
    df = spark.createDataFrame([(1, BIG), (2, 1), (3, None), (4, 1)], "k long, v long")
    got = ordered_window(df, ["k"], [], sum_cols=["v"], num_buckets=2)
    assert dict(got.dtypes)["running_v"] == "bigint"
    assert {r["k"]: r["running_v"] for r in got.collect()} == {1: BIG, 2: BIG + 1, 3: BIG + 1, 4: BIG + 2}


def _wilson_hilferty(x: float, k: float) -> float:
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return math.erfc(z / math.sqrt(2)) / 2


@pytest.mark.parametrize("sds", [-4.0, -1.0, 0.0, 0.001, 2.0, 5.0])
def test_chi_square_tail_at_many_degrees_of_freedom(spark, sds):
    dofs = [9_000.0, 11_000.0, 1e5, 1e6, 1e7]
    df = spark.createDataFrame([(k, k + sds * math.sqrt(2 * k)) for k in dofs], "k double, x double")
    for r in df.withColumn("p", chi2_sf_col("x", "k")).collect():
        assert r["p"] == pytest.approx(_wilson_hilferty(r["x"], r["k"]), abs=2e-5 if r["k"] < 5e4 else 2e-6)


def test_chi_square_tail_known_values(spark):
    df = spark.createDataFrame([(1e5,), (1e6,)], "k double").withColumn("p", chi2_sf_col("k", "k"))
    assert [round(r["p"], 6) for r in df.orderBy("k").select(F.col("p")).collect()] == [0.499405, 0.499812]
