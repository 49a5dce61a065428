import datetime as dt

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cairn.functions import scalar as S


def test_sql_round_matches_duckdb(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.integers(1, 100000, 5000) / 100.0 * ((40 + rng.integers(0, 26, 5000)) / 100.0),
              [1.005, 2.675, 0.125, -1.005, -2.5, 0.0]]
    pdf = pd.DataFrame({"i": np.arange(len(x)), "x": x})
    con = duckdb.connect()
    con.register("t", pdf)
    ref = con.execute("SELECT i, ROUND(x, 2) AS r FROM t ORDER BY i").df()["r"].to_numpy()
    got = spark.createDataFrame(pdf).select("i", S.sql_round("x", 2).alias("r")).orderBy("i").toPandas()["r"]
    assert (got.to_numpy() == ref).all()


def test_month_and_day_diff_count_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31), dt.datetime(2024, 3, 1)),
                                (dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(S.month_diff("a", "b").alias("m"), S.day_diff("a", "b").alias("d")).collect()
    assert (r[0].m, r[1].d) == (2, 1)


def test_cut_is_right_closed(spark):
    vals = [49, 50, 59, 60, 89, 90, None]
    df = spark.createDataFrame([(v,) for v in vals], "a int")
    got = [r.g for r in df.select(S.cut("a", [49, 59, 69, 79, 89], ["50-59", "60-69", "70-79", "80-89"]).alias("g")).collect()]
    exp = pd.cut(pd.Series(vals, dtype="float"), [49, 59, 69, 79, 89], labels=["50-59", "60-69", "70-79", "80-89"])
    assert got == [None if pd.isna(e) else e for e in exp]


def test_nan_null_clip_safe_div(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (5.0, 2.0), (150.0, 0.0)], "x double, y double")
    r = df.select(S.nan_to_null("x").alias("n"), S.clip("x", 0, 100).alias("c"), S.safe_div("x", "y").alias("q")).collect()
    assert r[0].n is None and r[1].c == 5.0 and r[2].c == 100.0
    assert r[0].q is None and r[1].q == 2.5 and r[2].q is None


def test_numeric_columns_excludes_bool_and_string(spark):
    df = spark.createDataFrame([(1, 2.0, True, "a")], "a int, b double, c boolean, d string")
    assert S.numeric_columns(df) == ["a", "b"]


def test_np_round_is_half_even_on_scaled_value(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    got = [r.r for r in df.select(S.np_round("x", 2).alias("r")).collect()]
    assert got == list(np.round([0.125, 0.375, 2.5], 2))


def test_parse_datetime_tries_formats_in_order(spark):
    import datetime as dt

    from cairn.functions.scalar import parse_datetime
    texts = ["2024-02-29", "29/02/2024 07:05", " 2024-01-02 ", "2023-02-29", "later", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_datetime("t", ["yyyy-MM-dd", "dd/MM/yyyy HH:mm"])).collect()]
    assert got == [dt.datetime(2024, 2, 29), dt.datetime(2024, 2, 29, 7, 5), dt.datetime(2024, 1, 2), None, None, None, None]


def test_choose_takes_the_first_condition_that_holds(spark):
    import pytest
    from pyspark.sql import functions as F

    from cairn.functions.scalar import choose
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "x int")
    got = [r[0] for r in df.select(choose([F.col("x") > 8, F.col("x") > 3], [F.lit("high"), F.lit("mid")], F.lit("low"))).collect()]
    assert got == ["low", "mid", "high", "low"]
    with pytest.raises(ValueError):
        choose([], [])
