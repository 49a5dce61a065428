"""The distributed ordered window equals Spark's plain window functions."""

import datetime
import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.ordered import ntile_col, ordered_window, percent_rank_col
from cairn.operators.quantiles import exact_quantiles
from cairn.operators.ranges import key_struct, range_number
from cairn.plans.inspect import is_bounded_feed, plan_text, single_partition_feeds


@pytest.fixture(scope="module")
def skewed(spark):
    # a hot partition key (half the rows) and a hot value (a third of the rows)
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "k": np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n)),
        "v": np.where(np.arange(n) % 3 == 0, 7.0, np.round(rng.normal(0, 5, n), 1)),
        "w": rng.random(n),
    })
    pdf.loc[5:9, "v"] = np.nan
    return spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))


@pytest.mark.parametrize("buckets", [1, 5, 23])
@pytest.mark.parametrize("asc", [True, False])
def test_matches_plain_window(spark, skewed, buckets, asc):
    res = ordered_window(skewed, [("v", asc)], ["id"], partition_by=["k"], sum_cols=["w"], num_buckets=buckets)
    res = res.withColumn("pr", percent_rank_col()).withColumn("nt", ntile_col(7))
    o = F.col("v").asc_nulls_last() if asc else F.col("v").desc_nulls_last()
    w = W.partitionBy("k").orderBy(o, "id")
    wr = W.partitionBy("k").orderBy(o)
    ref = skewed.select("id", F.row_number().over(w).alias("e_rn"), F.rank().over(wr).alias("e_rank"),
                        F.dense_rank().over(wr).alias("e_dense"), F.percent_rank().over(wr).alias("e_pr"),
                        F.ntile(7).over(w).alias("e_nt"),
                        F.sum("w").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("e_run"))
    m = res.join(ref, "id").toPandas()
    assert len(m) == 3000
    assert (m.row_number == m.e_rn).all()
    assert (m["rank"] == m.e_rank).all()
    assert (m.dense_rank == m.e_dense).all()
    assert (m.nt == m.e_nt).all()
    assert np.allclose(m.pr, m.e_pr)
    assert np.allclose(m.running_w, m.e_run)


def test_global_order_no_partition(spark, skewed):
    res = ordered_window(skewed, ["v"], ["id"], num_buckets=9)
    ref = skewed.select("id", F.row_number().over(W.orderBy(F.col("v").asc_nulls_last(), "id")).alias("e"))
    m = res.join(ref, "id").toPandas()
    assert (m.row_number == m.e).all()
    assert (m.partition_rows == 3000).all()


def test_exact_quantiles_match_pandas(spark, skewed):
    q = exact_quantiles(skewed, "v", [0.0, 0.25, 0.5, 0.9, 1.0], by=["k"], num_buckets=6).toPandas()
    pdf = skewed.toPandas()
    for _, row in q.iterrows():
        s = pdf.loc[pdf.k == row.k, "v"].dropna()
        for p, name in [(0.0, "q_0_0"), (0.25, "q_0_25"), (0.5, "q_0_5"), (0.9, "q_0_9"), (1.0, "q_1_0")]:
            assert abs(row[name] - s.quantile(p)) < 1e-9


def test_plan_is_jvm_only_and_single_partitions_are_bounded(spark, skewed, tmp_path):
    skewed.write.parquet(f"{tmp_path}/t")
    res = ordered_window(spark.read.parquet(f"{tmp_path}/t"), ["v"], ["id"], partition_by=["k"], sum_cols=["w"],
                         num_buckets=4)
    plan = plan_text(res)
    assert "hashpartitioning(__r" in plan and "Scan parquet" in plan
    assert not any(x in plan for x in ("InArrow", "InPandas", "EvalPython", "ExistingRDD"))
    assert all(is_bounded_feed(f) for f in single_partition_feeds(res))


@pytest.mark.parametrize("buckets", [1, 6, 40])
def test_neighbours_and_latest_row_cross_ranges(spark, skewed, buckets):
    df = skewed.withColumn("flag", F.col("id") % 17 == 0)
    res = ordered_window(df, [("v", False)], ["id"], partition_by=["k"], num_buckets=buckets, totals=False, ranks=False,
                         lead=["id", "w"], lag=["v"], latest=("flag", ["id", "w"]))
    w = W.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), "id")
    ref = df.select(F.col("id").alias("e"), F.lead("id").over(w).alias("e_lead"), F.lead("w").over(w).alias("e_w"),
                    F.lag("v").over(w).alias("e_lag"),
                    F.last(F.when(F.col("flag"), F.col("id")), ignorenulls=True).over(w).alias("e_at"))
    bad = res.join(ref, res.id == ref.e).where(~(F.col("lead_id").eqNullSafe(F.col("e_lead"))
                                                 & F.col("lead_w").eqNullSafe(F.col("e_w"))
                                                 & F.col("lag_v").eqNullSafe(F.col("e_lag"))
                                                 & F.col("latest_id").eqNullSafe(F.col("e_at"))))
    assert res.count() == 3000 and bad.count() == 0


def test_hot_value_is_spread_over_ranges(spark):
    """Half of the rows have one key and one value: the tie-break splits them, ranks still agree."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
                                    F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") % 7).alias("v"))
    numbered = range_number(df, key_struct(df, [("k", True), ("v", True), ("id", True)]), 32)
    sizes = [r["count"] for r in numbered.groupBy("_r").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * 40_000 / 32
    res = ordered_window(df, ["v"], ["id"], partition_by=["k"], num_buckets=32)
    w = W.partitionBy("k").orderBy("v")
    ref = df.select(F.col("id").alias("e"), F.rank().over(w).alias("e_rank"), F.dense_rank().over(w).alias("e_dense"),
                    F.count("*").over(W.partitionBy("k")).alias("e_n"))
    bad = res.join(ref, res.id == ref.e).where((F.col("rank") != F.col("e_rank")) | (F.col("dense_rank") != F.col("e_dense"))
                                               | (F.col("partition_rows") != F.col("e_n")))
    assert bad.count() == 0


KINDS = {"double": [None, 1.5, math.nan, math.inf, -math.inf, -0.0, 2.25, 1e300], "long": [None, -2 ** 63, 2 ** 63 - 1, 0, 5],
         "string": [None, "", "a", "ab", "é", 'b"c', "日", "😀"], "boolean": [None, True, False],
         "date": [None, datetime.date(2020, 1, 1), datetime.date(1, 1, 1)],
         "timestamp": [None, datetime.datetime(2020, 1, 1, 1, 2, 3, 4), datetime.datetime(1970, 1, 1)],
         "timestamp_ntz": [None, datetime.datetime(2020, 1, 1, 1, 2, 3, 45), datetime.datetime(2020, 1, 1, 1, 2, 3, 5)],
         "decimal(38,10)": [None, Decimal("1.5"), Decimal("-123456789012345678901234567.5")], "binary": [None, b"", b"\x00\xff", b"a"]}


@pytest.mark.parametrize("kind", KINDS)
def test_range_numbers_follow_the_order_of_every_type(spark, kind):
    r = random.Random(kind)
    rows = [(r.choice(KINDS[kind]), r.choice(KINDS[kind]), i) for i in range(300)]
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, id int")
    for asc in (True, False):
        numbered = range_number(df, key_struct(df, [("a", asc), ("b", not asc), ("id", True)]), 29)
        order = [F.col("a").asc_nulls_last() if asc else F.col("a").desc_nulls_last(),
                 F.col("b").desc_nulls_last() if asc else F.col("b").asc_nulls_last(), F.col("id")]
        got = [x["_r"] for x in numbered.orderBy(*order).collect()]
        assert got == sorted(got) and len(set(got)) == 29


def test_types_without_an_order_are_refused(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(TypeError, match="array<int>"):
        ordered_window(df, ["a"], [])


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v double, id long")
    res = ordered_window(df, ["v"], ["id"], partition_by=["k"], sum_cols=["v"], lead=["v"], lag=["v"])
    assert res.collect() == [] and {"row_number", "rank", "partition_rows", "running_v", "lead_v"} <= set(res.columns)


def test_default_ranges_coalesced_by_aqe(spark, skewed):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        res = ordered_window(skewed, [("v", False)], ["id"], partition_by=["k"], sum_cols=["w"])
        w = W.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), "id")
        wr = W.partitionBy("k").orderBy(F.col("v").desc_nulls_last())
        ref = skewed.select("id", F.row_number().over(w).alias("e_rn"), F.rank().over(wr).alias("e_rank"),
                            F.sum("w").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("e_run"))
        m = res.join(ref, "id").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert (m.row_number == m.e_rn).all() and (m["rank"] == m.e_rank).all()
    assert np.allclose(m.running_w, m.e_run)



def test_approx_quantiles_close_to_exact(spark, skewed):
    ex = exact_quantiles(skewed, "w", [0.1, 0.5, 0.9], num_buckets=4).toPandas().iloc[0]
    ap = exact_quantiles(skewed, "w", [0.1, 0.5, 0.9], approx=True).toPandas().iloc[0]
    for c in ["q_0_1", "q_0_5", "q_0_9"]:
        assert abs(ex[c] - ap[c]) < 0.01


@pytest.mark.parametrize("buckets", [1, 7, 31])
def test_partitioned_without_totals_matches_plain_window(spark, skewed, buckets):
    # many small partition keys plus one hot key, so ranges hold many segments
    df = skewed.withColumn("k2", F.when(F.col("k") == "hot", F.lit("hot")).otherwise(
        F.concat(F.col("k"), (F.col("id") % 97).cast("string"))))
    res = ordered_window(df, [("v", True)], ["id"], partition_by=["k2"], sum_cols=["w"],
                         num_buckets=buckets, totals=False)
    assert "partition_rows" not in res.columns
    w = W.partitionBy("k2").orderBy(F.col("v").asc_nulls_last(), "id")
    wr = W.partitionBy("k2").orderBy(F.col("v").asc_nulls_last())
    ref = df.select("id", F.row_number().over(w).alias("e_rn"), F.rank().over(wr).alias("e_rank"),
                    F.dense_rank().over(wr).alias("e_dense"),
                    F.sum("w").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("e_run"))
    m = res.join(ref, "id").toPandas()
    assert len(m) == 3000
    assert (m.row_number == m.e_rn).all() and (m["rank"] == m.e_rank).all()
    assert (m.dense_rank == m.e_dense).all() and np.allclose(m.running_w, m.e_run)


@pytest.mark.parametrize("totals", [True, False])
def test_null_partition_keys_and_values(spark, totals):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(600), "k": rng.choice(["a", "b", None], 600),
                        "v": rng.choice([1.0, 2.0, np.nan], 600)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    res = ordered_window(df, ["v"], ["id"], partition_by=["k"], num_buckets=9, totals=totals)
    w = W.partitionBy("k").orderBy(F.col("v").asc_nulls_last(), "id")
    wr = W.partitionBy("k").orderBy(F.col("v").asc_nulls_last())
    ref = df.select("id", F.row_number().over(w).alias("e_rn"), F.rank().over(wr).alias("e_rank"),
                    F.dense_rank().over(wr).alias("e_dense"))
    m = res.join(ref, "id").toPandas()
    assert len(m) == 600
    assert (m.row_number == m.e_rn).all() and (m["rank"] == m.e_rank).all() and (m.dense_rank == m.e_dense).all()
