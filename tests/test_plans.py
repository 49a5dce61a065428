"""Physical-plan checks: pushdown, top-k, broadcast of bounded sides, no
single-partition exchange over fact-size input."""

import pytest

from cairn.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_filter_and_columns_reach_the_scan(spark, sf_small):
    p = plan(QUERIES["monthly_revenue"](spark, sf_small))
    assert "PushedFilters: [EqualNullSafe(o_orderstatus,F)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in p


def test_top_products_is_take_ordered(spark, sf_small):
    p = plan(QUERIES["top_products_return_rate"](spark, sf_small))
    assert "TakeOrderedAndProject" in p
    assert "BroadcastExchange" in p or "BroadcastHashJoin" in p


@pytest.mark.parametrize("key", ["rank_basic", "order_sequence", "order_value_distribution", "purchase_last_click",
                                 "customer_rank_by_country"])
def test_ordered_queries_run_on_range_windows_in_the_jvm(spark, sf_small, key):
    p = plan(QUERIES[key](spark, sf_small))
    assert "hashpartitioning(__r" in p and "Window" in p
    assert not any(x in p for x in ("InArrow", "InPandas", "EvalPython"))
    if key in ("rank_basic", "order_sequence", "purchase_last_click"):   # table scans: nothing is written first
        assert "Scan ExistingRDD" not in p


@pytest.mark.parametrize("key", ["order_value_distribution", "customer_ltv_segments", "rank_basic",
                                 "customer_rank_by_country", "describe_extendedprice",
                                 "mann_whitney_quantity_linestatus", "order_sequence", "purchase_last_click"])
def test_single_partition_exchanges_are_fed_by_bounded_rows(spark, sf_small, key):
    from cairn.plans.inspect import is_bounded_feed, single_partition_feeds
    feeds = single_partition_feeds(QUERIES[key](spark, sf_small))
    assert all(is_bounded_feed(f) for f in feeds), feeds


def test_plain_global_window_would_be_flagged(spark, sf_small):
    from pyspark.sql import Window, functions as F
    from cairn.plans.inspect import is_bounded_feed, single_partition_feeds
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    df = li.select("l_orderkey", F.row_number().over(Window.orderBy("l_extendedprice")).alias("rn"))
    feeds = single_partition_feeds(df)
    assert feeds and not all(is_bounded_feed(f) for f in feeds)
