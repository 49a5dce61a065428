"""Cohort retention: table, matrix, average curve and summary; MoM summary.

Plan: completed orders are reduced to the set of active months per customer
(``collect_set`` combines map-side, and a set holds at most one entry per
calendar month, so a customer with a third of all orders is still one small
row).  The cohort is the set's minimum — the reference's self-join on
``first_orders`` becomes an expression, with one shuffle by customer and no
join.  Counting rows per (cohort, period) then equals counting distinct
customers, because each customer contributes each active month once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import month_diff, month_label, month_name_label, month_start, safe_div, sql_round
from cairn.operators.sales import completed_orders, monthly_orders_revenue

PERIOD_LABEL_PREFIX = "Month "


def customer_months(orders: DataFrame) -> DataFrame:
    """(customer_id, cohort_month, order_month): one row per active month."""
    active = (completed_orders(orders)
              .groupBy("customer_id")
              .agg(F.collect_set(month_start("order_date")).alias("months")))
    return active.select("customer_id",
                         F.array_min("months").alias("cohort_month"),
                         F.explode("months").alias("order_month"))


def cohort_retention(orders: DataFrame) -> DataFrame:
    """cohort_month, cohort_size, months_since_first, active_customers, retention_pct."""
    cm = customer_months(orders)
    counts = (cm.groupBy("cohort_month",
                         month_diff("cohort_month", "order_month").alias("months_since_first"))
              .agg(F.count(F.lit(1)).alias("active_customers")))
    # one row per (cohort, period): the cohort-size window is over a small table
    size = F.max(F.when(F.col("months_since_first") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month"))
    return (counts.withColumn("cohort_size", size)
            .where(F.col("cohort_size").isNotNull())
            .select("cohort_month", "cohort_size", "months_since_first", "active_customers",
                    sql_round(F.col("active_customers") / F.col("cohort_size") * 100, 1).alias("retention_pct"))
            .orderBy("cohort_month", "months_since_first"))


def cohort_grid(retention: DataFrame) -> DataFrame:
    """The cohort matrix in long form: one row per cohort (``yyyy-MM``) and period (``Month k``) that
    any cohort has, with NULL where that cohort has no such period.

    A cohort's cells are one map (a cell per calendar month at most), so the set of periods is
    gathered from as many rows as there are cohorts.
    """
    cells = retention.groupBy("cohort_month").agg(
        F.map_from_entries(F.collect_list(F.struct("months_since_first", "retention_pct"))).alias("cells"))
    periods = F.array_distinct(F.flatten(F.collect_list(F.map_keys("cells")).over(Window.partitionBy())))
    return (cells.withColumn("periods", periods).withColumn("k", F.explode("periods"))
            .select(month_label("cohort_month").alias("cohort"),
                    F.concat(F.lit(PERIOD_LABEL_PREFIX), F.col("k").cast("string")).alias("period"),
                    F.col("cells")[F.col("k")].alias("retention_pct")))


def cohort_matrix(retention: DataFrame, periods: list[int]) -> DataFrame:
    """Pivot: one row per cohort (``yyyy-MM``), one ``Month k`` column for each of ``periods``.

    Cells are the mean retention (one value per cell); absent cells are NULL.
    """
    labels = [f"{PERIOD_LABEL_PREFIX}{p}" for p in periods]
    src = retention.select(month_label("cohort_month").alias("cohort"),
                           F.concat(F.lit(PERIOD_LABEL_PREFIX), F.col("months_since_first").cast("string"))
                           .alias("period"),
                           "retention_pct")
    return src.groupBy("cohort").pivot("period", labels).agg(F.avg("retention_pct")).orderBy("cohort")


def retention_curve(retention: DataFrame) -> DataFrame:
    """Unweighted mean retention per period over the cohorts that reach it.

    retention_pct has exactly one decimal, so the mean is taken over integer
    tenths: exact and independent of summation order.
    """
    tenths = F.round(F.col("retention_pct") * 10).cast("bigint")
    return (retention.groupBy(F.col("months_since_first").alias("month"))
            .agg((F.sum(tenths) / F.count(F.lit(1)) / F.lit(10.0)).alias("avg_retention_pct"))
            .orderBy("month"))


def retention_summary(retention: DataFrame) -> DataFrame:
    """One row: cohorts, max period, month-1 mean, floor (minimum and last period), M0->M1 drop.

    The reference prints two different "floors": the minimum of the curve and
    its last point; both are returned, named apart.
    """
    curve = retention_curve(retention)
    cohorts = retention.agg(F.count_distinct("cohort_month").alias("n_cohorts"),
                            F.max("months_since_first").alias("max_period"))
    c = curve.agg(F.max(F.when(F.col("month") == 1, F.col("avg_retention_pct"))).alias("m1"),
                  F.min("avg_retention_pct").alias("retention_floor_min_pct"),
                  F.max_by("avg_retention_pct", "month").alias("retention_floor_last_pct"))
    # both sides are single-row aggregates
    return cohorts.crossJoin(c).select(
        "n_cohorts", "max_period",
        F.col("m1").alias("month1_retention_pct"),
        "retention_floor_min_pct", "retention_floor_last_pct",
        (F.lit(100.0) - F.col("m1")).alias("drop_m0_m1_pts"))


def mom_summary(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Average month-over-month growth % and the peak revenue month (first on ties).

    Growth is ``revenue / previous - 1`` in percent with the previous value
    forward-filled over missing months' NULLs; a zero previous value gives
    NULL (pandas gives inf).  The window runs over one row per month.
    """
    m = monthly_orders_revenue(orders, order_items)
    w = Window.orderBy("month")
    prev = F.last("revenue", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = m.select("month", "revenue", ((safe_div("revenue", prev) - 1) * 100).alias("mom"))
    return g.agg(sql_round(F.avg("mom"), 6).alias("avg_mom_growth_pct"),
                 F.min_by("month", F.struct(-F.col("revenue"), F.col("month"))).alias("peak_month")
                 ).select("avg_mom_growth_pct", "peak_month",
                          month_name_label("peak_month").alias("peak_month_label"))
