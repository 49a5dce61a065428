"""Registered queries over the driver tables: one callable per SURVEY §2.8 key
(plus the statistical and plot-data operators).  Each takes
``(spark, sf_dir)`` and returns a lazy DataFrame over the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cairn.functions.scalar import choose, clip, day_diff, parse_datetime, sql_round
from cairn.operators import clinical, cohort, exact_sums, joins, plotdata, sales, stats, windows
from cairn.operators.ordered import ordered_window
from cairn.sources import catalog
from cairn.session import checkpoint_dir
from cairn.sources.tables import DriverTables

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str) -> DriverTables:
    return DriverTables(spark, sf_dir)


def q_monthly_revenue(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.monthly_revenue(t.orders(), t.order_items())


def q_category_margin(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.category_margin(t.orders(), t.order_items(), t.products())


def q_category_performance(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.category_performance(t.orders(), t.order_items(), t.products())


def q_customer_ltv_segments(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.customer_ltv_segments(t.customers(), t.orders(), t.order_items())


def q_top_products_return_rate(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.top_products_return_rate(t.orders(), t.order_items(), t.products())


def q_channel_performance(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.channel_performance(t.orders(), t.order_items())


def q_channel_aov(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.channel_aov(t.orders(), t.order_items())


def q_customer_ltv(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.customer_ltv(t.customers(), t.orders(), t.order_items())


def q_customer_rank_by_country(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.customer_rank_by_country(t.customers(), t.orders(), t.order_items())


def q_mom_growth(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.mom_growth(t.orders(), t.order_items())


def q_order_value_distribution(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.order_value_distribution(t.orders(), t.order_items())


def q_first_last_purchase(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.first_last_purchase(t.orders())


def q_cohort_retention(spark, sf_dir):
    return cohort.cohort_retention(_t(spark, sf_dir).orders())


def q_cohort_matrix(spark, sf_dir):
    return cohort.cohort_grid(cohort.cohort_retention(_t(spark, sf_dir).orders()))


def q_retention_curve(spark, sf_dir):
    return cohort.retention_curve(cohort.cohort_retention(_t(spark, sf_dir).orders()))


def q_retention_summary(spark, sf_dir):
    return cohort.retention_summary(cohort.cohort_retention(_t(spark, sf_dir).orders()))


def q_mom_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return cohort.mom_summary(t.orders(), t.order_items())


def q_group_summary(spark, sf_dir):
    return clinical.group_summary(_t(spark, sf_dir).patients())


def q_age_group_summary(spark, sf_dir):
    return clinical.age_group_summary(_t(spark, sf_dir).patients())


# The reference's unit-test queries run on a 3-row (id, name, score) frame;
# here the same statements run on the customer table (score = account balance)
# registered through the catalog.
def _scores(spark, sf_dir):
    c = _t(spark, sf_dir).raw("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return catalog.load_dataframe(spark, c, "scores")


def q_count_basic(spark, sf_dir):
    _scores(spark, sf_dir)
    return catalog.query(spark, "SELECT COUNT(*) AS n FROM scores")


def q_filter_basic(spark, sf_dir):
    _scores(spark, sf_dir)
    return catalog.query(spark, "SELECT name, score FROM scores WHERE score > 80")


def q_avg_basic(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.agg(sql_round(F.avg("score"), 2).alias("avg_score"))


def q_rank_basic(spark, sf_dir):
    s = _scores(spark, sf_dir)
    r = ordered_window(s, [("score", False)], ["id"])
    return r.select("name", "score", F.col("rank").alias("rnk"))


def q_group_means(spark, sf_dir):
    return clinical.group_means(_t(spark, sf_dir).patients())


# --- statistics over whole driver tables -------------------------------------

def q_describe_extendedprice(spark, sf_dir):
    return stats.describe_numeric(_t(spark, sf_dir).raw("lineitem"), "l_extendedprice")


def q_describe_acctbal(spark, sf_dir):
    return stats.describe_numeric(_t(spark, sf_dir).raw("customer"), "c_acctbal")


def q_describe_discount_missing(spark, sf_dir):
    li = _t(spark, sf_dir).raw("lineitem")
    return stats.describe_numeric(li.select(F.nullif("l_discount", F.lit(0.0)).alias("discount")), "discount")


def q_describe_ltv(spark, sf_dir):
    t = _t(spark, sf_dir)
    ltv = sales.customer_ltv(t.customers(), t.orders(), t.order_items())
    return stats.describe_numeric(ltv, "lifetime_value", materialize=True)


def q_ttest_recovery_days(spark, sf_dir):
    return stats.two_sample_ttest(_t(spark, sf_dir).patients(), "recovery_days", "group",
                                  "treatment", "control")


def q_ttest_baseline_score(spark, sf_dir):
    return stats.two_sample_ttest(_t(spark, sf_dir).patients(), "baseline_score", "group",
                                  "treatment", "control")


def q_cohens_d_recovery_days(spark, sf_dir):
    d = stats.cohens_d(_t(spark, sf_dir).patients(), "recovery_days", "group", "treatment", "control")
    return d.select(sql_round("cohen_d", 6).alias("cohen_d"))


def q_mann_whitney_recovery_days(spark, sf_dir):
    return stats.mann_whitney_test(_t(spark, sf_dir).patients(), "recovery_days", "group",
                                   "treatment", "control")


def q_mann_whitney_quantity_linestatus(spark, sf_dir):
    return stats.mann_whitney_test(_t(spark, sf_dir).raw("lineitem"), "l_quantity", "l_linestatus",
                                   "O", "F")


def q_mann_whitney_supplier_balance(spark, sf_dir):
    # suppliers of nation 1 vs nation 2: small and tie-free at sf0.01 (exact path)
    return stats.mann_whitney_test(_t(spark, sf_dir).raw("supplier"), "s_acctbal", "s_nationkey", 1, 2)


def q_chi_square_quality_toxic(spark, sf_dir):
    return stats.chi_square_test(_t(spark, sf_dir).raw("labels"), "quality", "toxic")


def q_chi_square_returnflag_linestatus(spark, sf_dir):
    return stats.chi_square_test(_t(spark, sf_dir).raw("lineitem"), "l_returnflag", "l_linestatus")


def q_chi_square_partkey_suppkey(spark, sf_dir):
    return stats.chi_square_test(_t(spark, sf_dir).raw("lineitem"), "l_partkey", "l_suppkey")


def q_cramers_v_returnflag_linestatus(spark, sf_dir):
    v = stats.cramers_v(_t(spark, sf_dir).raw("lineitem"), "l_returnflag", "l_linestatus")
    return v.select(sql_round("cramers_v", 6).alias("cramers_v"))


LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PATIENT_NUMERIC = ["age", "baseline_score", "followup_score", "score_improvement", "recovery_days"]


def _rounded_corr(m):
    return m.select("col_a", "col_b", F.col("n").cast("bigint").alias("n"),
                    sql_round("corr", 6).alias("corr"), sql_round("p_value", 6).alias("p_value"))


def q_correlation_lineitem(spark, sf_dir):
    li = _t(spark, sf_dir).raw("lineitem")
    return _rounded_corr(stats.correlation_matrix(li, LINEITEM_NUMERIC, method="pearson"))


def q_correlation_lineitem_spearman(spark, sf_dir):
    li = _t(spark, sf_dir).raw("lineitem")
    return _rounded_corr(stats.correlation_matrix(li, LINEITEM_NUMERIC, method="spearman"))


def q_correlation_patients(spark, sf_dir):
    return _rounded_corr(stats.correlation_matrix(_t(spark, sf_dir).patients(), PATIENT_NUMERIC))


def q_correlation_lineitem_kendall(spark, sf_dir):
    li = _t(spark, sf_dir).raw("lineitem")
    return _rounded_corr(stats.correlation_matrix(li, LINEITEM_NUMERIC, method="kendall"))


def q_correlation_patients_kendall(spark, sf_dir):
    return _rounded_corr(stats.correlation_matrix(_t(spark, sf_dir).patients(), PATIENT_NUMERIC, method="kendall"))


def q_strong_correlations(spark, sf_dir):
    return _rounded_corr(stats.strong_correlations(_t(spark, sf_dir).patients(), PATIENT_NUMERIC))


def q_exact_line_sums(spark, sf_dir):
    """Sums and means of doubles, unrounded, the same under any partitioning."""
    li = _t(spark, sf_dir).raw("lineitem").withColumn(
        "charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return exact_sums.exact_sums(li, ["l_returnflag", "l_linestatus"], ["charge", "l_tax"])


# --- plot data -----------------------------------------------------------------

def q_histogram_extendedprice(spark, sf_dir):
    h = plotdata.histogram(_t(spark, sf_dir).raw("lineitem"), "l_extendedprice")
    return h.select("bin", "bin_start", "bin_end", "count",
                    sql_round("mean", 6).alias("mean"), sql_round("median", 6).alias("median"))


def q_kde_extendedprice(spark, sf_dir):
    k = plotdata.kde_curve(_t(spark, sf_dir).raw("lineitem"), "l_extendedprice")
    return k.select("point", "x", sql_round("density", 12).alias("density"),
                    sql_round("count", 6).alias("count"))


def _rounded_box(b, group_col):
    return b.select(group_col, "n", *[sql_round(c, 6).alias(c) for c in
                                      ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "n_fliers", F.col("order").cast("bigint").alias("order"))


def q_box_stats_ltv_by_country(spark, sf_dir):
    t = _t(spark, sf_dir)
    ltv = sales.customer_ltv(t.customers(), t.orders(), t.order_items())
    return _rounded_box(plotdata.box_stats(ltv, "lifetime_value", "country", materialize=True), "country")


def q_box_stats_recovery_by_group(spark, sf_dir):
    return _rounded_box(plotdata.box_stats(_t(spark, sf_dir).patients(), "recovery_days", "group"), "group")


def _ltv(spark, sf_dir):
    t = _t(spark, sf_dir)
    return sales.customer_ltv(t.customers(), t.orders(), t.order_items())


def q_histogram_ltv(spark, sf_dir):
    h = plotdata.histogram(_ltv(spark, sf_dir), "lifetime_value", materialize=True)
    return h.select("bin", "bin_start", "bin_end", "count",
                    sql_round("mean", 6).alias("mean"), sql_round("median", 6).alias("median"))


def q_kde_ltv(spark, sf_dir):
    k = plotdata.kde_curve(_ltv(spark, sf_dir), "lifetime_value")
    return k.select("point", "x", sql_round("density", 12).alias("density"),
                    sql_round("count", 6).alias("count"))


def q_box_stats_improvement_by_age_group(spark, sf_dir):
    return _rounded_box(plotdata.box_stats(_t(spark, sf_dir).patients(), "score_improvement", "age_group"),
                        "age_group")


def q_revenue_rolling(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = sales.monthly_orders_revenue(t.orders(), t.order_items())
    # the rolling mean runs over exact cents
    ts = plotdata.time_series_with_rolling(m, "month", "revenue_cents", window=3)
    return ts.select("month", (F.col("revenue_cents") / 100).alias("revenue"),
                     (F.col("rolling_mean") / 100).alias("rolling_mean"))


def q_ranked_category_revenue(spark, sf_dir):
    t = _t(spark, sf_dir)
    perf = sales.category_performance(t.orders(), t.order_items(), t.products())
    r = plotdata.ranked_top(perf, "category", "revenue")
    return r.select("category", "revenue", F.col("rank").cast("bigint").alias("rank"))


def q_correlation_heatmap_patients(spark, sf_dir):
    m = stats.correlation_matrix(_t(spark, sf_dir).patients(), PATIENT_NUMERIC)
    return _rounded_corr(stats.lower_triangle(m, PATIENT_NUMERIC))


def q_monthly_pct_change(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = sales.monthly_orders_revenue(t.orders(), t.order_items())
    return m.select("month", "revenue",
                    sql_round(plotdata.pct_change("month", "revenue") * 100, 6).alias("mom_growth_pct")
                    ).orderBy("month")


# --- window siblings, as-of join, pivot ------------------------------------------

def q_order_sequence(spark, sf_dir):
    t = _t(spark, sf_dir)
    o = sales.completed_orders(t.orders()).select("customer_id", "order_id", "order_date")
    s = windows.sequence(o, ["customer_id"], ["order_date"], ["order_id"], lead_cols=["order_date"])
    return s.select("customer_id", "order_id", "order_date",
                    F.col("row_number").cast("bigint").alias("order_seq"),
                    F.col("lead_order_date").alias("next_order_date"),
                    # NULL for the last order; double so both engines report one type
                    day_diff("order_date", "lead_order_date").cast("double").alias("days_to_next"))


def q_purchase_last_click(spark, sf_dir):
    e = _t(spark, sf_dir).raw("events")
    purchases = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    clicks = e.where(F.col("event_type") == "click").select(
        "user_id", F.col("event_id").alias("click_event_id"), F.col("ts").alias("click_ts"),
        F.col("value").alias("click_value"))
    j = joins.asof_join(purchases, clicks, ["user_id"], "ts", "click_ts", ["event_id"],
                        ["click_event_id"], ["click_event_id", "click_ts", "click_value"])
    # the operator keeps the id a bigint; as text a NULL beside it has the same type in both engines
    return j.withColumn("click_event_id", F.col("click_event_id").cast("string"))


def q_channel_status_pivot(spark, sf_dir):
    catalog.load_dataframe(spark, _t(spark, sf_dir).orders(), "orders_logical")
    return catalog.query(spark, """
        SELECT * FROM (SELECT channel, status FROM orders_logical)
        PIVOT (COUNT(*) FOR status IN ('completed' AS completed, 'returned' AS returned,
                                       'cancelled' AS cancelled))""")


# --- parsing, conditions, missing values, scripts and files -----------------------

#: Formats in which the order dates below are written out, by status; the last one is not among the read ones.
WRITTEN = {"completed": "yyyy-MM-dd", "returned": "dd/MM/yyyy HH:mm", "cancelled": "'Q'q yyyy"}


def q_order_dates_parsed(spark, sf_dir):
    """Order dates as text in a format that depends on the status, read back with a list of formats."""
    o = _t(spark, sf_dir).orders()
    text = choose([F.col("status") == s for s in WRITTEN], [F.date_format("order_date", f) for f in WRITTEN.values()])
    return o.select("order_id", text.alias("written"),
                    parse_datetime(text, ["yyyy-MM-dd", "dd/MM/yyyy HH:mm"]).alias("parsed"))


def q_patients_adjusted(spark, sf_dir):
    """Improvement bounded to [8, 20] and recovery shortened for the treated, conditionally on the age."""
    p = _t(spark, sf_dir).patients()
    short = choose([(F.col("group") == "treatment") & (F.col("age") > 70), F.col("group") == "treatment"],
                   [F.col("recovery_days") - 2, F.col("recovery_days") - 5], F.col("recovery_days"))
    return p.select("patient_id", clip("score_improvement", 8.0, 20.0).alias("bounded_improvement"),
                    clip("baseline_score", lower=25.0).alias("baseline_floor"), short.alias("adjusted_days"))


def q_cohort_matrix_wide(spark, sf_dir):
    return cohort.cohort_matrix(cohort.cohort_retention(_t(spark, sf_dir).orders()), periods=[0, 1, 2, 3, 6, 12])


def q_ranked_subcategory_revenue(spark, sf_dir):
    """The 15 best of 25 brands by completed revenue."""
    t = _t(spark, sf_dir)
    m = sales.category_margin(t.orders(), t.order_items(), t.products())
    by_brand = m.groupBy("subcategory").agg((F.sum(F.round(F.col("revenue") * 100).cast("bigint")) / 100).alias("revenue"))
    r = plotdata.ranked_top(by_brand, "subcategory", "revenue")
    return r.select("subcategory", "revenue", F.col("rank").cast("bigint").alias("rank"))


def _lineitem_missing(spark, sf_dir):
    li = _t(spark, sf_dir).raw("lineitem")
    return li.select("l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("discount"),
                     F.nullif("l_tax", F.lit(0.0)).alias("tax"))


def q_correlation_missing(spark, sf_dir):
    return _rounded_corr(stats.correlation_matrix(_lineitem_missing(spark, sf_dir), method="pearson"))


def q_correlation_missing_spearman(spark, sf_dir):
    return _rounded_corr(stats.correlation_matrix(_lineitem_missing(spark, sf_dir), method="spearman"))


def q_correlation_patients_spearman(spark, sf_dir):
    """No column list: all numeric columns, the id among them."""
    return _rounded_corr(stats.correlation_matrix(_t(spark, sf_dir).patients(), method="spearman"))


#: Two statements: a view and a query that reads it.
RETURNS_SCRIPT = """
-- orders and customers by channel and year; a semicolon in a comment; is not an end
CREATE OR REPLACE TEMPORARY VIEW yearly AS
SELECT channel, year(order_date) AS y, count(*) AS n, count_if(status = 'returned') AS back
FROM orders_logical GROUP BY channel, year(order_date);
SELECT channel, CAST(y AS BIGINT) AS order_year, n AS orders, round(back / n * 100, 2) AS returned_pct FROM yearly;
"""


def q_script_returns_by_year(spark, sf_dir):
    catalog.load_dataframe(spark, _t(spark, sf_dir).orders(), "orders_logical")
    return catalog.run_sql_script(spark, RETURNS_SCRIPT)[-1]


def q_csv_customers(spark, sf_dir):
    """Customers written out as CSV and loaded again with inferred types."""
    c = _t(spark, sf_dir).raw("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    c.write.option("header", True).csv(path)
    loaded = catalog.load_csv(spark, path, "customers_csv")
    return (loaded.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").cast("bigint").alias("last_id"),
                                               F.max("c_acctbal").alias("best_balance"))
            .withColumnRenamed("c_mktsegment", "segment"))


QUERIES: dict[str, Query] = {
    "monthly_revenue": q_monthly_revenue,
    "category_margin": q_category_margin,
    "category_performance": q_category_performance,
    "customer_ltv_segments": q_customer_ltv_segments,
    "top_products_return_rate": q_top_products_return_rate,
    "channel_performance": q_channel_performance,
    "channel_aov": q_channel_aov,
    "customer_ltv": q_customer_ltv,
    "customer_rank_by_country": q_customer_rank_by_country,
    "mom_growth": q_mom_growth,
    "order_value_distribution": q_order_value_distribution,
    "first_last_purchase": q_first_last_purchase,
    "cohort_retention": q_cohort_retention,
    "cohort_matrix": q_cohort_matrix,
    "retention_curve": q_retention_curve,
    "retention_summary": q_retention_summary,
    "mom_summary": q_mom_summary,
    "group_summary": q_group_summary,
    "age_group_summary": q_age_group_summary,
    "rank_basic": q_rank_basic,
    "filter_basic": q_filter_basic,
    "avg_basic": q_avg_basic,
    "count_basic": q_count_basic,
    "group_means": q_group_means,
    "describe_extendedprice": q_describe_extendedprice,
    "describe_acctbal": q_describe_acctbal,
    "describe_discount_missing": q_describe_discount_missing,
    "describe_ltv": q_describe_ltv,
    "ttest_recovery_days": q_ttest_recovery_days,
    "ttest_baseline_score": q_ttest_baseline_score,
    "cohens_d_recovery_days": q_cohens_d_recovery_days,
    "mann_whitney_recovery_days": q_mann_whitney_recovery_days,
    "mann_whitney_quantity_linestatus": q_mann_whitney_quantity_linestatus,
    "mann_whitney_supplier_balance": q_mann_whitney_supplier_balance,
    "chi_square_quality_toxic": q_chi_square_quality_toxic,
    "chi_square_returnflag_linestatus": q_chi_square_returnflag_linestatus,
    "chi_square_partkey_suppkey": q_chi_square_partkey_suppkey,
    "cramers_v_returnflag_linestatus": q_cramers_v_returnflag_linestatus,
    "correlation_lineitem": q_correlation_lineitem,
    "correlation_lineitem_spearman": q_correlation_lineitem_spearman,
    "correlation_patients": q_correlation_patients,
    "strong_correlations": q_strong_correlations,
    "correlation_lineitem_kendall": q_correlation_lineitem_kendall,
    "correlation_patients_kendall": q_correlation_patients_kendall,
    "histogram_extendedprice": q_histogram_extendedprice,
    "kde_extendedprice": q_kde_extendedprice,
    "box_stats_ltv_by_country": q_box_stats_ltv_by_country,
    "box_stats_recovery_by_group": q_box_stats_recovery_by_group,
    "box_stats_improvement_by_age_group": q_box_stats_improvement_by_age_group,
    "histogram_ltv": q_histogram_ltv,
    "kde_ltv": q_kde_ltv,
    "revenue_rolling": q_revenue_rolling,
    "ranked_category_revenue": q_ranked_category_revenue,
    "correlation_heatmap_patients": q_correlation_heatmap_patients,
    "monthly_pct_change": q_monthly_pct_change,
    "order_sequence": q_order_sequence,
    "purchase_last_click": q_purchase_last_click,
    "channel_status_pivot": q_channel_status_pivot,
    "order_dates_parsed": q_order_dates_parsed,
    "patients_adjusted": q_patients_adjusted,
    "cohort_matrix_wide": q_cohort_matrix_wide,
    "ranked_subcategory_revenue": q_ranked_subcategory_revenue,
    "correlation_missing": q_correlation_missing,
    "correlation_missing_spearman": q_correlation_missing_spearman,
    "correlation_patients_spearman": q_correlation_patients_spearman,
    "script_returns_by_year": q_script_returns_by_year,
    "csv_customers": q_csv_customers,
    "exact_line_sums": q_exact_line_sums,
}
