"""E-commerce queries: revenue, margin, lifetime value, top products, channels.

Inputs are DataFrames with the reference's logical schemas:

    customers   (customer_id, name, country, segment, ...)
    products    (product_id, name, category, subcategory, unit_price, cost_price)
    orders      (order_id, customer_id, order_date, status, channel, ...)
    order_items (order_id, product_id, quantity, unit_price)

``order_id`` is the key of ``orders`` and ``product_id`` the key of
``products`` (as in the reference's generated tables).

Money is summed exactly in integer cents: a line amount is
round(quantity * unit_price * 100) (prices have two decimals, so this is the
amount itself, without the float noise), sums are bigint, and averages are
rounded at the cent.  Summing doubles instead makes the cent of an average
depend on the summation order whenever the exact value is a half cent.

Plan shape shared by these queries: order lines are first reduced to one row
per order (or per product) with a partial/final aggregate, and only then
joined.  Order lines are the largest table; the reduction happens map-side
before the shuffle, and the join then moves one row per order instead of one
per line.  Spark does not push aggregates below joins by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import day_diff, month_start, safe_div, sql_round
from cairn.operators.ordered import ntile_col, ordered_window, percent_rank_col
from cairn.operators.quantiles import exact_quantiles
from cairn.plans.broadcast import broadcast_bounded
from cairn.session import checkpoint_dir

COMPLETED = "completed"
RETURNED = "returned"

# Lifetime-value segment ladder (fixed values): percentile threshold -> label,
# tested top down; below the last threshold the label is "At Risk".
LTV_SEGMENTS = [(0.9, "Champions"), (0.7, "Loyal"), (0.4, "Potential")]
LTV_DEFAULT_SEGMENT = "At Risk"


def cents(amount) -> "F.Column":
    """An amount with two decimals as exact integer cents."""
    return F.round(amount * F.lit(100)).cast("bigint")


def line_cents():
    return cents(F.col("quantity") * F.col("unit_price"))


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def money(cents_col) -> "F.Column":
    """Integer cents back to a decimal amount (double)."""
    return _col(cents_col) / F.lit(100)


def avg_money(cents_col, n) -> "F.Column":
    """ROUND(sum / n, 2) computed on exact cents: round(cents / n) / 100."""
    return F.round(_col(cents_col) / _col(n), 0) / F.lit(100)


def order_totals(order_items: DataFrame) -> DataFrame:
    """One row per order: revenue (cents), number of lines, units."""
    return (order_items.groupBy("order_id")
            .agg(F.sum(line_cents()).alias("order_cents"),
                 F.count(F.lit(1)).alias("n_items"),
                 F.sum("quantity").alias("units")))


def completed_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") == COMPLETED)


def completed_order_values(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Completed orders joined with their per-order totals (inner: orders with lines)."""
    o = completed_orders(orders).select("order_id", "customer_id", "order_date", "channel")
    return o.join(order_totals(order_items), "order_id")


def _distinct(col: str, approx: bool):
    """COUNT(DISTINCT col), or a HyperLogLog estimate when ``approx`` (opt-in)."""
    return F.approx_count_distinct(col) if approx else F.count_distinct(col)


def monthly_revenue(orders: DataFrame, order_items: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Orders, customers, revenue and average order value per month (completed orders).

    ``approx_distinct=True`` estimates unique customers with HyperLogLog
    (no per-month customer sets), for very large inputs."""
    ov = completed_order_values(orders, order_items)
    return (ov.groupBy(month_start("order_date").alias("month"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 _distinct("customer_id", approx_distinct).alias("unique_customers"),
                 money(F.sum("order_cents")).alias("gross_revenue"),
                 avg_money(F.sum("order_cents"), F.count(F.lit(1))).alias("avg_order_value"))
            .orderBy("month"))


def monthly_orders_revenue(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """The notebook's monthly series: month, total_orders, revenue (and revenue_cents).

    Unordered: it feeds windows ordered by month (callers sort for display)."""
    ov = completed_order_values(orders, order_items)
    return (ov.groupBy(month_start("order_date").alias("month"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 money(F.sum("order_cents")).alias("revenue"),
                 F.sum("order_cents").alias("revenue_cents")))


def _product_sales(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Completed units and revenue per product (reduced before the product join)."""
    o = completed_orders(orders).select("order_id")
    return (order_items.join(o, "order_id")
            .groupBy("product_id")
            .agg(F.sum("quantity").alias("units"),
                 F.sum(line_cents()).alias("rev")))


def _category_rollup(orders, order_items, products, keys):
    ps = _product_sales(orders, order_items)
    p = products.select("product_id", "category", "subcategory", "cost_price")
    j = ps.join(p, "product_id")
    # sum over lines of quantity * cost_price == cost_price * units per product (in cents)
    return j.groupBy(*keys).agg(F.sum("units").alias("units_sold"),
                                F.sum("rev").alias("_rev"),
                                F.sum(cents(F.col("units") * F.col("cost_price"))).alias("_cost"))


def category_margin(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Units, revenue, cost, margin % and share of category revenue per subcategory."""
    m = _category_rollup(orders, order_items, products, ["category", "subcategory"])
    # one row per (category, subcategory): a small table, the window is cheap
    share = F.col("_rev") / F.sum("_rev").over(Window.partitionBy("category")) * 100
    return (m.select("category", "subcategory", "units_sold",
                     money("_rev").alias("revenue"),
                     money("_cost").alias("total_cost"),
                     sql_round(safe_div(F.col("_rev") - F.col("_cost"), F.col("_rev")) * 100, 2).alias("margin_pct"),
                     sql_round(share, 2).alias("pct_of_category"))
            .orderBy(F.col("category").asc_nulls_last(), F.col("revenue").desc_nulls_last()))


def category_performance(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, cost and margin % (1 dp) per category, by revenue descending."""
    m = _category_rollup(orders, order_items, products, ["category"])
    return (m.select("category",
                     money("_rev").alias("revenue"),
                     money("_cost").alias("cost"),
                     sql_round(safe_div(F.col("_rev") - F.col("_cost"), F.col("_rev")) * 100, 1).alias("margin_pct"))
            .orderBy(F.col("revenue").desc_nulls_last()))


def _customer_orders(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    ov = completed_order_values(orders, order_items)
    return (ov.groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 F.sum("order_cents").alias("_ltv"),
                 F.min("order_date").alias("first_order"),
                 F.max("order_date").alias("last_order")))


def customer_ltv(customers: DataFrame, orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Lifetime value per customer with country and segment."""
    co = _customer_orders(orders, order_items)
    c = customers.select("customer_id", "country", "segment")
    return c.join(co, "customer_id").select(
        "customer_id", "country", "segment", "total_orders",
        money("_ltv").alias("lifetime_value"))


def customer_ltv_segments(customers: DataFrame, orders: DataFrame, order_items: DataFrame,
                          num_buckets: int | None = None) -> DataFrame:
    """LTV, first/last order, tenure, LTV quartile and percentile segment per customer.

    Quartiles and percentiles are over all customers: quartiles from one distributed ordered pass
    (``ordered_window``), ties broken by customer_id; percentiles exact, by brackets.  The customers'
    values are written once and read by both.
    """
    co = _customer_orders(orders, order_items)
    c = customers.select("customer_id", "name", "country", "segment")
    ltv = c.join(co, "customer_id").select(
        "customer_id", "name", "country", "segment", "total_orders",
        money("_ltv").alias("lifetime_value"), "first_order", "last_order",
        day_diff("first_order", "last_order").alias("customer_tenure_days"))
    checkpoint_dir(ltv.sparkSession)
    ltv = ltv.checkpoint(eager=True)
    ranked = ordered_window(ltv, ["lifetime_value"], ["customer_id"], num_buckets=num_buckets, ranks=False)
    probs = [p for p, _ in LTV_SEGMENTS]
    thresholds = broadcast_bounded(exact_quantiles(ltv, "lifetime_value", probs, prefix="p"),
                                   "1 row: global percentiles")
    seg = None
    for p, label in LTV_SEGMENTS:
        cond = F.col("lifetime_value") >= F.col("p_" + str(p).replace(".", "_"))
        seg = F.when(cond, F.lit(label)) if seg is None else seg.when(cond, F.lit(label))
    seg = seg.otherwise(F.lit(LTV_DEFAULT_SEGMENT))
    return (ranked.crossJoin(thresholds)
            .select(*ltv.columns, ntile_col(4).alias("ltv_quartile"), seg.alias("rfm_segment"))
            .orderBy(F.col("lifetime_value").desc_nulls_last(), F.col("customer_id")))


def top_products_return_rate(orders: DataFrame, order_items: DataFrame, products: DataFrame,
                             n: int = 10) -> DataFrame:
    """Top ``n`` products by completed revenue with their return rate.

    No status filter: cancelled lines count as 0.  Return rate = returned units
    / completed units.  Ties on revenue are broken by product_id.  The top-n is
    taken on the per-product aggregate, so only ``n`` rows meet the product table.
    """
    o = orders.select("order_id", "status")
    completed = F.col("status") == COMPLETED
    ps = (order_items.join(o, "order_id")
          .groupBy("product_id")
          .agg(F.sum(F.when(completed, F.col("quantity")).otherwise(F.lit(0))).alias("units_sold"),
               F.sum(F.when(F.col("status") == RETURNED, F.col("quantity")).otherwise(F.lit(0))).alias("units_returned"),
               money(F.sum(F.when(completed, line_cents()).otherwise(F.lit(0)))).alias("revenue")))
    top = ps.orderBy(F.col("revenue").desc_nulls_last(), F.col("product_id")).limit(n)
    top = broadcast_bounded(top, f"{n} rows: top-n")
    p = products.select("product_id", "name", "category")
    return (p.join(top, "product_id")
            .select("name", "category", "units_sold", "revenue",
                    sql_round(safe_div("units_returned", "units_sold") * 100, 2).alias("return_rate_pct"),
                    "product_id")
            .orderBy(F.col("revenue").desc_nulls_last(), F.col("product_id"))
            .drop("product_id"))


def channel_performance(orders: DataFrame, order_items: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Orders, customers, revenue, average item and order value, revenue share per channel."""
    ov = completed_order_values(orders, order_items)
    g = (ov.groupBy("channel")
         .agg(F.count(F.lit(1)).alias("orders"),
              _distinct("customer_id", approx_distinct).alias("customers"),
              F.sum("order_cents").alias("_rev"),
              F.sum("n_items").alias("_items")))
    # one row per channel: the share window runs over a handful of rows
    share = F.col("_rev") / F.sum("_rev").over(Window.partitionBy()) * 100
    return (g.select("channel", "orders", "customers",
                     money("_rev").alias("revenue"),
                     avg_money(F.col("_rev"), F.col("_items")).alias("avg_item_value"),
                     avg_money(F.col("_rev"), F.col("orders")).alias("avg_order_value"),
                     sql_round(share, 2).alias("revenue_share_pct"))
            .orderBy(F.col("revenue").desc_nulls_last()))


def channel_aov(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Orders and average order value per channel, by AOV descending."""
    ov = completed_order_values(orders, order_items)
    return (ov.groupBy("channel")
            .agg(F.count(F.lit(1)).alias("orders"),
                 avg_money(F.sum("order_cents"), F.count(F.lit(1))).alias("avg_order_value"))
            .orderBy(F.col("avg_order_value").desc_nulls_last()))


def customer_rank_by_country(customers: DataFrame, orders: DataFrame, order_items: DataFrame,
                             num_buckets: int | None = None) -> DataFrame:
    """RANK / DENSE_RANK of customer revenue within country and share of country revenue.

    A country is a low-cardinality, possibly skewed partition: the ranking is
    the distributed ordered window, so one country never lands in one task.
    """
    co = _customer_orders(orders, order_items)
    c = customers.select("customer_id", "name", "country")
    cr = c.join(co, "customer_id").select("customer_id", "name", "country",
                                          money("_ltv").alias("total_revenue"), F.col("_ltv").alias("_cents"))
    r = ordered_window(cr, [("total_revenue", False)], ["customer_id"], partition_by=["country"],
                       sum_cols=["_cents"], num_buckets=num_buckets, materialize=True)
    return (r.select("country", "name", "total_revenue",
                     F.col("rank").cast("bigint").alias("revenue_rank"),
                     F.col("dense_rank").cast("bigint").alias("revenue_dense_rank"),
                     sql_round(F.col("_cents") / F.col("partition_sum__cents") * 100, 2)
                     .alias("pct_of_country_revenue"))
            .orderBy(F.col("country").asc_nulls_last(), "revenue_rank", "name"))


def mom_growth(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Previous month, growth %, cumulative revenue and trailing 3-month average.

    The input of the window is one row per calendar month, so the ordered
    window over it is bounded by the number of months, not by the data.
    Cumulative and moving sums run over exact cents.
    """
    m = monthly_orders_revenue(orders, order_items).select("month", "revenue", "revenue_cents")
    w = Window.orderBy("month")
    prev = F.lag("revenue").over(w)
    trail = w.rowsBetween(-2, 0)
    return (m.select("month", "revenue", prev.alias("prev_month_revenue"),
                     sql_round(safe_div(F.col("revenue") - prev, prev) * 100, 2).alias("mom_growth_pct"),
                     money(F.sum("revenue_cents").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                     .alias("cumulative_revenue"),
                     (F.sum("revenue_cents").over(trail) / F.count("revenue_cents").over(trail) / F.lit(100))
                     .alias("rolling_3m_avg"))
            .orderBy("month"))


def order_value_distribution(orders: DataFrame, order_items: DataFrame,
                             num_buckets: int | None = None) -> DataFrame:
    """Per completed order: value, running total by date, percentile and decile by value.

    Two global orders (by value; by date) — each is one distributed ordered
    pass.  Ties are broken by order_id.
    """
    ov = completed_order_values(orders, order_items).select(
        "order_id", "order_date", money("order_cents").alias("order_value"), F.col("order_cents").alias("_cents"))
    by_value = ordered_window(ov, ["order_value"], ["order_id"], num_buckets=num_buckets, materialize=True)
    by_value = by_value.select("order_id", "order_date", "order_value", "_cents",
                               sql_round(percent_rank_col() * 100, 2).alias("percentile"),
                               ntile_col(10).alias("decile"))
    by_date = ordered_window(by_value, ["order_date"], ["order_id"], sum_cols=["_cents"], num_buckets=num_buckets,
                             totals=False, ranks=False, materialize=True)
    return (by_date.select("order_id", "order_date", "order_value",
                           money(F.col("running__cents")).alias("running_total"),
                           "percentile", "decile")
            .orderBy(F.col("order_date").asc_nulls_last(), "order_id"))


def first_last_purchase(orders: DataFrame) -> DataFrame:
    """First and last completed purchase, order count and days between, per customer.

    FIRST_VALUE/LAST_VALUE over the whole customer partition plus DISTINCT is
    a plain grouped min/max/count (order dates are never NULL).
    """
    g = (completed_orders(orders).groupBy("customer_id")
         .agg(F.min("order_date").alias("first_purchase_date"),
              F.max("order_date").alias("last_purchase_date"),
              F.count(F.lit(1)).alias("total_orders")))
    # customer_id breaks the (heavy) ties of the count, so the range-partitioned
    # sort can split them over tasks
    return (g.withColumn("days_between_first_last", day_diff("first_purchase_date", "last_purchase_date"))
            .orderBy(F.col("total_orders").desc(), F.col("customer_id")))
