"""Seeded synthetic tables with the reference notebooks' distributions.

Generated on the executors from ``spark.range`` (no driver-side loops):
weighted categorical choice by cumulative thresholds on ``rand``, linearly
weighted dates by the inverse CDF, lognormal / normal / uniform draws from
``randn`` / ``rand``, and 1..4 order lines per order by ``explode(sequence)``.
The distributions match the reference; numpy's exact random stream does not.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import clip, cut, sql_round
from cairn.plans.broadcast import broadcast_if_small
from cairn.sources.tables import AGE_BINS, AGE_LABELS

# Notebook parameters (fixed values).
COUNTRIES = (["Australia", "USA", "UK", "Canada", "Germany"], [0.4, 0.25, 0.15, 0.1, 0.1])
SEGMENTS = (["B2C", "B2B"], [0.7, 0.3])
AGE_GROUPS = ["18-24", "25-34", "35-44", "45-54", "55+"]
CATEGORIES = {
    "Electronics": ["Laptops", "Phones", "Accessories"],
    "Clothing": ["Men", "Women", "Kids"],
    "Health": ["Supplements", "Equipment", "Wearables"],
    "Home": ["Furniture", "Kitchen", "Decor"],
}
STATUSES = (["completed", "returned", "cancelled"], [0.85, 0.1, 0.05])
CHANNELS = (["web", "mobile", "in-store"], [0.5, 0.35, 0.15])
DISCOUNTS = ([0, 5, 10, 15, 20], [0.5, 0.2, 0.15, 0.1, 0.05])


def weighted_choice(values: Sequence, probs: Sequence[float], seed: int) -> Column:
    """One of ``values`` with probabilities ``probs`` (cumulative thresholds on rand)."""
    total = float(sum(probs))
    u = F.rand(seed)
    # index = number of cumulative thresholds <= u.  Every comparison is
    # evaluated on every row (no CASE short-circuit), so all copies of the
    # seeded rand() stay in step and share one draw per row.
    idx = F.lit(1)
    acc = 0.0
    for p in probs[:-1]:
        acc += p / total
        idx = idx + (u >= F.lit(acc)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)


def linear_weighted_day(start: str, end: str, w_start: float, w_end: float, seed: int) -> Column:
    """A date in [start, end] drawn with weights rising linearly from w_start to w_end."""
    d0 = dt.date.fromisoformat(start)
    days = (dt.date.fromisoformat(end) - d0).days + 1
    a, b = float(w_start), float(w_end)
    u = F.rand(seed)
    if abs(b - a) < 1e-12:
        t = u * days
    else:
        # inverse CDF of the density a + (b - a) t / T on [0, T], T = days
        t = F.lit(float(days)) * (F.sqrt(F.lit(a * a) + u * F.lit((b - a) * (a + b))) - F.lit(a)) / F.lit(b - a)
    day = F.least(F.floor(t), F.lit(days - 1)).cast("int")
    return F.date_add(F.lit(d0), day)


def customers(spark: SparkSession, n: int = 500, seed: int = 42, start: str = "2022-01-01",
              signup_every_hours: int = 14) -> DataFrame:
    base = spark.range(1, n + 1).withColumnRenamed("id", "customer_id")
    start_ts = F.to_timestamp_ntz(F.lit(start))
    return base.select(
        "customer_id",
        F.concat(F.lit("Customer "), F.col("customer_id").cast("string")).alias("name"),
        weighted_choice(*COUNTRIES, seed=seed).alias("country"),
        weighted_choice(*SEGMENTS, seed=seed + 1).alias("segment"),
        weighted_choice(AGE_GROUPS, [1.0] * len(AGE_GROUPS), seed=seed + 2).alias("age_group"),
        (start_ts + F.make_dt_interval(F.lit(0), (F.col("customer_id") - 1) * signup_every_hours))
        .alias("signup_date"))


def products(spark: SparkSession, n_products: int = 80, seed: int = 42) -> DataFrame:
    """``n_products // 12`` products per (category, subcategory), lognormal prices."""
    per_sub = n_products // 12
    pairs = [(c, s) for c, subs in CATEGORIES.items() for s in subs]
    cat = spark.createDataFrame(pairs, "category string, subcategory string")
    rows = cat.select("category", "subcategory",
                      F.explode(F.sequence(F.lit(1), F.lit(per_sub))).alias("_i"))
    price = F.exp(F.lit(3.5) + F.lit(0.8) * F.randn(seed))
    p = rows.select("category", "subcategory", price.alias("_price"),
                    (F.lit(0.4) + F.lit(0.25) * F.rand(seed + 1)).alias("_ratio"))
    # one row per product (a few dozen): numbering them in one window is cheap
    w = F.row_number().over(Window.orderBy("category", "subcategory", "_price"))
    return p.select(w.cast("bigint").alias("product_id"),
                    F.concat(F.col("subcategory"), F.lit(" "), w.cast("string")).alias("name"),
                    "category", "subcategory",
                    sql_round("_price", 2).alias("unit_price"),
                    sql_round(F.col("_price") * F.col("_ratio"), 2).alias("cost_price"))


def orders(spark: SparkSession, n: int = 3000, n_customers: int = 500, seed: int = 42,
           start: str = "2023-01-01", end: str = "2024-06-30", w_start: float = 0.5,
           w_end: float = 1.5) -> DataFrame:
    base = spark.range(1, n + 1).withColumnRenamed("id", "order_id")
    return base.select(
        "order_id",
        (F.floor(F.rand(seed) * n_customers) + 1).cast("bigint").alias("customer_id"),
        F.to_timestamp_ntz(linear_weighted_day(start, end, w_start, w_end, seed + 1)).alias("order_date"),
        weighted_choice(*STATUSES, seed=seed + 2).alias("status"),
        weighted_choice(*CHANNELS, seed=seed + 3).alias("channel"),
        weighted_choice(*DISCOUNTS, seed=seed + 4).cast("int").alias("discount_pct"))


def order_items(orders_df: DataFrame, products_df: DataFrame, seed: int = 42,
                max_items: int = 4, max_qty: int = 3) -> DataFrame:
    """1..max_items lines per order, a uniformly drawn product, quantity 1..max_qty,
    unit price = the product's price."""
    n_products = products_df.count()
    lines = orders_df.select("order_id", F.explode(F.sequence(
        F.lit(1), (F.floor(F.rand(seed) * max_items) + 1).cast("int"))).alias("_line"))
    lines = lines.select("order_id",
                         (F.floor(F.rand(seed + 1) * n_products) + 1).cast("bigint").alias("product_id"),
                         (F.floor(F.rand(seed + 2) * max_qty) + 1).cast("int").alias("quantity"))
    prices = broadcast_if_small(products_df.select("product_id", "unit_price"))
    j = lines.join(prices, "product_id")
    return j.select(F.monotonically_increasing_id().alias("item_id"), "order_id", "product_id",
                    "quantity", "unit_price")


def patients(spark: SparkSession, n: int = 300, seed: int = 7) -> DataFrame:
    """Clinical table: treatment recovers faster and improves more."""
    base = spark.range(1, n + 1).withColumnRenamed("id", "patient_id")
    treat = F.col("group") == "treatment"
    df = base.select(
        "patient_id",
        (F.floor(F.rand(seed) * 35) + 50).cast("int").alias("age"),
        weighted_choice(["treatment", "control"], [0.55, 0.45], seed=seed + 1).alias("group"),
        (F.lit(40.0) + F.lit(8.0) * F.randn(seed + 2)).alias("_baseline"),
        F.randn(seed + 3).alias("_z_rec"), F.randn(seed + 4).alias("_z_fu"), F.rand(seed + 5).alias("_u"))
    recovery = F.when(treat, 28 + 7 * F.col("_z_rec")).otherwise(38 + 10 * F.col("_z_rec"))
    followup = F.col("_baseline") + F.when(treat, 18 + 5 * F.col("_z_fu")).otherwise(8 + 6 * F.col("_z_fu"))
    completed = F.when(treat, F.col("_u") < 0.8).otherwise(F.col("_u") < 0.3)
    out = df.select(
        "patient_id", "age", cut("age", AGE_BINS, AGE_LABELS).alias("age_group"), "group",
        F.bround(clip("_baseline", 0, 100), 1).alias("baseline_score"),
        F.bround(clip(followup, 0, 100), 1).alias("followup_score"),
        F.bround(clip(recovery, 5, 90), 0).cast("int").alias("recovery_days"),
        completed.alias("completed_programme"))
    return out.withColumn("score_improvement",
                          F.bround(F.col("followup_score") - F.col("baseline_score"), 1))

