"""Skew check: one customer with 1/3 of all orders, one product with 1/3 of
all order lines, one country with half of the customers, and heavily tied
order values.  Runs the affected queries and reports, from Spark's event log,
the largest fraction of a stage's rows handled by one task (post-shuffle
stages only) — with a hot key handled by one task it would be >= 1/3.

Usage: python tools/skew_check.py SCRATCH_DIR [n_orders]
"""

from __future__ import annotations

import glob
import json
import os
import sys
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def build(spark, n_orders: int):
    from pyspark.sql import functions as F
    n_cust = max(1000, n_orders // 15)
    o = spark.range(1, n_orders + 1).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.floor(F.rand(1) * n_cust) + 1).cast("long").alias("customer_id"),
        F.to_timestamp_ntz(F.date_add(F.lit("2022-01-01").cast("date"), (F.rand(2) * 900).cast("int"))).alias("order_date"),
        F.when(F.rand(3) < 0.8, F.lit("completed")).otherwise(F.lit("returned")).alias("status"),
        F.when(F.rand(4) < 0.5, F.lit("web")).otherwise(F.lit("mobile")).alias("channel"))
    items = o.select("order_id", F.explode(F.sequence(F.lit(1), (F.floor(F.rand(5) * 3) + 1).cast("int"))).alias("_l")) \
        .select("order_id",
                F.when(F.rand(6) < 1 / 3, F.lit(10)).otherwise(F.floor(F.rand(7) * 5000) + 11).cast("long").alias("product_id"),
                (F.floor(F.rand(8) * 3) + 1).cast("double").alias("quantity"),
                F.lit(5.0).alias("unit_price"))          # heavily tied order values
    cust = spark.range(1, n_cust + 1).select(
        F.col("id").alias("customer_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 2 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("N"), (F.col("id") % 20).cast("string"))).alias("country"),
        F.lit("B2C").alias("segment"))
    prod = spark.range(1, 5012).select(
        F.col("id").alias("product_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"),
        (F.col("id") % 6).cast("string").alias("category"), (F.col("id") % 25).cast("string").alias("subcategory"),
        F.lit(5.0).alias("unit_price"), F.lit(3.0).alias("cost_price"))
    return cust, prod, o, items


def stage_skew(event_dir: str) -> dict:
    groups, stage_group = {}, {}
    tasks = defaultdict(list)
    for path in glob.glob(os.path.join(event_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith(".") or "appstatus" in path:
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    tasks[ev["Stage ID"]].append(rd)
    out = defaultdict(lambda: (0.0, 0))
    for sid, recs in tasks.items():
        total = sum(recs)
        if total < 1000:
            continue
        share = max(recs) / total
        g = stage_group.get(sid)
        if g and share > out[g][0]:
            out[g] = (share, total)
    return dict(out)


def main():
    scratch = sys.argv[1]
    n_orders = int(sys.argv[2]) if len(sys.argv) > 2 else 600_000
    events = os.path.join(scratch, "events")
    os.makedirs(events, exist_ok=True)
    from cairn.session import get_session
    from cairn.operators import cohort, sales, windows
    spark = get_session("local[8]", app_name="cairn-skew", shuffle_partitions=32,
                        extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file:" + events,
                                    "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
                                    "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    cust, prod, o, items = build(spark, n_orders)
    base = os.path.join(scratch, "data")
    for name, df in [("customers", cust), ("products", prod), ("orders", o), ("order_items", items)]:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    cust, prod, o, items = [spark.read.parquet(f"{base}/{n}") for n in ("customers", "products", "orders", "order_items")]
    runs = {
        "customer_rank_by_country": lambda: sales.customer_rank_by_country(cust, o, items),
        "order_value_distribution": lambda: sales.order_value_distribution(o, items),
        "customer_ltv_segments": lambda: sales.customer_ltv_segments(cust, o, items),
        "top_products_return_rate": lambda: sales.top_products_return_rate(o, items, prod),
        "category_margin": lambda: sales.category_margin(o, items, prod),
        "monthly_revenue": lambda: sales.monthly_revenue(o, items),
        "first_last_purchase": lambda: sales.first_last_purchase(o),
        "cohort_retention": lambda: cohort.cohort_retention(o),
        "order_sequence": lambda: windows.sequence(o.select("customer_id", "order_id", "order_date"),
                                                   ["customer_id"], ["order_date"], ["order_id"],
                                                   lead_cols=["order_date"]),
    }
    sc = spark.sparkContext
    for k, fn in runs.items():
        sc.setJobGroup(k, k)
        fn().write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()
    res = stage_skew(events)
    for k in runs:
        share, total = res.get(k, (0.0, 0))
        print(f"{k:28s} max single-task share of a post-shuffle stage: {share:6.3f}  (stage rows {total})")


if __name__ == "__main__":
    main()
