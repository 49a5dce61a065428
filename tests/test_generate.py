from pyspark.sql import functions as F

from cairn.operators import generate as G


def test_generators_follow_reference_distributions(spark):
    c = G.customers(spark, 4000)
    shares = {r.country: r["count"] / 4000 for r in c.groupBy("country").count().collect()}
    for name, p in zip(*G.COUNTRIES):
        assert abs(shares[name] - p) < 0.04
    p = G.products(spark)
    assert p.count() == 72  # 80 // 12 * 12, as in the reference
    r = p.agg(F.min(F.col("cost_price") / F.col("unit_price")).alias("lo"),
              F.max(F.col("cost_price") / F.col("unit_price")).alias("hi")).first()
    assert 0.38 < r.lo and r.hi < 0.67
    o = G.orders(spark, 20000, 500)
    b = o.agg(F.min("order_date"), F.max("order_date"), F.min("customer_id"), F.max("customer_id")).first()
    assert str(b[0])[:10] >= "2023-01-01" and str(b[1])[:10] <= "2024-06-30" and b[2] >= 1 and b[3] <= 500
    first_half = o.where(F.col("order_date") < "2023-10-01").count() / 20000
    assert first_half < 0.45  # weights rise over time
    items = G.order_items(o.limit(2000), p)
    per = items.groupBy("order_id").count().agg(F.min("count"), F.max("count")).first()
    assert per[0] >= 1 and per[1] <= 4
    pt = G.patients(spark, 3000)
    g = {r.group: r for r in pt.groupBy("group").agg(F.avg("recovery_days").alias("rd")).collect()}
    assert g["treatment"].rd < g["control"].rd
    assert pt.agg(F.min("recovery_days"), F.max("recovery_days")).first()[0] >= 5
