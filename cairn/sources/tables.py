"""The reference's five logical tables, read from the driver's parquet tables.

The reference builds ``customers``, ``products``, ``orders``, ``order_items``
and ``patients`` in pandas.  Here they are projections of the supplied
TPC-H-like tables, so every query's work grows with the data.  The oracle SQL
in ``__spark_entry__`` defines the same mapping as CTEs.

Mapping (fixed, shared with the oracle):
  customers   customer_id=c_custkey, name=c_name, country=n_name, segment=c_mktsegment
  products    product_id=p_partkey, name=p_name, category=p_type, subcategory=p_brand,
              unit_price=p_retailprice,
              cost_price=ROUND(p_retailprice * ((40 + p_size % 26) / 100), 2)
  orders      order_id=o_orderkey, customer_id=o_custkey, order_date=o_orderdate,
              status: F -> completed, O -> returned, else cancelled,
              channel=o_orderpriority
  order_items order_id=l_orderkey, product_id=l_partkey, quantity=l_quantity,
              unit_price=l_extendedprice / l_quantity
  patients    from events: group = treatment for click/signup else control, ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalar import cut, sql_round
from cairn.plans.broadcast import broadcast_if_small

# Age bands of the clinical notebook (fixed values): right-closed bins
# (49,59], (59,69], (69,79], (79,89] labelled 50-59, 60-69, 70-79, 80-89.
AGE_BINS = [49, 59, 69, 79, 89]
AGE_LABELS = ["50-59", "60-69", "70-79", "80-89"]

# Order status codes of the driver tables mapped onto the reference's statuses.
STATUS_BY_CODE = {"F": "completed", "O": "returned"}
OTHER_STATUS = "cancelled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation (25 rows in TPC-H), size-checked before it is broadcast."""
    return broadcast_if_small(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), max_rows=10_000)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer")
    nation = _nation(spark, sf_dir)
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_name").alias("name"),
                    F.col("n_name").alias("country"),
                    F.col("c_mktsegment").alias("segment")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    # (40 + size % 26) / 100: one correctly rounded division, e.g. exactly the double 0.47
    ratio = (F.lit(40) + F.col("p_size") % 26) / F.lit(100)
    return p.select(F.col("p_partkey").alias("product_id"),
                    F.col("p_name").alias("name"),
                    F.col("p_type").alias("category"),
                    F.col("p_brand").alias("subcategory"),
                    F.col("p_retailprice").alias("unit_price"),
                    sql_round(F.col("p_retailprice") * ratio, 2).alias("cost_price"))


def status_expr(code: str = "o_orderstatus"):
    """Status from the order code, as nested single-branch CASEs: a filter such
    as ``status = 'completed'`` then folds to ``o_orderstatus = 'F'`` and is
    pushed into the parquet scan (a multi-branch CASE is not simplified)."""
    c = F.col(code)
    out = F.lit(OTHER_STATUS)
    for k, v in reversed(list(STATUS_BY_CODE.items())):
        out = F.when(c.eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
    return out


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("order_date"),
                    status_expr().alias("status"),
                    F.col("o_orderpriority").alias("channel"))


def completed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status 'completed'.  Written on the raw code so the
    predicate reaches the parquet scan as a pushed filter."""
    o = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("order_date"),
                    F.lit("completed").alias("status"),
                    F.col("o_orderpriority").alias("channel"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"),
                     F.col("l_partkey").alias("product_id"),
                     F.col("l_quantity").alias("quantity"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical table derived from ``events`` (one patient per event)."""
    e = read_table(spark, sf_dir, "events")
    treat = F.col("event_type").isin("click", "signup").cast("int")
    followup = F.col("value") + F.lit(8) + (F.col("event_id") % 21) / F.lit(2.0) + treat * 10
    age = (F.lit(50) + F.col("user_id") % 35).cast("int")
    return (e.select(
        F.col("event_id").alias("patient_id"),
        age.alias("age"),
        cut(age, AGE_BINS, AGE_LABELS).alias("age_group"),
        F.when(treat == 1, F.lit("treatment")).otherwise(F.lit("control")).alias("group"),
        F.col("value").alias("baseline_score"),
        followup.alias("followup_score"),
        (F.lit(10) + (F.col("event_id") * 37) % 31 + (F.lit(1) - treat) * 10).cast("int").alias("recovery_days"),
        ((F.col("event_id") % 5) < (F.lit(1) + treat * 3)).alias("completed_programme"),
        sql_round(followup - F.col("value"), 1).alias("score_improvement"),
    ))


class DriverTables:
    """Convenience bundle: ``t = DriverTables(spark, dir); t.orders()``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def customers(self) -> DataFrame:
        return customers(self.spark, self.sf_dir)

    def products(self) -> DataFrame:
        return products(self.spark, self.sf_dir)

    def orders(self) -> DataFrame:
        return orders(self.spark, self.sf_dir)

    def completed_orders(self) -> DataFrame:
        return completed_orders(self.spark, self.sf_dir)

    def order_items(self) -> DataFrame:
        return order_items(self.spark, self.sf_dir)

    def patients(self) -> DataFrame:
        return patients(self.spark, self.sf_dir)


LOGICAL_TABLES = ("customers", "products", "orders", "order_items", "patients")


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Register the logical tables as temp views under the reference's names,
    for analyses written as Spark SQL (``spark.sql("SELECT ... FROM orders o
    JOIN order_items oi ...")``).  Views are lazy: nothing is read here."""
    t = DriverTables(spark, sf_dir)
    for name in LOGICAL_TABLES:
        getattr(t, name)().createOrReplaceTempView(name)
    return list(LOGICAL_TABLES)
