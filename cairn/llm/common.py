"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import checkpoint_dir

_ROOTS: dict[str, str] = {}


#: Rows in a batch that tasks exchange with Python: texts are long, Spark's 10,000 are for numbers.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return f"{_ROOTS[app]}/{tag}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, and a lost
    executor costs a re-read, not a re-computation."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of tasks so that each holds about ``rows_per_task`` rows, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def text_key(col: str | Column) -> Column:
    """Collision-free key of a text: 32 bytes, null for null."""
    return F.unhex(F.sha2(F.col(col) if isinstance(col, str) else col, 256))


#: A key is hot when it has more than one row in HOT_SHARE; there are fewer than HOT_SHARE such
#: keys whatever the size of the input, which bounds what is broadcast for them.
HOT_SHARE = 1000


def join_hot_safe(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per key) in which no key lands in one task.

    ``counts`` has (key, __n).  Keys with over total / HOT_SHARE rows (so fewer than HOT_SHARE
    of them) are looked up by a broadcast join, the others by a shuffled join.
    """
    hot = counts.filter(F.col("__n") > max(1, total // HOT_SHARE)).select(key).withColumn("__hot", F.lit(True))
    hot_lookup = F.broadcast(lookup.join(F.broadcast(hot), key).drop("__hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    warm = marked.filter(F.col("__hot").isNull()).drop("__hot").join(lookup, key, "left")
    return warm.unionByName(marked.filter(F.col("__hot")).drop("__hot").join(hot_lookup, key, "left"))


def components(edges: DataFrame, tag: str = "cc", checkpoint_every: int = 1) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), the smallest node.

    Alternating large-star / small-star steps as DataFrame joins; every round is written to
    the shared folder.  It ends when a round changes no edge.  Nothing but one count and one
    checksum per round reaches the driver.
    """
    def canonical(e: DataFrame) -> DataFrame:
        return (e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter(F.col("u") != F.col("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    cur = materialize(canonical(edges), tag)
    seen = mark(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest one
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")))
        mid = canonical(large)
        # small star: the smaller neighbours and the node itself are linked to the smallest one
        low2 = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = (mid.join(low2, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(low2.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        cur = materialize(canonical(small), tag)
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return (cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            .union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


#: Ranges at most, whatever the size of the input: bounds what the driver, closures and one-row-a-range tables hold.
MAX_RANGES = 8192


def range_buckets(df: DataFrame, col: str, buckets: int, tie: str, out: str = "__bucket") -> tuple[DataFrame, int]:
    """(``df`` with ``out``, n): the number, from 0 to n - 1, of the value range of the integer column ``col`` a row is in.

    n is ``buckets``, MAX_RANGES at most: tasks stream through their ranges, so a range may be of any size.  The
    bounds are approximate quantiles, so ranges have about the same number of rows; rows with equal values share
    a range, a null is in the first.  A value that fills ranges of its own is dealt over them by the hash of the
    column ``tie``; where there is none, only ``col`` is read and reaches Python.
    """
    buckets = max(1, min(buckets, MAX_RANGES))
    lowest = F.lit(-(2 ** 63)).cast("long")
    value = F.coalesce(F.col(col).cast("long"), lowest)
    cuts: list[int] = []
    if buckets > 1:
        share = [i / buckets for i in range(1, buckets)]
        got = df.select(F.percentile_approx(value, F.lit(share), F.lit(max(10_000, 4 * buckets)))).first()[0]
        cuts = sorted(got or [])
    bounds = np.asarray(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def number(s: pd.Series, h: pd.Series) -> pd.Series:
        v = s.to_numpy(np.int64)
        low, high = np.searchsorted(bounds, v, side="left"), np.searchsorted(bounds, v, side="right")
        own = np.maximum(high - low, 1)     # ranges that begin with this value
        return pd.Series((high - own * (high > low) + (h.to_numpy(np.int64) % own + 1) * (high > low)).astype(np.int32))

    hot = len(set(cuts)) < len(cuts)
    return df.withColumn(out, number(value, F.xxhash64(tie) if hot else F.lit(0).cast("long"))), buckets


def in_range_order(df: DataFrame, buckets: int, tasks: int, *order) -> DataFrame:
    """``df`` with its ranges dealt to ``tasks`` partitions in ascending order, each sorted by (range, ``order``)."""
    place = F.floor(F.col("__bucket").cast("long") * tasks / buckets).cast("int")
    return df.repartitionById(tasks, place).sortWithinPartitions("__bucket", *order)
