"""A total order over a table as numbered value ranges.

``range_number`` gives every row the number of the range its sort key falls in.  The bounds come from
a sample of the keys and stand as a literal in the expression, so the number depends on the row
alone: a task that is computed again, or a second reader of the same rows, gets the same ranges, and
nothing has to be written down to keep them.  The key ends in a tie-break, so neither a hot value nor
a hot partition key makes a large range.

A key column becomes one or two ascending columns (``ascending_key``); a struct of them compares as the
wanted order does.  The bounds are searched in three steps over a tree of about cube-root fan-out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges at most, whatever the session's settings; sampled keys a range, and at least.
MAX_RANGES, SAMPLE_PER_RANGE, SAMPLE_LEAST = 8192, 20, 4000
#: Ranges a shuffle partition: several small ones even out what one task gets.
RANGES_PER_PARTITION = 4
#: A table whose sample holds all its rows gets ranges of about so many rows.
SMALL_RANGE_ROWS = 2000


def ascending_key(name: str, kind: T.DataType, ascending: bool) -> list[Column]:
    """Columns that, compared one after another, order as ``name`` does, NULLs last in both directions."""
    c = F.col(name)
    null = c.isNull().cast("int")
    if isinstance(kind, T.BooleanType):
        c, kind = c.cast("int"), T.IntegerType()
    elif isinstance(kind, T.DateType):
        c, kind = F.unix_date(c), T.IntegerType()
    elif isinstance(kind, T.TimestampType):
        c, kind = F.unix_micros(c), T.LongType()
    elif isinstance(kind, T.TimestampNTZType):
        # text of a local time orders as the time does; a cast would depend on the session's zone
        c, kind = F.date_format(c, "yyyyyy-MM-dd HH:mm:ss.SSSSSS"), T.StringType()
    elif isinstance(kind, T.BinaryType):
        c, kind = F.hex(c), T.StringType()
    if isinstance(kind, T.IntegralType):
        return [null, c.cast("long") if ascending else F.bitwise_not(c.cast("long"))]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        c = c.cast("double")
        # NaN is the largest value: last in ascending order, first in descending order
        number = F.when(F.isnan(c) | (c == 0), F.lit(0.0)).otherwise(c if ascending else -c)
        rank = F.when(c.isNull(), 2).when(F.isnan(c), 1 if ascending else -1).otherwise(0)
        return [rank, number]
    if isinstance(kind, T.DecimalType):
        return [null, c if ascending else -c]
    if isinstance(kind, T.StringType):
        if ascending:
            return [null, c]
        # bytes turned round, and an end mark above them all: a prefix comes after what it begins
        return [null, F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"),
                               F.lit("G"))]
    raise TypeError(f"{name}: {kind.simpleString()} cannot be a sort key")


def key_struct(df: DataFrame, keys: Sequence[tuple[str, bool]], prefix: str = "k") -> Column:
    """One struct that orders as the columns ``keys`` (name, ascending) do."""
    parts = [p for name, asc in keys for p in ascending_key(name, df.schema[name].dataType, asc)]
    if not parts:
        return F.struct(F.lit(0).alias(f"{prefix}0"))
    return F.struct(*[p.alias(f"{prefix}{i}") for i, p in enumerate(parts)])


def _json(value) -> str:
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_json, value)) + "]"
    if hasattr(value, "items"):
        return "{" + ",".join(f"{json.dumps(k)}:{_json(v)}" for k, v in value.items()) + "}"
    return str(value) if isinstance(value, Decimal) else json.dumps(value)


def _tree(bounds: list[dict]) -> tuple[int, dict]:
    """(fan-out g, levels): every g*g-th bound; within such a stretch every g-th; the ones between."""
    g = 1
    while g ** 3 <= len(bounds):
        g += 1
    wide = g * g
    stretches = [bounds[i:i + wide] for i in range(0, len(bounds), wide)] or [[]]
    middle, fine = [], []
    for s in stretches:
        pieces = [s[i:i + g] for i in range(0, len(s), g)] or [[]]
        middle.append([p[-1] for p in pieces if len(p) == g][:g - 1])
        fine.append([p[:g - 1] for p in pieces])
    return g, {"a": [s[-1] for s in stretches if len(s) == wide], "b": middle, "c": fine}


def _found(levels: Column, key: Column, g: int) -> Column:
    """How many bounds are not above ``key``."""
    def count(bounds):
        return F.size(F.filter(bounds, lambda b: b <= key))

    wide = count(levels["a"])
    middle = F.get(levels["b"], wide)
    step = F.coalesce(count(middle), F.lit(0))
    fine = F.get(F.get(levels["c"], wide), step)
    rest = F.when(fine.isNull(), F.lit(0)).otherwise(count(fine))
    return (wide * (g * g) + F.greatest(step, F.lit(0)) * g + F.greatest(rest, F.lit(0))).cast("int")


def sample_bounds(df: DataFrame, key: Column, ranges: int | None = None) -> tuple[list[dict], T.DataType]:
    """Bounds that cut the rows by ``key`` into about equal ranges, and the key's type.

    The sample is the keys with the smallest hashes (a bounded top-k per task, the same keys in
    whatever order rows arrive).  Without ``ranges`` their number follows the session's shuffle
    partitions; a table that fits into the sample gets few.
    """
    spark = df.sparkSession
    wanted = ranges
    if wanted is None:
        partitions = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
                         or spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = RANGES_PER_PARTITION * partitions
    wanted = max(1, min(wanted, MAX_RANGES))
    size = max(SAMPLE_LEAST, SAMPLE_PER_RANGE * wanted)
    keys = df.select(key.alias("k"))
    # the sample's rows at equal distances; nothing but these bounds leaves the cluster
    sample = keys.orderBy(F.xxhash64("k"), "k").limit(size)
    n = F.size("all")
    several = F.least(F.lit(wanted), F.ceil(n / SMALL_RANGE_ROWS)) if ranges is None else F.lit(wanted)
    if ranges is None:
        several = F.when(n < size, several).otherwise(wanted)
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(several, F.lit(2)) - 1),
                                lambda i: F.floor(n * i / F.greatest(several, F.lit(1)))), lambda at: at > 0)
    got = (sample.agg(F.array_sort(F.collect_list("k")).alias("all"))
           .select(F.array_distinct(F.transform(cuts, lambda at: F.get("all", at.cast("int")))).alias("b")).first()["b"])
    return [b.asDict() for b in got if b is not None], keys.schema["k"].dataType


def range_number(df: DataFrame, key: Column, ranges: int | None = None, out: str = "_r") -> DataFrame:
    """``df`` with the number, from 0, of the range of ``key`` that a row is in."""
    bounds, kind = sample_bounds(df, key, ranges)
    g, levels = _tree(bounds)
    layout = T.StructType([T.StructField("a", T.ArrayType(kind)), T.StructField("b", T.ArrayType(T.ArrayType(kind))),
                           T.StructField("c", T.ArrayType(T.ArrayType(T.ArrayType(kind))))])
    literal = F.from_json(F.lit(_json(levels)), layout)
    keyed = df.withColumn("_key", key)
    return keyed.withColumn(out, _found(literal, F.col("_key"), g)).drop("_key")
