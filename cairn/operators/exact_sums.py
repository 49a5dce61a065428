"""Sums and means of doubles that do not depend on the order of rows.

``sum`` over doubles rounds at every addition, so a retry, another partitioning or another merge order
changes the last digits.  Here a double is cut, exactly, into whole numbers of 20 bits in bins of
fixed weight (bin k counts units of 2^(20 k - 1074)).  Bins are summed as bigint with Spark's partial
aggregation, which has no rounding; one carry pass over a group's bins then rounds once, half to even.
The result is the double nearest to the true sum, whatever the rows' order.

A first aggregate finds the smallest and the largest size in each column, so that only the bins between
them are summed: five or six for most columns, 105 at most.  The second reads the rows and shuffles one
row a group.  2^43 rows a group cannot overflow a bin; beyond that ANSI arithmetic raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_BITS = 20
#: The smallest double is 2^-1074; the largest is below 2^1024.
LOWEST = -1074
BINS = (1024 - LOWEST) // BIN_BITS + 1
#: Bits of a double's fraction; bins that hold the carry out of the last one; digits that hold 61 bits or more.
FRACTION, CARRY_BINS, HEAD = 52, 3, 4


def _weight(k: int) -> float:
    return math.ldexp(1.0, BIN_BITS * k + LOWEST)


def _used_bins(smallest: float | None, largest: float | None) -> range:
    """The bins that numbers of sizes ``smallest`` to ``largest`` can touch."""
    if largest is None:
        return range(0)
    last_bit = max(math.frexp(smallest)[1] - 1 - FRACTION, LOWEST)
    return range((last_bit - LOWEST) // BIN_BITS, (math.frexp(largest)[1] - 1 - LOWEST) // BIN_BITS + 1)


def _units(value: Column, k: int, top: bool) -> Column:
    """What ``value`` has in bin k; remainder and quotient by powers of two are exact."""
    size = F.abs(value)
    units = F.floor((size if top else size % F.lit(_weight(k + 1))) / F.lit(_weight(k)))
    return F.when(value < 0, -units).otherwise(units)


def _digits(totals: Column) -> Column:
    """Struct (carry, digits): the totals of all bins as digits from 0 to 2^20 - 1, lowest first; the carry has the sign."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(acc: Column, total: Column) -> Column:
        v = total + acc["carry"]
        return F.struct(F.shiftright(v, BIN_BITS).alias("carry"),
                        F.concat(acc["digits"], F.array(v.bitwiseAND(F.lit((1 << BIN_BITS) - 1).cast("bigint"))))
                        .alias("digits"))

    return F.aggregate(totals, start, step)


def _rounded(df: DataFrame) -> DataFrame:
    """``df`` (with ``_totals``: the units in every bin) and ``_sum``, the double nearest to the bins' sum."""
    mask = F.lit((1 << BIN_BITS) - 1).cast("bigint")
    df = df.withColumn("_sign", F.when(_digits(F.col("_totals"))["carry"] < 0, F.lit(-1)).otherwise(F.lit(1)))
    df = df.withColumn("_size", _digits(F.transform("_totals", lambda t: t * F.col("_sign"))))
    carry = F.col("_size.carry")
    df = df.withColumn("_all", F.concat(F.col("_size.digits"), F.array(*[
        F.shiftright(carry, BIN_BITS * i).bitwiseAND(mask) for i in range(CARRY_BINS)])))
    # the four highest digits hold 61 bits or more; what is below them only decides whether a tie is one
    df = df.withColumn("_low", F.greatest(F.lit(0), F.array_max(F.filter(
        F.sequence(F.lit(0), F.lit(BINS + CARRY_BINS - 1)), lambda k: F.get("_all", k) != 0)) - (HEAD - 1)))
    below = F.exists(F.slice("_all", F.lit(1), F.coalesce(F.col("_low"), F.lit(0))), lambda d: d != 0)

    def two(i: int) -> Column:
        return (F.get("_all", F.col("_low") + i + 1) * (1 << BIN_BITS) + F.get("_all", F.col("_low") + i)).cast("decimal(14,0)")

    # a decimal becomes the nearest double
    head = (two(2) * F.lit(1 << 2 * BIN_BITS).cast("decimal(13,0)") + two(0)
            + F.when(below, F.lit(0.5)).otherwise(F.lit(0.0)).cast("decimal(2,1)")).cast("double")
    weights = F.array(*[F.lit(_weight(k)) for k in range(BINS)])
    finite = F.coalesce(F.col("_sign") * head * F.get(weights, F.col("_low")), F.lit(0.0))
    total = (F.when((F.col("_nan") > 0) | ((F.col("_plus") > 0) & (F.col("_minus") > 0)), float("nan"))
             .when(F.col("_plus") > 0, float("inf")).when(F.col("_minus") > 0, float("-inf")).otherwise(finite))
    return df.withColumn("_sum", total)


def exact_sums(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``by`` columns, then ``n_<c>``, ``sum_<c>`` and ``mean_<c>`` for each column of numbers in ``cols``.

    The sum is the double nearest to the exact sum of the column's doubles, the mean that sum divided by
    the count.  NULLs are left out; a group of NULLs has n 0 and NULL sum and mean.  NaN, or both
    infinities, give NaN; a sum beyond the largest double is infinite.  Zeros of either sign sum to 0.0.
    Without ``by`` there is one row, also for an empty table; NULL keys are a group.  ``df`` is read twice.
    """
    by, cols = list(by), list(cols)
    keys = [F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    x = df.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    finite = {i: F.when(~F.isnan(f"_x{i}") & (F.abs(f"_x{i}") < float("inf")), F.col(f"_x{i}")) for i in range(len(cols))}
    sizes = {i: F.nullif(F.abs(v), F.lit(0.0)) for i, v in finite.items()}
    ends = x.agg(*[f(v).alias(f"{tag}{i}") for i, v in sizes.items() for tag, f in (("lo", F.min), ("hi", F.max))]).first()
    used = {i: _used_bins(ends[f"lo{i}"], ends[f"hi{i}"]) for i in sizes} if sizes else {}

    aggs = []
    for i, v in finite.items():
        aggs += [F.count(f"_x{i}").alias(f"_n{i}"), F.count_if(F.isnan(f"_x{i}")).alias(f"_nan{i}"),
                 F.count_if(F.col(f"_x{i}") == float("inf")).alias(f"_plus{i}"),
                 F.count_if(F.col(f"_x{i}") == float("-inf")).alias(f"_minus{i}")]
        aggs += [F.sum(_units(v, k, k == used[i][-1])).alias(f"_u{i}_{k}") for k in used[i]]
    groups = x.groupBy(*names).agg(*aggs)

    def totals(i: int) -> Column:
        return F.array(*[F.coalesce(F.col(f"_u{i}_{k}"), F.lit(0).cast("bigint")) if k in used[i]
                         else F.lit(0).cast("bigint") for k in range(BINS)])

    # one row a group and column: the carry pass is written once
    sums = _rounded(groups.select(*names, F.posexplode(F.array(*[
        F.struct(F.col(f"_n{i}").alias("n"), F.col(f"_nan{i}").alias("nan"), F.col(f"_plus{i}").alias("plus"),
                 F.col(f"_minus{i}").alias("minus"), totals(i).alias("totals")) for i in range(len(cols))])).alias("_c", "s"))
        .select(*names, "_c", F.col("s.n").alias("_n"), F.col("s.nan").alias("_nan"), F.col("s.plus").alias("_plus"),
                F.col("s.minus").alias("_minus"), F.col("s.totals").alias("_totals")))
    sums = sums.select(*names, "_c", "_n", F.when(F.col("_n") > 0, F.col("_sum")).alias("_sum"))
    out = []
    for i, c in enumerate(cols):
        mine = F.col("_c") == i
        n, total = F.max(F.when(mine, F.col("_n"))), F.max(F.when(mine, F.col("_sum")))
        out += [n.alias(f"n_{c}"), total.alias(f"sum_{c}"), F.try_divide(total, n).alias(f"mean_{c}")]
    wide = sums.groupBy(*names).agg(*out)
    return wide.select(*[F.col(k).alias(b) for k, b in zip(names, by)],
                       *[f"{kind}_{c}" for c in cols for kind in ("n", "sum", "mean")])
