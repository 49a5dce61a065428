"""The data reductions behind the reference's plots (drawing is not built).

* histogram: equal-width bins over [min, max] (last bin closed), with mean and median
* kde_curve: Gaussian KDE (Scott bandwidth) on a grid, scaled to histogram counts
* box_stats: quartiles, 1.5 IQR whiskers, flier counts per group, ordered by median
* rolling_mean: centered rolling mean over an ordered series
* ranked_top: top-n of a series (NULLs dropped)
Each reduces on the executors; only the small result (bins, grid, groups) is returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import nan_to_null
from cairn.operators.ordered import ordered_window
from cairn.operators.quantiles import quantiles_of_first_pass, sketch
from cairn.plans.broadcast import broadcast_bounded
from cairn.session import checkpoint_dir

# Plot defaults of the reference (fixed values).
HIST_BINS = 40
KDE_GRIDSIZE = 200
TOP_N = 15
WHISKER = 1.5

#: Cells a bandwidth, terms of the series, and bandwidths beyond which a kernel is not added.
KDE_CELLS, KDE_MOMENTS, KDE_REACH = 8, 11, 9.0


def _range_columns(s: DataFrame) -> DataFrame:
    """Bin range by numpy's rule: a constant sample's range is widened by 0.5."""
    same = F.col("_mn") == F.col("_mx")
    return s.select("*", F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                    F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))


def _range_aggs() -> list[Column]:
    return [F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.count("_x").alias("_n"), F.avg("_x").alias("_mean"),
            F.stddev_samp("_x").alias("_sd")]


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS, materialize: bool = False) -> DataFrame:
    """bin, bin_start, bin_end, count for ``bins`` equal-width bins (empty bins
    included), plus the sample mean and median on every row.

    Bin of x = min(floor((x - lo) * bins / (hi - lo)), bins - 1): half-open
    bins with the last one closed, as numpy/seaborn.  NULL/NaN are dropped.
    Three scans: range, mean and the median's sketch; the median's bracket; the bins.
    ``materialize=True`` checkpoints the one input column first (for an expensive derived ``df``).
    """
    x = df.select(nan_to_null(F.col(col).cast("double")).alias("_x")).where(F.col("_x").isNotNull())
    if materialize:
        checkpoint_dir(df.sparkSession)
        x = x.checkpoint(eager=True)
    first = x.agg(*_range_aggs(), sketch(F.col("_x"), [0.5]).alias("_probes"))
    one = quantiles_of_first_pass(x, first, "_x", [0.5], [], ["_median"], count="_n")
    st = broadcast_bounded(_range_columns(one), "1 row: range and median")
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))),
                F.lit(bins - 1)).cast("int")
    counts = x.crossJoin(st).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = x.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (spine.join(broadcast_bounded(counts, f"{bins} rows: one per bin"), "bin", "left")
            .crossJoin(st).where(F.col("_n") > 0)
            .select("bin",
                    (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                    F.col("_mean").alias("mean"), F.col("_median").alias("median"))
            .orderBy("bin"))


def _hermite_terms(u: Column, moments: list[Column]) -> Column:
    """sum over j of He_j(u) M_j / j!, He_j the Hermite polynomials: He_j+1 = u He_j - j He_j-1."""
    before, now, total, factorial = None, F.lit(1.0), moments[0], 1.0
    for j in range(1, len(moments)):
        before, now = now, (u * now if before is None else u * now - F.lit(float(j - 1)) * before)
        factorial *= j
        total = total + now * moments[j] / F.lit(factorial)
    return total


def kde_curve(df: DataFrame, col: str, gridsize: int = KDE_GRIDSIZE, bins: int = HIST_BINS) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (h = sd * n^(-1/5)) evaluated on
    ``gridsize`` points spanning [min, max]; ``density`` integrates to 1 and
    ``count`` is the curve scaled to the histogram (density * n * bin width).

    A fast Gauss transform: values are counted into cells of width h / 8 with the power sums M_j of v = (x - centre) / h,
    and the kernels of a cell at distance u h are exp(-u^2 / 2) sum He_j(u) M_j / j!.  With |v| <= 1/16 and
    ``KDE_MOMENTS`` terms the rest is under 1e-15 a value.  So rows are read twice and reduced where they are, at a
    cost that does not depend on the grid; only cells meet the grid, and those further than ``KDE_REACH`` bandwidths
    from a point add less than 1e-17 a value and are left out.
    """
    x = df.select(nan_to_null(F.col(col).cast("double")).alias("_x")).where(F.col("_x").isNotNull())
    st = _range_columns(x.agg(*_range_aggs())).withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    st = broadcast_bounded(st, "1 row: range and bandwidth")
    width = F.col("_h") / KDE_CELLS
    cell = F.floor((F.col("_x") - F.col("_mn")) / width)
    centred = x.crossJoin(st.select("_mn", "_h")).where(F.col("_h") > 0).select(
        cell.alias("_cell"), ((F.col("_x") - F.col("_mn")) / F.col("_h") - (cell + 0.5) / KDE_CELLS).alias("_v"))
    power, sums = F.lit(1.0), []
    for j in range(KDE_MOMENTS):
        sums.append(F.sum(power).alias(f"_m{j}"))
        power = power * F.col("_v")
    cells = centred.groupBy("_cell").agg(*sums)
    # a cell meets the points within reach, by their numbers
    step = (F.col("_mx") - F.col("_mn")) / F.lit(float(gridsize - 1))
    per_point = F.col("_h") / step                       # bandwidths are wider or narrower than the grid
    middle = (F.col("_cell") + 0.5) / KDE_CELLS * per_point
    reach = F.ceil(F.lit(KDE_REACH) * per_point)
    first = F.greatest(F.lit(0), F.floor(middle) - reach).cast("int")
    last = F.least(F.lit(gridsize - 1), F.ceil(middle) + reach).cast("int")
    met = cells.crossJoin(st).withColumn("point", F.explode(F.sequence(first, last)))
    u = (F.col("point") / per_point) - (F.col("_cell") + 0.5) / KDE_CELLS
    at = met.select("point", u.alias("_u"), *[f"_m{j}" for j in range(KDE_MOMENTS)])
    s = at.groupBy("point").agg(F.sum(F.exp(F.col("_u") * F.col("_u") * -0.5) * _hermite_terms(
        F.col("_u"), [F.col(f"_m{j}") for j in range(KDE_MOMENTS)])).alias("s"))
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    density = F.coalesce(F.col("s"), F.lit(0.0)) / norm
    points = x.sparkSession.range(gridsize).select(F.col("id").cast("int").alias("point"))
    return (points.join(broadcast_bounded(s, f"{gridsize} rows: one per point"), "point", "left")
            .crossJoin(st).where(F.col("_h") > 0)
            .select("point", (F.col("_mn") + F.col("point") * step).alias("x"),
                    density.alias("density"),
                    (density * F.col("_n") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))).alias("count"))
            .orderBy("point"))


def box_stats(df: DataFrame, value_col: str, group_col: str, whis: float = WHISKER,
              num_buckets: int | None = None, materialize: bool = False) -> DataFrame:
    """Per group: n, q1, median, q3, whisker_low/high (furthest values within
    whis * IQR of the quartiles), n_fliers (values beyond the whiskers) and
    ``order`` (1 = highest median, the reference's plotting order).

    Three scans: counts and sketches by group, brackets by group, whiskers.  Brackets and fences are a few numbers a
    group and reach the rows by broadcast up to ``quantiles.MAX_GROUPS`` groups.
    """
    x = (df.select(F.col(group_col).alias("_g"), nan_to_null(F.col(value_col).cast("double")).alias("_x"))
         .where(F.col("_x").isNotNull()))
    if materialize:   # for an expensive derived df: the scans re-read it
        checkpoint_dir(df.sparkSession)
        x = x.checkpoint(eager=True)
    first = x.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), sketch(F.col("_x"), [0.25, 0.5, 0.75]).alias("_probes"))
    q = quantiles_of_first_pass(x, first, "_x", [0.25, 0.5, 0.75], ["_g"], ["q1", "median", "q3"], num_buckets, count="n")
    fence = q.select(F.col("_g").alias("_k"), "n", "q1", "median", "q3",
                     (F.col("q1") - whis * (F.col("q3") - F.col("q1"))).alias("_lo"),
                     (F.col("q3") + whis * (F.col("q3") - F.col("q1"))).alias("_hi"))
    # one row per group: the planner broadcasts it from its measured size
    j = x.join(fence, F.col("_g").eqNullSafe(F.col("_k")))
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    g = j.groupBy("_g", "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"))
    # the place of a group among the medians: an ordered pass over one row per group
    order = ordered_window(g, [("median", False)], ["_g"], totals=False, ranks=False, materialize=True)
    return order.select(F.col("_g").alias(group_col), "n", "q1", "median", "q3", "whisker_low", "whisker_high",
                        "n_fliers", F.col("row_number").alias("order")).orderBy("order")


def rolling_mean(series: DataFrame, order_col: str, value_col: str, window: int,
                 center: bool = True, partition_by: Sequence[str] = ()) -> Column:
    """Rolling mean column (pandas ``rolling(window, center).mean()``): NULL
    unless all ``window`` values of the frame are present.

    Meant for an aggregated series (one row per period): the window's
    partition holds one row per period, not per fact row.
    """
    before = window // 2 if center else window - 1
    after = (window - 1) // 2 if center else 0
    w = Window.partitionBy(*partition_by).orderBy(order_col).rowsBetween(-before, after)
    v = nan_to_null(F.col(value_col))
    return F.when(F.count(v).over(w) == window, F.avg(v).over(w))


def pct_change(order_col: str, value_col: str, partition_by: Sequence[str] = ()) -> Column:
    """pandas ``pct_change()``: value / previous non-missing value - 1 (missing
    values forward-filled first); first row NULL; a zero previous value gives
    NULL instead of inf."""
    w = Window.partitionBy(*partition_by).orderBy(order_col)
    cur = F.last(nan_to_null(F.col(value_col)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    prev = F.last(nan_to_null(F.col(value_col)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(cur, F.nullif(prev, F.lit(0.0))) - 1


def ranked_top(df: DataFrame, label_col: str, value_col: str, n: int = TOP_N) -> DataFrame:
    """``series.nlargest(n)``: top ``n`` by value (NULLs dropped), ties by label."""
    top = (df.where(nan_to_null(F.col(value_col)).isNotNull())
           .orderBy(F.col(value_col).desc(), F.col(label_col).asc_nulls_last()).limit(n))
    w = Window.orderBy(F.col(value_col).desc(), F.col(label_col).asc_nulls_last())
    return top.select(label_col, value_col, F.row_number().over(w).alias("rank")).orderBy("rank")


def time_series_with_rolling(series: DataFrame, date_col: str, value_col: str,
                             window: int = 3) -> DataFrame:
    """Plot data of a time series: date, value and its centered rolling mean."""
    return series.select(date_col, value_col,
                         rolling_mean(series, date_col, value_col, window).alias("rolling_mean")
                         ).orderBy(date_col)
