"""Statistical operators: extended describe, Welch t, chi-square, Mann-Whitney U,
Cohen's d, Cramér's V, correlation matrices with p-values.

Every test is: Spark aggregates the input to one row per test (or per group
of ``by`` columns) -> closed form over that row with column expressions ->
tail probability as a JVM column expression (``cairn.functions.tails``;
only the exact small-sample Mann-Whitney distribution uses a pandas UDF).
Samples are (DataFrame, value column) pairs; two samples are one DataFrame
with a group column.  NaN is treated as missing, as pandas does.

Results are DataFrames with the keys of the reference's result dicts as
columns.  Rounding: 4 dp for statistics, 6 dp for p-values, 2 dp for
percentages, using :func:`cairn.functions.scalar.sql_round`
(half away from zero; Python's ``round`` is half-even, which differs only on
exact binary ties).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.dist import MWU_EXACT_MAX_N, mwu_exact_sf_udf
from cairn.functions.tails import chi2_sf_col, norm_sf_col, t_two_sided_col
from cairn.functions.scalar import nan_to_null, numeric_columns, sql_round
from cairn.operators.ordered import ordered_window
from cairn.operators.quantiles import exact_quantiles, quantiles_of_first_pass, sketch
from cairn.plans.broadcast import broadcast_bounded
from cairn.session import checkpoint_dir

# Effect-size labels (fixed values): upper bounds (exclusive) and labels,
# Cohen's d on |d|, Cramér's V on V; at or above the last bound: "large".
COHENS_D_BOUNDS = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")]
CRAMERS_V_BOUNDS = [(0.1, "negligible"), (0.3, "small"), (0.5, "medium")]
LARGE_LABEL = "large"

# Interpretation sentences (fixed values): (significant, not significant) per test.
TTEST_TEXT = ("Statistically significant difference", "No significant difference")
CHI2_TEXT = ("Significant association", "No significant association")
MWU_TEXT = ("Significant difference in distributions", "No significant difference")


def _label(value: Column, bounds) -> Column:
    out = None
    for hi, name in bounds:
        cond = value < F.lit(hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.when(value.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(LARGE_LABEL)))


def interpret_cohens_d(d: Column) -> Column:
    return _label(F.abs(d), COHENS_D_BOUNDS)


def interpret_cramers_v(v: Column) -> Column:
    return _label(v, CRAMERS_V_BOUNDS)


def _fmt_alpha(alpha: float) -> str:
    return repr(float(alpha)) if float(alpha) != int(alpha) else str(alpha)


def _interpretation(p: Column, significant: Column, alpha: float, yes: str, no: str) -> Column:
    a = _fmt_alpha(alpha)
    ptxt = F.when(p.isNull(), F.lit("nan")).otherwise(F.format_string("%.4f", p))
    return F.when(significant, F.concat(F.lit(f"{yes} (p="), ptxt, F.lit(f" < {a})"))) \
        .otherwise(F.concat(F.lit(f"{no} (p="), ptxt, F.lit(f" >= {a})")))


def _join_groups(left: DataFrame, right: DataFrame, by: list[str], bound: str) -> DataFrame:
    """Attach per-group results; without groups the right side is one row (or
    none, for empty input: the left outer join keeps the left row)."""
    if by:
        return left.join(right, on=by, how="left")
    return left.join(broadcast_bounded(right, bound), how="left")


# ---------------------------------------------------------------------------
# M-1 describe
# ---------------------------------------------------------------------------

QUARTILES = [0.25, 0.5, 0.75]
DESCRIBE_KEYS = ["count", "mean", "median", "std", "min", "q1", "q3", "max", "iqr",
                 "outlier_count", "outlier_pct", "skewness", "kurtosis", "missing", "missing_pct"]


def describe_numeric(df: DataFrame, col: str, by: Sequence[str] = (),
                     num_buckets: int | None = None, materialize: bool = False,
                     approx_quantiles: bool = False) -> DataFrame:
    """Extended describe: count, mean, median, std, min, q1, q3, max, IQR,
    IQR-fence outliers, bias-corrected skewness and excess kurtosis, missing.

    Pass 1 is one aggregate: moments, min/max, missing and the sketch around the quartiles; pass 2 counts
    and fetches inside the sketch's brackets until the quartiles are proven (exact); the last pass
    counts values strictly outside the fences q1 - 1.5 IQR and q3 + 1.5 IQR.  No rows are shuffled.
    Percentages divide by all rows including missing ones.  ``materialize=True`` checkpoints the (narrow)
    input first: worth it when ``df`` is an expensive derived DataFrame, since the passes would otherwise
    recompute it; a plain table scan is cheaper to re-read.  ``approx_quantiles=True`` opts into
    ``percentile_approx`` for the quartiles.
    """
    by = list(by)
    x = nan_to_null(F.col(col).cast("double"))
    base = df.select(*by, x.alias("_x"))
    if materialize:
        checkpoint_dir(df.sparkSession)
        base = base.checkpoint(eager=True)
    first = base.groupBy(*by).agg(
        F.count("_x").alias("count"), F.count(F.lit(1)).alias("_rows"),
        F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_std"),
        F.stddev_pop("_x").alias("_sdp"),
        F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.skewness("_x").alias("_g1"), F.kurtosis("_x").alias("_g2"),
        sketch(F.col("_x"), QUARTILES).alias("_probes"))
    if approx_quantiles:
        q = exact_quantiles(base, "_x", QUARTILES, by=by, approx=True).toDF(*by, "_q1", "_med", "_q3")
        m = _join_groups(first.drop("_probes"), q, by, "1 row: global quantiles")
    else:
        m = quantiles_of_first_pass(base, first, "_x", QUARTILES, by, ["_q1", "_med", "_q3"], num_buckets)
    fences = m.select(*by, (F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
                      (F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_hi"))
    flagged = _join_groups(base, fences, by, "1 row: global fences")
    outliers = flagged.groupBy(*by).agg(
        F.count_if((F.col("_x") < F.col("_lo")) | (F.col("_x") > F.col("_hi"))).alias("outlier_count"))
    m = _join_groups(m, outliers, by, "1 row: global outlier count")
    n = F.col("count").cast("double")
    # pandas skew/kurt: adjusted Fisher-Pearson from population g1, g2; 0 for a constant column
    g1 = F.when(F.col("_sdp") == 0, F.lit(0.0)).otherwise(F.col("_g1"))
    g2 = F.when(F.col("_sdp") == 0, F.lit(-3.0)).otherwise(F.col("_g2"))
    skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    kurt = F.when(F.col("_sdp") == 0, F.when(n >= 4, F.lit(0.0))).otherwise(kurt)
    rows = F.col("_rows")
    missing = (rows - F.col("count"))
    outl = F.coalesce(F.col("outlier_count"), F.lit(0))
    return m.select(
        *by,
        F.col("count").cast("bigint").alias("count"),
        sql_round("_mean", 4).alias("mean"),
        sql_round("_med", 4).alias("median"),
        sql_round("_std", 4).alias("std"),
        sql_round("_min", 4).alias("min"),
        sql_round("_q1", 4).alias("q1"),
        sql_round("_q3", 4).alias("q3"),
        sql_round("_max", 4).alias("max"),
        sql_round(F.col("_q3") - F.col("_q1"), 4).alias("iqr"),
        outl.cast("bigint").alias("outlier_count"),
        sql_round(F.try_divide(outl * 100.0, rows), 2).alias("outlier_pct"),
        sql_round(skew, 4).alias("skewness"),
        sql_round(kurt, 4).alias("kurtosis"),
        missing.cast("bigint").alias("missing"),
        sql_round(F.try_divide(missing * 100.0, rows), 2).alias("missing_pct"))


# ---------------------------------------------------------------------------
# Two-sample moments (M-2, M-5)
# ---------------------------------------------------------------------------

def _two_sample_moments(df: DataFrame, value_col: str, group_col: str, group_a, group_b,
                        by: list[str]) -> DataFrame:
    x = nan_to_null(F.col(value_col).cast("double"))
    g = F.col(group_col)
    xa = F.when(g == F.lit(group_a), x)
    xb = F.when(g == F.lit(group_b), x)
    # other groups do not count: the filter reaches the scan
    return df.where(g.isin(group_a, group_b)).groupBy(*by).agg(
        F.count(xa).alias("n_a"), F.count(xb).alias("n_b"),
        F.avg(xa).alias("m_a"), F.avg(xb).alias("m_b"),
        F.var_samp(xa).alias("v_a"), F.var_samp(xb).alias("v_b"))


def _cohens_d_expr() -> Column:
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    # a group of one value has no variance: pooled is NULL and the effect 0.0
    pooled = F.sqrt(F.try_divide((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b"), na + nb - 2))
    return F.when(pooled > 0, (F.col("m_a") - F.col("m_b")) / pooled).otherwise(F.lit(0.0))


def cohens_d(df: DataFrame, value_col: str, group_col: str, group_a, group_b,
             by: Sequence[str] = ()) -> DataFrame:
    """Cohen's d = (mean_a - mean_b) / pooled sd (ddof 1); 0.0 when the pooled sd is 0."""
    by = list(by)
    m = _two_sample_moments(df, value_col, group_col, group_a, group_b, by)
    return m.select(*by, _cohens_d_expr().alias("cohen_d"))


def two_sample_ttest(df: DataFrame, value_col: str, group_col: str, group_a, group_b,
                     alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Welch's t-test of ``group_a`` vs ``group_b`` with Cohen's d.

    Columns: t_stat, p_value, alpha, significant, cohen_d, effect_size,
    mean_a, mean_b, mean_diff, interpretation (plus ``by`` keys).  A group
    with fewer than 2 values, or both variances 0, gives NULL t and p.
    """
    by = list(by)
    m = _two_sample_moments(df, value_col, group_col, group_a, group_b, by)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    se_a, se_b = F.col("v_a") / na, F.col("v_b") / nb
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & ((F.col("v_a") > 0) | (F.col("v_b") > 0))
    t = F.when(ok, (F.col("m_a") - F.col("m_b")) / F.sqrt(se_a + se_b))
    dof = F.when(ok, (se_a + se_b) * (se_a + se_b)
                 / (se_a * se_a / (na - 1) + se_b * se_b / (nb - 1)))
    r = m.select(*by, "n_a", "n_b", "m_a", "m_b", t.alias("_t"), dof.alias("_df"),
                 _cohens_d_expr().alias("_d"))
    r = r.withColumn("_p", F.when(F.col("_t").isNotNull(), t_two_sided_col("_t", "_df")))
    sig = F.coalesce(F.col("_p") < F.lit(alpha), F.lit(False))
    return r.select(
        *by,
        sql_round("_t", 4).alias("t_stat"),
        sql_round("_p", 6).alias("p_value"),
        F.lit(float(alpha)).alias("alpha"),
        sig.alias("significant"),
        sql_round("_d", 4).alias("cohen_d"),
        interpret_cohens_d(F.col("_d")).alias("effect_size"),
        sql_round("m_a", 4).alias("mean_a"),
        sql_round("m_b", 4).alias("mean_b"),
        sql_round(F.col("m_a") - F.col("m_b"), 4).alias("mean_diff"),
        _interpretation(F.col("_p"), sig, alpha, *TTEST_TEXT).alias("interpretation"))


# ---------------------------------------------------------------------------
# Chi-square independence (M-3, M-6)
# ---------------------------------------------------------------------------

def _chi_square_core(df: DataFrame, row_col: str, col_col: str, by: list[str],
                     yates: bool, count_col: str | None = None) -> DataFrame:
    """Per group: n, R, C, dof, chi2 (Yates-corrected when dof == 1 and ``yates``).

    Margins are multiplied as 38-digit decimals, so counts of any size neither overflow nor cancel: a
    seen cell adds (O - E)^2 / E with O - E = (O n - r c) / n exact, and all empty cells of the R x C grid
    together add n - sum of E over the seen cells = (n^2 - sum r c) / n, also exact.  In a 2x2 table |O - E| is the
    same in all four cells, and the sum of 1 / E is n (1/r1 + 1/r2) (1/c1 + 1/c2).
    """
    pairs = df.where(F.col(row_col).isNotNull() & F.col(col_col).isNotNull())
    weight = F.sum(F.col(count_col)).cast("bigint") if count_col else F.count(F.lit(1))
    cells = pairs.groupBy(*by, row_col, col_col).agg(weight.alias("_o")).where(F.col("_o") > 0)
    rows = cells.groupBy(*by, row_col).agg(F.sum("_o").alias("_r"))
    cols = cells.groupBy(*by, col_col).agg(F.sum("_o").alias("_c"))
    inverse = F.lit(1.0)
    rstat = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("R"), F.sum("_r").alias("n"),
                                  F.sum(inverse / F.col("_r")).alias("_inv_r"))
    cstat = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("C"), F.sum(inverse / F.col("_c")).alias("_inv_c"))
    margins = _join_groups(rstat, cstat, by, "1 row: margins")
    e = cells.join(rows, on=by + [row_col]).join(cols, on=by + [col_col])
    e = _join_groups(e, margins.select(*by, F.col("n").alias("_n")), by, "1 row: grand total")
    whole = "decimal(19,0)"
    rc = F.col("_r").cast(whole) * F.col("_c").cast(whole)
    off = F.abs((F.col("_o").cast(whole) * F.col("_n").cast(whole) - rc).cast("double")) / F.col("_n")
    agg = e.groupBy(*by).agg(
        F.sum(off * off * F.col("_n") / rc.cast("double")).alias("_seen"),
        F.sum(rc).alias("_rc"), F.max(off).alias("_off"))
    out = _join_groups(margins, agg, by, "1 row")
    n = F.col("n").cast("double")
    empty = (F.col("n").cast(whole) * F.col("n").cast(whole) - F.col("_rc")).cast("double") / n
    corrected = F.greatest(F.col("_off") - 0.5, F.lit(0.0)) ** 2 * n * F.col("_inv_r") * F.col("_inv_c")
    dof = ((F.col("R") - 1) * (F.col("C") - 1)).cast("bigint")
    chi2 = (F.when(dof == 0, F.lit(0.0)).when((dof == 1) & F.lit(bool(yates)), corrected)
            .otherwise(F.col("_seen") + empty))
    return out.select(*by, "n", "R", "C", dof.alias("dof"), chi2.alias("_chi2"))


def _cramers_v_expr() -> Column:
    min_dim = F.least(F.col("R"), F.col("C")) - 1
    return F.when(min_dim > 0, F.sqrt(F.col("_chi2") / (F.col("n") * min_dim))).otherwise(F.lit(0.0))


def chi_square_test(df: DataFrame, row_col: str, col_col: str, alpha: float = 0.05,
                    yates: bool = True, by: Sequence[str] = (), count_col: str | None = None) -> DataFrame:
    """Chi-square test of independence of two categorical columns (their crosstab).

    ``df`` holds one row per observation, or — with ``count_col`` — a long
    contingency table (row, col, count), e.g. the output of :func:`crosstab`.

    Columns: chi2, p_value, dof, alpha, significant, cramers_v, effect_size,
    interpretation.  A 2x2 table gets the Yates continuity correction (as the
    reference does implicitly); Cramér's V uses the same chi2.
    """
    by = list(by)
    core = _chi_square_core(df, row_col, col_col, by, yates, count_col)
    core = core.withColumn("_p", F.when(F.col("dof") == 0, F.lit(1.0))
                           .otherwise(chi2_sf_col("_chi2", "dof")))
    v = _cramers_v_expr()
    sig = F.coalesce(F.col("_p") < F.lit(alpha), F.lit(False))
    return core.select(
        *by,
        sql_round("_chi2", 4).alias("chi2"),
        sql_round("_p", 6).alias("p_value"),
        F.col("dof"),
        F.lit(float(alpha)).alias("alpha"),
        sig.alias("significant"),
        sql_round(v, 4).alias("cramers_v"),
        interpret_cramers_v(v).alias("effect_size"),
        _interpretation(F.col("_p"), sig, alpha, *CHI2_TEXT).alias("interpretation"))


def cramers_v(df: DataFrame, row_col: str, col_col: str, yates: bool = True,
              by: Sequence[str] = (), count_col: str | None = None) -> DataFrame:
    """Cramér's V = sqrt(chi2 / (n (min(R, C) - 1))); 0.0 when a dimension is 1."""
    by = list(by)
    core = _chi_square_core(df, row_col, col_col, by, yates, count_col)
    return core.select(*by, _cramers_v_expr().alias("cramers_v"))


def crosstab(df: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Long contingency table (row, col, n) of the non-NULL pairs."""
    return (df.where(F.col(row_col).isNotNull() & F.col(col_col).isNotNull())
            .groupBy(row_col, col_col).agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# Mann-Whitney U (M-4)
# ---------------------------------------------------------------------------

def mann_whitney_test(df: DataFrame, value_col: str, group_col: str, group_a, group_b,
                      alpha: float = 0.05, by: Sequence[str] = (),
                      num_buckets: int | None = None) -> DataFrame:
    """Two-sided Mann-Whitney U test of ``group_a`` vs ``group_b``.

    Only rows of the two groups are read.  Values are reduced to (value, n_a, n_b) — a heavily tied value is one row
    — and cumulative counts over the sorted distinct values (one distributed
    ordered pass) give mid-ranks, the rank sum of group a, the tie term and
    both medians.  U is reported for group a.  p: exact null distribution when
    the smaller sample has at most 8 values and there are no ties, whatever the
    size of the other; otherwise normal approximation with tie correction and
    continuity correction.
    """
    by = list(by)
    x = nan_to_null(F.col(value_col).cast("double"))
    g = F.col(group_col)
    counts = (df.where(g.isin(group_a, group_b)).select(*by, x.alias("_v"), g.alias("_g"))
              .where(F.col("_v").isNotNull()).groupBy(*by, "_v")
              .agg(F.count_if(F.col("_g") == F.lit(group_a)).alias("_na"),
                   F.count_if(F.col("_g") == F.lit(group_b)).alias("_nb"))
              .withColumn("_t", F.col("_na") + F.col("_nb")))
    r = ordered_window(counts, ["_v"], [], partition_by=by, sum_cols=["_t", "_na", "_nb"],
                       num_buckets=num_buckets, ranks=False, materialize=True)
    t = F.col("_t").cast("double")
    midrank = F.col("running__t") - F.col("_t") + (t + 1) / 2
    # medians of each group from the same cumulative counts
    med_parts = []
    for tag, cnt, run in (("a", "_na", "running__na"), ("b", "_nb", "running__nb")):
        tot = F.col("partition_sum_" + cnt)
        h = (tot - 1) * 0.5
        lo, hi = F.floor(h), F.ceil(h)
        before, upto = F.col(run) - F.col(cnt), F.col(run)
        med_parts += [
            F.max(F.when((F.col(cnt) > 0) & (before <= lo) & (lo < upto), F.col("_v"))).alias(f"_lo_{tag}"),
            F.max(F.when((F.col(cnt) > 0) & (before <= hi) & (hi < upto), F.col("_v"))).alias(f"_hi_{tag}"),
            F.max(h - lo).alias(f"_d_{tag}")]
    res = r.groupBy(*by).agg(
        F.sum("_na").cast("double").alias("n1"), F.sum("_nb").cast("double").alias("n2"),
        F.sum(F.col("_na") * midrank).alias("_r1"),
        F.sum(t * t * t - t).alias("_ties"), F.max("_t").alias("_maxt"), *med_parts)
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    res = res.withColumn("_u1", u1).withColumn("_u", F.greatest(F.col("_u1"), n1 * n2 - F.col("_u1")))
    n = n1 + n2
    s = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    # UDF arguments are evaluated for every row: keep them free of ANSI errors
    z = F.try_divide(F.col("_u") - n1 * n2 / 2 - 0.5, s)
    exact = (F.least(n1, n2) <= MWU_EXACT_MAX_N) & (F.col("_maxt") <= 1)
    res = res.withColumn("_z", z)
    p_asym = F.when(s > 0, F.least(F.lit(1.0), 2 * norm_sf_col("_z"))).otherwise(F.lit(1.0))
    p_exact = F.least(F.lit(1.0), 2 * mwu_exact_sf_udf(F.col("_u"), n1, n2))
    res = res.withColumn("_p", F.when((n1 > 0) & (n2 > 0), F.when(exact, p_exact).otherwise(p_asym)))

    def med(tag):
        lo, hi, d = F.col(f"_lo_{tag}"), F.col(f"_hi_{tag}"), F.col(f"_d_{tag}")
        return F.when(hi == lo, lo).otherwise(lo + (hi - lo) * d)

    sig = F.coalesce(F.col("_p") < F.lit(alpha), F.lit(False))
    return res.select(
        *by,
        sql_round(F.when((n1 > 0) & (n2 > 0), F.col("_u1")), 4).alias("u_stat"),
        sql_round("_p", 6).alias("p_value"),
        F.lit(float(alpha)).alias("alpha"),
        sig.alias("significant"),
        sql_round(med("a"), 4).alias("median_a"),
        sql_round(med("b"), 4).alias("median_b"),
        _interpretation(F.col("_p"), sig, alpha, *MWU_TEXT).alias("interpretation"))


# ---------------------------------------------------------------------------
# Correlation (M-8)
# ---------------------------------------------------------------------------

def _pearson_pairs(df: DataFrame, cols: list[str], pair_of=None) -> DataFrame:
    """One aggregate pass: pairwise-complete n and Pearson r for every unordered pair.

    ``pair_of(i, j)`` gives the SQL expressions standing for columns i and j in their pair (ranks for
    Spearman); default: the values with NaN as NULL.  Aggregates are written as
    SQL text: one expression per aggregate instead of many Column operations.
    """
    if pair_of is None:
        df = df.select(*[F.expr(f"CASE WHEN isnan(CAST(`{c}` AS DOUBLE)) THEN NULL ELSE CAST(`{c}` AS DOUBLE) END")
                         .alias(f"_v{i}") for i, c in enumerate(cols)])
    pair_of = pair_of or (lambda i, j: (f"_v{i}", f"_v{j}"))
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            xa, xb = pair_of(i, j)
            both = f"({xa} IS NOT NULL AND {xb} IS NOT NULL)"
            ka, kb = f"CASE WHEN {both} THEN {xa} END", f"CASE WHEN {both} THEN {xb} END"
            tag = f"{i}_{j}"
            aggs += [F.expr(f"count({ka})").alias(f"n_{tag}"),
                     F.expr(f"covar_pop({ka}, {kb})").alias(f"cv_{tag}"),
                     F.expr(f"stddev_pop({ka})").alias(f"sa_{tag}"),
                     F.expr(f"stddev_pop({kb})").alias(f"sb_{tag}")]
            pairs.append((a, cols[j], tag))
    row = df.agg(*aggs)
    structs = ", ".join(
        f"named_struct('col_a', '{a}', 'col_b', '{b}', 'n', n_{t}, 'corr', "
        f"CASE WHEN sa_{t} > 0 AND sb_{t} > 0 THEN greatest(-1.0D, least(1.0D, "
        f"try_divide(cv_{t}, sa_{t} * sb_{t}))) END)"
        for a, b, t in pairs)
    return row.select(F.expr(f"explode(array({structs}))").alias("s")).select("s.*")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson",
                       min_periods: int = 30, num_buckets: int | None = None) -> DataFrame:
    """Correlation matrix with p-values, long form: col_a, col_b, n, corr, p_value.

    All ordered pairs including the diagonal.  Pairwise-complete rows.  corr
    is NULL when a pair has fewer than ``min_periods`` rows or a column is
    constant; p_value is 1.0 on the diagonal and for pairs under
    ``min_periods``.  Pearson and Spearman p-values use t = r sqrt((n-2)/(1-r^2))
    with n-2 degrees of freedom.  Spearman ranks each column among the rows that
    are complete in its pair; one ordered pass gives the ranks for all pairs.
    """
    cols = list(cols) if cols else numeric_columns(df)
    if method == "pearson":
        long = _pearson_pairs(df, cols)
    elif method == "spearman":
        long = _spearman_pairs(df, cols, num_buckets)
    elif method == "kendall":
        from cairn.operators.kendall import kendall_pairs
        long = kendall_pairs(df, cols, num_buckets=num_buckets)
    else:
        raise ValueError(f"unknown method {method!r}")
    n = F.col("n").cast("double")
    ok = F.col("n") >= F.lit(min_periods)
    corr = F.when(ok, F.col("corr"))
    if method == "kendall":
        p_pair = F.col("_p")
    else:
        r = F.col("corr")
        long = long.withColumn("_tstat", F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))) \
            .withColumn("_dfn", n - 2)
        p_pair = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided_col("_tstat", "_dfn"))
    p = F.when(F.col("col_a") == F.col("col_b"), F.lit(1.0)).when(~ok, F.lit(1.0)).otherwise(p_pair)
    upper = long.select("col_a", "col_b", "n", corr.alias("corr"), p.alias("p_value"))
    # every unordered pair is computed once and emitted in both orders
    both = F.array(F.struct("col_a", "col_b", "n", "corr", "p_value"),
                   F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "n", "corr", "p_value"))
    return (upper.select(F.explode(F.when(F.col("col_a") == F.col("col_b"), F.slice(both, 1, 1))
                                   .otherwise(both)).alias("r"))
            .select("r.*"))


def _partner_midranks(x: DataFrame, width: int, partners: list[int], num_buckets: int | None) -> DataFrame:
    """(_c, _v, _r0 .. ): for each value of column number _c its mid-rank among all rows that have the column (_r0),
    and among those in which partners[0], partners[1], .. is present as well (_r1, ..).

    A value's rows are counted by which partners are present, so NULLs anywhere need no further pass: all
    columns and all partners are ranked in one distributed ordered pass over the distinct values.
    """
    kinds = [F.lit(True)] + [F.col(f"_x{j}").isNotNull() for j in partners]
    long = x.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_x{i}").alias("_v")) for i in range(width)]))
                    .alias("s"), *[p.alias(f"_p{k}") for k, p in enumerate(kinds)])
    counts = (long.select("s.*", *[f"_p{k}" for k in range(len(kinds))]).where(F.col("_v").isNotNull()).groupBy("_c", "_v")
              .agg(*[F.count_if(f"_p{k}").alias(f"_n{k}") for k in range(len(kinds))]))
    r = ordered_window(counts, ["_v"], [], partition_by=["_c"], sum_cols=[f"_n{k}" for k in range(len(kinds))],
                       num_buckets=num_buckets, totals=False, ranks=False, materialize=True)
    return r.select("_c", "_v", *[(F.col(f"running__n{k}") - F.col(f"_n{k}") + (F.col(f"_n{k}") + 1) / 2).alias(f"_r{k}")
                                  for k in range(len(kinds))])


def _spearman_pairs(df: DataFrame, cols: list[str], num_buckets: int | None) -> DataFrame:
    """Pearson of mid-ranks; a pair's ranks are among the rows that have both columns.

    A column without NULLs leaves its partners' ranks as they are, so there is one rank a value and one
    more for every column with NULLs.
    """
    x = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"_x{i}") for i, c in enumerate(cols)])
    missing = x.agg(*[F.count_if(F.col(f"_x{i}").isNull()) for i in range(len(cols))]).first()
    partners = [i for i in range(len(cols)) if missing[i]]
    # written once: every column's join reads its part
    ranks = _partner_midranks(x, len(cols), partners, num_buckets).checkpoint(eager=True)
    ranked = x
    for i in range(len(cols)):
        mine = ranks.where(F.col("_c") == i).select(F.col("_v").alias(f"_x{i}"), *[
            F.col(f"_r{k}").alias(f"_r{i}_{k}") for k in range(len(partners) + 1)])
        # one row per distinct value; a NULL finds none and stays out of the column's pairs
        ranked = ranked.join(mine, on=f"_x{i}", how="left")
    kind = {j: k + 1 for k, j in enumerate(partners)}
    return _pearson_pairs(ranked, cols, pair_of=lambda i, j: (f"_r{i}_{kind.get(j, 0)}", f"_r{j}_{kind.get(i, 0)}"))


def strong_correlations(df: DataFrame, cols: Sequence[str], threshold: float = 0.3,
                        method: str = "pearson", min_periods: int = 30) -> DataFrame:
    """Pairs (col_a < col_b by name) with |r| > ``threshold``: col_a, col_b, n, corr, p_value."""
    m = correlation_matrix(df, cols, method=method, min_periods=min_periods)
    return (m.where((F.col("col_a") < F.col("col_b")) & (F.abs(F.col("corr")) > F.lit(threshold)))
            .orderBy("col_a", "col_b"))


def lower_triangle(corr_long: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Heatmap data with the diagonal and upper triangle masked: cells whose
    row comes after the column in ``cols`` order."""
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return corr_long.where(pos[F.col("col_a")] > pos[F.col("col_b")])
