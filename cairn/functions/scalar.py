"""Scalar column helpers (all JVM-side built-ins, codegen friendly).

They pin down the few places where the reference's engine and Spark disagree
on the meaning of a scalar expression: rounding, month/day distances, x/0,
NaN versus NULL and right-closed binning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sql_round(col: str | Column, digits: int = 0) -> Column:
    """``ROUND(x, n)`` with the reference engine's rule: round(x * 10^n) / 10^n.

    The scale is applied in binary floating point first and the result rounded
    half away from zero, so ``1.005`` (stored as 1.00499...) gives ``1.0``.
    Spark's own ``round`` works on the decimal representation and gives 1.01.
    ``F.round(y, 0)`` is exact half-away-from-zero on the double ``y``.
    """
    scale = float(10 ** digits)
    return F.round(_c(col) * F.lit(scale), 0) / F.lit(scale)


def np_round(col: str | Column, digits: int = 0) -> Column:
    """numpy / pandas ``.round(n)``: rint(x * 10^n) / 10^n (half to even on the
    scaled double)."""
    scale = float(10 ** digits)
    return F.bround(_c(col) * F.lit(scale), 0) / F.lit(scale)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(_c(num), F.nullif(_c(den), F.lit(0)))


def nan_to_null(col: str | Column) -> Column:
    """Treat NaN as missing, like pandas does (Spark keeps NaN as a value)."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def month_start(col: str | Column) -> Column:
    """``DATE_TRUNC('month', ts)``: midnight of the first day of the month, as a
    timestamp without time zone (the reference engine returns TIMESTAMP)."""
    return F.to_timestamp_ntz(F.trunc(F.to_date(_c(col)), "month"))


def month_diff(start: str | Column, end: str | Column) -> Column:
    """``DATE_DIFF('month', a, b)``: month boundaries crossed (not elapsed months)."""
    a, b = _c(start), _c(end)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")


def day_diff(start: str | Column, end: str | Column) -> Column:
    """``DATE_DIFF('day', a, b)``: midnights crossed (calendar-date difference)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start))).cast("bigint")


def parse_datetime(col: str | Column, formats: Sequence[str]) -> Column:
    """Text to a timestamp without time zone: the first of ``formats`` (Spark patterns) that reads the
    whole text; NULL where none does, as for NULL, empty and impossible dates."""
    if not formats:
        raise ValueError("parse_datetime needs at least one format")
    c = F.trim(_c(col))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])


def cut(col: str | Column, bins: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """``pandas.cut`` with right-closed intervals ``(b0, b1], (b1, b2], ...``.

    Values outside ``(bins[0], bins[-1]]`` and NULL/NaN give NULL.  Without
    labels the interval text ``(b0, b1]`` is returned.
    """
    if len(bins) < 2:
        raise ValueError("cut needs at least two bin edges")
    if labels is not None and len(labels) != len(bins) - 1:
        raise ValueError("cut needs len(bins) - 1 labels")
    c = nan_to_null(col)
    out = None
    for i in range(len(bins) - 1):
        lo, hi = bins[i], bins[i + 1]
        label = labels[i] if labels is not None else f"({lo}, {hi}]"
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def clip(col: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """``numpy.clip``: bound a column to ``[lower, upper]`` (NULL stays NULL)."""
    c = _c(col)
    if lower is not None:
        c = F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lower)))
    if upper is not None:
        c = F.when(c.isNull(), c).otherwise(F.least(c, F.lit(upper)))
    return c


def choose(conditions: Sequence[Column], values: Sequence, default=None) -> Column:
    """``numpy.select`` / ``numpy.where``: the value of the first condition that holds, else ``default``
    (a NULL condition does not hold)."""
    if not conditions or len(conditions) != len(values):
        raise ValueError("choose needs as many values as conditions, one at least")
    out = F.when(conditions[0], values[0])
    for cond, value in zip(conditions[1:], values[1:]):
        out = out.when(cond, value)
    return out.otherwise(default)


def numeric_columns(df: DataFrame) -> list[str]:
    """``select_dtypes(include=number)``: numeric, not boolean, not string."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def month_label(col: str | Column) -> Column:
    """``strftime('%Y-%m')``."""
    return F.date_format(_c(col), "yyyy-MM")


def month_name_label(col: str | Column) -> Column:
    """``strftime('%b %Y')`` e.g. ``Mar 2024``."""
    return F.date_format(_c(col), "MMM yyyy")
