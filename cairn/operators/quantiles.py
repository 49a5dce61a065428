"""Exact quantiles by brackets: sketch, count, verify, fetch.

1. One aggregate pass (which callers share with their own aggregates) gives the number of values and a mergeable
   sketch of bounded size per group; from it come two values around each wanted rank.
2. One pass counts exactly what is below, inside and above the brackets.  A bracket that holds its ranks is proven;
   one that does not is widened to the side where the rank must be.  Brackets with few values bring
   their (value, count) pairs along in the same pass; others are narrowed by a sketch of the inside.
3. Passes go on until every rank is found.  With a sketch of accuracy 1/10,000 one counting pass is enough for
   three quantiles of some 4 * 10^7 values, and each further pass narrows the brackets about 150 times.

No row is shuffled: tasks reduce their rows to counts by region and to the distinct values inside the
brackets, which are proven few.  State on the driver: the brackets, one set per group.  Groups are looked
up by a broadcast of their brackets, up to ``MAX_GROUPS``; for more groups :func:`exact_quantiles` takes the
distributed ordered pass over (value, count) pairs instead, which splits hot groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.ordered import ordered_window
from cairn.plans.broadcast import broadcast_bounded

ACCURACY = 10_000
#: Distinct values a bracket may bring to the driver, for all groups together.
FETCH = 100_000
#: Groups whose brackets are kept on the driver and broadcast.
MAX_GROUPS = 10_000
#: Cells of the sketch of a bracket's inside, where values are too many to fetch.
GRID = 400
#: How far from a rank, in sketch errors, its bracket reaches.
SLACK = 3


def _probes(shares: Sequence[float], accuracy: int) -> list[float]:
    reach = SLACK / accuracy
    return [min(1.0, max(0.0, s + d)) for s in shares for d in (-reach, reach)]


def sketch(value: Column, probs: Sequence[float], accuracy: int = ACCURACY) -> Column:
    """Aggregate for the first pass: values around the quantiles ``probs``; NULLs are ignored."""
    return F.percentile_approx(value, [float(p) for p in _probes(probs, accuracy)], accuracy)


@dataclass
class _Bracket:
    """Values from ``low`` to ``high`` (None: open) hold the wanted ranks, as far as is known."""

    ranks: list[int]
    low: object = None
    high: object = None
    inside: int | None = None          # about so many values between the ends


def _falls_after(a, b) -> bool:
    """a > b as the engine orders them: NaN is the largest value."""
    if isinstance(b, float) and math.isnan(b):
        return False
    return (isinstance(a, float) and math.isnan(a)) or a > b


class _Ordered:
    """Sort key of a value, NaN last."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other) -> bool:
        return _falls_after(other.value, self.value)


class Brackets:
    """The search for exact quantiles of ``value_col`` in groups of ``by``; ``df`` has no NULL values."""

    def __init__(self, df: DataFrame, value_col: str, probs: Sequence[float], by: Sequence[str] = (),
                 accuracy: int = ACCURACY, fetch: int = FETCH):
        self.df, self.value, self.by = df, value_col, list(by)
        self.kind = dict(df.dtypes)[value_col]
        self.probs, self.accuracy, self.fetch = [float(p) for p in probs], accuracy, fetch
        self.n: dict[tuple, int] = {}
        self.open: dict[tuple, list[_Bracket]] = {}
        self.found: dict[tuple, dict[int, object]] = {}
        self.passes = 0

    def start(self, rows: Sequence[Row], count: str, probes: str) -> None:
        """Rows of the first pass: the group, the number of its values, its sketch."""
        for r in rows:
            key, n = tuple(r[c] for c in self.by), r[count]
            self.n[key] = n
            self.found[key] = {}
            if n:
                ranks = [sorted({math.floor((n - 1) * p), math.ceil((n - 1) * p)}) for p in self.probs]
                self.open[key] = [_Bracket(k, r[probes][2 * i], r[probes][2 * i + 1]) for i, k in enumerate(ranks)]

    def run(self) -> dict[tuple, list[float | None]]:
        """Group -> its quantiles; None in a group without values."""
        while self.open:
            self._pass(self.open)
            self.open = {key: left for key, bs in self.open.items() if (left := [b for b in bs if b.ranks])}
        return {key: self._values(key) for key in self.n}

    def _pass(self, todo: dict[tuple, list[_Bracket]]) -> None:
        self.passes += 1
        share, budget, fetched = 2 * (SLACK + 1) / self.accuracy, self.fetch, set()
        expected = {key: sum(math.ceil(self.n[key] * share) if b.inside is None else b.inside for b in bs)
                    for key, bs in todo.items()}
        for key in sorted(expected, key=expected.get):
            if expected[key] <= budget:          # few values inside by the sketch's error, or by a count
                budget -= expected[key]
                fetched.add(key)
        rows, ends = self._with_bounds(todo, fetched)
        v, take = F.col(self.value), ends.pop()
        # between the ends, and equal to them: a hot value at an end is found by its count
        inside = [w & (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi)) for w, lo, hi in ends]
        some = F.lit(False)
        for x in inside:
            some = some | x
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, (w, lo, hi) in enumerate(ends):
            aggs += [F.count_if(w & lo.isNotNull() & (v < lo)).alias(f"b{i}"), F.count_if(w & (v == lo)).alias(f"l{i}"),
                     F.count_if(inside[i]).alias(f"i{i}"), F.count_if(w & (v == hi)).alias(f"h{i}")]
        if len(fetched) < len(todo):
            cells = [c / GRID for c in range(GRID + 1)]
            aggs += [F.percentile_approx(F.when(x & ~take, v), cells, self.accuracy).alias(f"g{i}")
                     for i, x in enumerate(inside)]
        got = rows.groupBy(*self.by, F.when(take & some, v).alias("__at")).agg(*aggs).collect()
        counted: dict[tuple, list[Row]] = {key: [] for key in todo}
        for r in got:
            key = tuple(r[c] for c in self.by)
            if key in counted:
                counted[key].append(r)
        for key, bs in todo.items():
            todo[key] = [part for i, b in enumerate(bs) for part in self._read(key, b, i, counted[key], key in fetched)]

    def _with_bounds(self, todo, fetched) -> tuple[DataFrame, list]:
        """The rows with (wanted, low, high) of each open bracket, and whether values are fetched: literals
        for one group, columns of a broadcast table for several."""
        width = max(len(bs) for bs in todo.values())

        def cells(key) -> list:
            flat = [x for b in todo[key] for x in (True, b.low, b.high)]
            return flat + [False, None, None] * (width - len(todo[key])) + [key in fetched]

        if not self.by:
            at = cells(())
            take = F.lit(at.pop())
            return self.df, [(F.lit(at[3 * i]), F.lit(at[3 * i + 1]).cast(self.kind), F.lit(at[3 * i + 2]).cast(self.kind))
                             for i in range(width)] + [take]
        names = [f"__{x}{i}" for i in range(width) for x in "wlh"] + ["__take"]
        kinds = ["boolean", self.kind, self.kind] * width + ["boolean"]
        keys = [f"__k{j} {t}" for j, (_, t) in enumerate(self.df.select(*self.by).dtypes)]
        table = self.df.sparkSession.createDataFrame(
            [(*key, *cells(key)) for key in todo], ", ".join([*keys, *[f"{n} {t}" for n, t in zip(names, kinds)]]))
        cond = F.lit(True)
        for j, c in enumerate(self.by):
            cond = cond & F.col(c).eqNullSafe(F.col(f"__k{j}"))
        joined = self.df.join(broadcast_bounded(table, f"{MAX_GROUPS} groups at most"), cond)
        return joined, [tuple(F.col(f"__{x}{i}") for x in "wlh") for i in range(width)] + [F.col("__take")]

    def _read(self, key: tuple, b: _Bracket, i: int, counts: list[Row], fetched: bool) -> list[_Bracket]:
        """Find the bracket's ranks, or say where they are: what is left of the bracket."""
        below, low, inside, high = (sum(r[f"{x}{i}"] for r in counts) for x in "blih")
        if b.low is not None and b.low == b.high:
            high = 0                                 # one value, counted once
        upto, found = below + low, self.found[key]
        found.update({r: b.low for r in b.ranks if below <= r < upto})
        found.update({r: b.high for r in b.ranks if upto + inside <= r < upto + inside + high})
        between = [r for r in b.ranks if upto <= r < upto + inside]
        left = []
        if between and fetched:
            for r in sorted((r for r in counts if r["__at"] is not None and r[f"i{i}"]), key=lambda r: _Ordered(r["__at"])):
                found.update({rank: r["__at"] for rank in between if upto <= rank < upto + r["n"]})
                upto += r["n"]
        elif between:
            left.append(self._narrowed(between, upto, inside, next(r[f"g{i}"] for r in counts if r["__at"] is None)))
        # where the sketch was off, ranks are further down or up
        down, up = [r for r in b.ranks if r < below], [r for r in b.ranks if r not in found and r not in between and r >= below]
        if down:
            left.append(_Bracket(down, None, b.low))
        if up:
            left.append(_Bracket(up, b.high, None))
        return left

    def _narrowed(self, ranks: list[int], below: int, inside: int, grid: Sequence) -> _Bracket:
        """The cells of the inside's sketch that can hold the ranks; the next pass proves them.
        The ends are values from between the old ones, so brackets shrink with every pass."""
        slack = (SLACK + 1) * GRID / self.accuracy
        first = max(0, math.floor((ranks[0] - below) / inside * GRID - slack))
        last = min(GRID, math.ceil((ranks[-1] - below + 1) / inside * GRID + slack))
        return _Bracket(ranks, grid[first], grid[last], math.ceil(inside * min(1.0, (last - first + 2 * slack) / GRID)))

    def _values(self, key: tuple) -> list[float | None]:
        n, found, out = self.n[key], self.found[key], []
        for p in self.probs:
            if not n:
                out.append(None)
                continue
            h = (n - 1) * p
            low, high = float(found[math.floor(h)]), float(found[math.ceil(h)])
            out.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        return out


def quantile_names(probs: Sequence[float], prefix: str = "q") -> list[str]:
    return [f"{prefix}_{str(p).replace('.', '_')}" for p in probs]


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], by: Sequence[str] = (),
                    num_buckets: int | None = None, prefix: str = "q", approx: bool = False,
                    accuracy: int = ACCURACY, max_groups: int = MAX_GROUPS, fetch: int = FETCH) -> DataFrame:
    """Exact linear-interpolation quantiles (``quantile_cont``/pandas ``quantile``).

    NULLs are ignored.  One row per group and one column per p, named ``<prefix>_<p>`` (e.g.
    ``q_0_25``); a table without values gives no row.  ``approx=True`` (opt-in, for a rank error of about
    1/``accuracy``) stops after the sketch.
    """
    by, names = list(by), quantile_names(probs, prefix)
    values = df.where(F.col(value_col).isNotNull()).select(*by, value_col)
    if approx:
        q = F.percentile_approx(F.col(value_col), [float(p) for p in probs], accuracy)
        agg = values.groupBy(*by).agg(q.alias("_qs"))
        return agg.select(*by, *[F.col("_qs")[i].cast("double").alias(n) for i, n in enumerate(names)])
    first = values.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), sketch(F.col(value_col), probs, accuracy).alias("__p"))
    rows = first.limit(max_groups + 1).collect() if by else first.collect()
    if len(rows) > max_groups:
        return _by_ordered_pass(values, value_col, probs, by, names, num_buckets)
    search = Brackets(values, value_col, probs, by, accuracy, fetch)
    search.start(rows, "__n", "__p")
    return _table(values, search.run(), by, names)


def quantiles_of_first_pass(df: DataFrame, first: DataFrame, value_col: str, probs: Sequence[float], by: Sequence[str],
                            names: Sequence[str], num_buckets: int | None = None, count: str = "count",
                            probes: str = "_probes", max_groups: int = MAX_GROUPS) -> DataFrame:
    """The rows of ``first``, a caller's own first pass with its ``count`` and :func:`sketch` columns, and the
    exact quantiles beside them.  ``first`` is computed once; beyond ``max_groups`` groups it stays in
    Spark and the quantiles are joined from the ordered pass."""
    by, names = list(by), list(names)
    values = df.where(F.col(value_col).isNotNull()).select(*by, value_col)
    rows = (first.limit(max_groups + 1) if by else first).collect()
    if len(rows) > max_groups:
        q = _by_ordered_pass(values, value_col, probs, by, names, num_buckets)
        return first.drop(probes).join(q, by, "left")
    search = Brackets(values, value_col, probs, by)
    search.start(rows, count, probes)
    found = search.run()
    kept = [f for f in first.schema.fields if f.name != probes]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])
    out = [(*[r[f.name] for f in kept], *found[tuple(r[c] for c in by)]) for r in rows]
    return df.sparkSession.createDataFrame(out, schema)


def _table(df: DataFrame, found: dict[tuple, list], by: list[str], names: list[str]) -> DataFrame:
    kinds = [f"`{c}` {t}" for c, t in df.select(*by).dtypes] + [f"{n} double" for n in names]
    rows = [(*k, *v) for k, v in found.items() if any(x is not None for x in v)]
    return df.sparkSession.createDataFrame(rows, ", ".join(kinds))


def _by_ordered_pass(values: DataFrame, value_col: str, probs, by: list[str], names: list[str],
                     num_buckets: int | None) -> DataFrame:
    """For many groups: cumulative counts over the sorted distinct values of each group."""
    counts = values.groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("__c"))
    ranked = ordered_window(counts, [value_col], [], partition_by=by, sum_cols=["__c"], num_buckets=num_buckets,
                            ranks=False, materialize=True)
    upto, n = F.col("running___c"), F.col("partition_sum___c")
    before = upto - F.col("__c")
    picks, hit = [], F.lit(False)
    for p, name in zip(probs, names):
        h = (n - 1) * F.lit(float(p))
        for end, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (before <= pos) & (pos < upto)
            hit = hit | here
            picks.append(F.max(F.when(here, F.col(value_col))).alias(f"{name}_{end}"))
        picks.append(F.max(h - F.floor(h)).alias(f"{name}_d"))
    picked = ranked.where(hit).groupBy(*by).agg(*picks)
    out = [F.col(c) for c in by]
    for name in names:
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        out.append(F.when(hi == lo, lo).otherwise(lo + (hi - lo) * F.col(f"{name}_d")).alias(name))
    return picked.select(*out)
