"""Kendall's tau-b with p-value, exact and distributed.

Every column is cut by value: some of its values, among them each heavy one, are cells of their own (odd
numbers), and the values between two such neighbours are an open cell (even numbers) of at most 2^BLOCK_BITS
rows.  Two rows of a column pair (pairwise complete) then meet in one place only:

* in different cells of both columns: their order is that of the cells.  Rows are counted by (cell, cell), and
  the discordant pairs are the weighted inversions of these counts, as a merge sort would meet them: a group
  joins ``2^MERGE_BITS`` neighbouring cells of the first column, the next level as many of its groups.
* in one open cell of the first column: inversions of the second column's values, in the group of that cell.
* in one open cell of the second column only: inversions of the first column's cell numbers, in the group of that
  cell.

In a cell of one value all rows are tied.  So rows are shuffled once for each column in which they are in an
open cell, for all pairs together; a column of few values shuffles none.  A group's inversions are
counted in numpy bit by bit of the value's rank.  Ties are counted in the same places.

A column with itself has no pair to count: its row comes from one aggregate.

Ties: tau-b with the tie-corrected variance of the score; exact p-value where there are no
ties and n <= 33 or at most one pair is discordant (or concordant).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.tails import norm_sf_col
from cairn.functions.scalar import nan_to_null
from cairn.session import checkpoint_dir

#: Rows of an open cell at most, and neighbours that one merge of counts joins (as powers of two).
BLOCK_BITS, MERGE_BITS = 18, 5
#: Quantiles of a column at least: a value that holds more than two of their steps is a cell of its own.
LEAST_CELLS = 256
#: Open cells of a smaller table, while they keep so many rows.
SPREAD_CELLS, SPREAD_ROWS = 64, 1 << 12
#: Counts of (cell, cell) a task keeps as one array; rows it takes at once where there are more.
DENSE_COUNTS, BATCH_ROWS = 1 << 22, 1 << 18
#: What a pair's rows add up to: discordant pairs, pairs tied in both, and three tie sums for each column.
TERMS = ["dis", "ntie", "xtie", "x0", "x1", "ytie", "y0", "y1"]


def _inversions(seq: np.ndarray, w: np.ndarray | None = None) -> float:
    """Weight of the pairs with a larger whole number before a smaller one.

    Two numbers part at the highest bit in which they differ: with the numbers grouped by the bits
    above, each in its old order, a zero is discordant with the ones before it in its group.
    """
    if not len(seq):
        return 0.0
    total = 0.0
    for bit in range(int(seq.max()).bit_length() - 1, -1, -1):
        one = (seq >> bit) & 1
        group = seq >> (bit + 1)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[starts, len(seq)])
        ones = np.cumsum(one)
        before = ones - np.repeat(ones[starts] - one[starts], size)         # with the number itself
        zero = one == 0
        if w is None:
            total += float(before[zero].sum(dtype=np.float64))
        else:
            heavy = np.cumsum(one * w)
            at = heavy - np.repeat(heavy[starts] - (one * w)[starts], size)
            total += float((at[zero].astype(np.float64) * w[zero]).sum())
        # zeros of a group first, then its ones, both in their order
        zeros = size - np.add.reduceat(one, starts)
        first = np.repeat(starts, size)
        place = np.where(zero, np.arange(len(seq)) - before, first + np.repeat(zeros, size) + before - 1)
        moved = np.empty_like(seq)
        moved[place] = seq
        if w is not None:
            weights = np.empty_like(w)
            weights[place] = w
            w = weights
        seq = moved
    return total


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    return np.diff(np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])).astype(np.float64)


def _tie_sums(t):
    """The tie sums' addends of a value that t rows have (numbers or columns)."""
    return t * (t - 1) / 2, t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5)


def _cell(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cell numbers: 2i + 1 for the i-th edge itself, even between edges; -1 where there is no value."""
    cells = np.searchsorted(edges, values)
    if len(edges):
        cells = 2 * cells + (edges[np.minimum(cells, len(edges) - 1)] == values)
    cells[np.isnan(values)] = -1
    return cells


def _values(data, width: int) -> list[np.ndarray]:
    return [data.column(f"_v{i}").to_numpy(zero_copy_only=False) if isinstance(data, pa.RecordBatch)
            else data.column(f"_v{i}").to_numpy() for i in range(width)]


def _counts(edges: list[np.ndarray], pairs: list[tuple[int, int]]):
    """mapInArrow: (_pair, _a, _b, _w), rows by the cells of both columns; partial counts."""
    sizes = [2 * len(e) + 1 for e in edges]
    spans = [sizes[a] * sizes[b] for a, b in pairs]
    dense = sum(spans) <= DENSE_COUNTS

    def table(pair: int, at: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        a, b = np.divmod(at, sizes[pairs[pair][1]])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pair, np.int32)), pa.array(a.astype(np.int32)),
                                           pa.array(b.astype(np.int32)), pa.array(w.astype(np.int64))],
                                          names=["_pair", "_a", "_b", "_w"])

    def places(held: list[list[np.ndarray]]):
        cells = [_cell(np.concatenate([h[i] for h in held]), e) for i, e in enumerate(edges)]
        for pair, (a, b) in enumerate(pairs):
            both = (cells[a] >= 0) & (cells[b] >= 0)
            yield pair, (cells[a] * sizes[b] + cells[b])[both]

    def run(batches):
        sums = [np.zeros(s, np.int64) for s in spans] if dense else []

        def flush(held):
            for pair, at in places(held):
                if dense:
                    sums[pair] += np.bincount(at, minlength=spans[pair])
                elif len(at):
                    yield table(pair, *np.unique(at, return_counts=True))

        held, rows = [], 0
        for batch in batches:
            held.append(_values(batch, len(edges)))
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)
        for pair, s in enumerate(sums):
            at = np.flatnonzero(s)
            if len(at):
                yield table(pair, at, s[at])
    return run


def _open_rows(edges: list[np.ndarray]):
    """mapInArrow: a row for each column in which it is in an open cell: (_col, _cell, all values)."""
    def run(batches):
        for batch in batches:
            values = _values(batch, len(edges))
            for c, e in enumerate(edges):
                cells = _cell(values[c], e)
                at = np.flatnonzero((cells >= 0) & (cells % 2 == 0))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), c, np.int32)), pa.array(cells[at].astype(np.int32)),
                         *[pa.array(v[at]) for v in values]],
                        names=["_col", "_cell", *[f"_v{i}" for i in range(len(edges))]])
    return run


def _cell_terms(edges: list[np.ndarray], pairs: list[tuple[int, int]]):
    """applyInArrow: what the rows of one open cell of a column add to the column's pairs."""
    def run(rows: pa.Table) -> pa.Table:
        column = rows.column("_col")[0].as_py()
        values = _values(rows, len(edges))
        rank = np.unique(values[column], return_inverse=True)[1].astype(np.int64)
        out = []
        for pair, (a, b) in enumerate(pairs):
            if column not in (a, b):
                continue
            other = values[b if column == a else a]
            known = ~np.isnan(other)
            # in a cell of the second column, rows in one cell of the first are the first column's to count
            place = (np.unique(other[known], return_inverse=True)[1] if column == a
                     else _cell(other[known], edges[a])).astype(np.int64)
            if not len(place):
                continue
            span = int(place.max()) + 1
            ordered = np.sort(rank[known] * span + place)
            mine, place = ordered // span, ordered % span
            joint = ordered if column == a else ordered[place % 2 == 1]
            ties = [float(s.sum()) for s in _tie_sums(_runs(mine))]
            both = float(_tie_sums(_runs(joint))[0].sum()) if len(joint) else 0.0
            none = [0.0] * 3
            out.append([pair, _inversions(place), both, *(ties + none if column == a else none + ties)])
        return _term_table(out)
    return run


def _term_table(rows: list[list]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * (len(TERMS) + 1)
    return pa.table([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]],
                    names=["_pair", *TERMS])


def _merge_terms(group: pa.Table) -> pa.Table:
    """applyInArrow: discordant pairs between the cells (_child) that one merge joins."""
    a, b, w = (group.column(c).to_numpy().astype(np.int64) for c in ("_child", "_b", "_w"))
    order = np.lexsort((a, b))      # by the second column: the sequence is the few children
    return _term_table([[group.column("_pair")[0].as_py(), _inversions(a[order], w[order]), *[0.0] * (len(TERMS) - 1)]])


def _count_terms(counts: DataFrame, cells: int, merge_bits: int) -> DataFrame:
    """(_pair, TERMS, n) of counts by (cell, cell): pairs in different cells, and ties in cells of one value."""
    levels = max(1, -(-max(1, cells - 1).bit_length() // merge_bits))
    wide = (counts.select("_pair", "_a", "_b", "_w", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
            .select("_pair", "_level", "_b", "_w", F.expr(f"shiftright(_a, _level * {merge_bits})").alias("_at"))
            .select("_pair", "_level", "_b", "_w", F.shiftright("_at", merge_bits).alias("_parent"),
                    (F.col("_at") % (1 << merge_bits)).alias("_child"))
            .groupBy("_pair", "_level", "_parent", "_child", "_b").agg(F.sum("_w").alias("_w")))
    merged = (wide.groupBy("_pair", "_level", "_parent")
              .applyInArrow(_merge_terms, "_pair int, " + ", ".join(f"{t} double" for t in TERMS))
              .withColumn("n", F.lit(0.0)))
    # rows of a pair by the cell of one column
    sides = counts.select("_pair", "_w", F.explode(F.array(
        F.struct(F.lit(0).alias("y"), F.col("_a").alias("cell")),
        F.struct(F.lit(1).alias("y"), F.col("_b").alias("cell")))).alias("s"))
    t = F.col("t")
    ties = (sides.where(F.col("s.cell") % 2 == 1).groupBy("_pair", "s").agg(F.sum("_w").cast("double").alias("t"))
            .groupBy("_pair").agg(*[F.sum(F.when(F.col("s.y") == y, term).otherwise(0.0)).alias(name)
                                    for y, names in enumerate((TERMS[2:5], TERMS[5:]))
                                    for name, term in zip(names, _tie_sums(t))])
            .select("_pair", F.lit(0.0).alias("dis"), F.lit(0.0).alias("ntie"), *TERMS[2:], F.lit(0.0).alias("n")))
    w = F.col("_w").cast("double")
    both = (counts.groupBy("_pair").agg(
        F.sum(F.when((F.col("_a") % 2 == 1) & (F.col("_b") % 2 == 1), _tie_sums(w)[0]).otherwise(0.0)).alias("ntie"),
        F.sum(w).alias("n")).select("_pair", F.lit(0.0).alias("dis"), "ntie", *[F.lit(0.0).alias(c) for c in TERMS[2:]], "n"))
    return merged.unionByName(ties).unionByName(both)


def _edges(x: DataFrame, cols: Sequence[str], counts: Sequence[int], block_bits: int) -> list[np.ndarray]:
    """Values of each column that are cells of their own, so that at most 2^block_bits rows are between two of them.

    They are quantiles with an error of an eighth of their distance.  Each value that two quantiles in a row
    share is among them.
    """
    # two thirds of the limit each; a smaller table is spread over some tasks as well
    wanted = [max(-(-3 * n // (2 << block_bits)), min(SPREAD_CELLS, n // SPREAD_ROWS)) for n in counts]
    steps = max(LEAST_CELLS, *wanted)
    probs = [i / steps for i in range(steps + 1)]
    row = x.agg(*[F.percentile_approx(F.col(c), probs, 8 * steps).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    edges = []
    for i, k in enumerate(wanted):
        q = np.array(row[i] or [], dtype=np.float64) + 0.0          # -0.0 is 0.0
        if not len(q):
            edges.append(q)
            continue
        stride = max(1, steps // max(1, k))
        edges.append(np.unique(np.r_[q[::stride], q[1:][q[1:] == q[:-1]]]))
    return edges


def kendall_p_exact(n: int, c: int) -> float:
    """Two-sided exact p-value of Kendall's tau without ties (c = min(dis, tot - dis)).

    The permutations of n values with k inversions are the coefficients of the product over j <= n of
    1 + q + .. + q^(j-1); p is twice the share of those with c inversions at most.  Integers throughout.
    """
    if n > 200:     # c is 0 or 1 here: at most n permutations of n!, under the smallest double
        return 0.0
    ways = [1] + [0] * c
    for j in range(2, n + 1):
        ways = [sum(ways[max(0, k - j + 1):k + 1]) for k in range(c + 1)]
    return min(1.0, float(Fraction(2 * sum(ways), math.factorial(n))))


@F.pandas_udf(T.DoubleType())
def _kendall_exact_udf(n: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided p; the caller passes NULL for rows that do not qualify
    (ties, or n > 33 with more than one discordant and concordant pair)."""
    out = []
    for nn, cc in zip(n, c):
        if pd.isna(nn) or pd.isna(cc) or nn < 1 or (nn > EXACT_MAX_N and cc > 1):
            out.append(float("nan"))
        else:
            out.append(kendall_p_exact(int(nn), int(round(cc))))
    return pd.Series(out, dtype=float)


# exact p-value when there are no ties and n <= 33 (or at most one discordant/concordant pair)
EXACT_MAX_N = 33


def kendall_pairs(df: DataFrame, cols: Sequence[str], num_buckets: int | None = None,
                  block_bits: int = BLOCK_BITS, merge_bits: int = MERGE_BITS) -> DataFrame:
    """col_a, col_b, n, corr (tau-b), _p for every unordered pair incl. the diagonal.

    ``num_buckets``: shuffle partitions of the open cells' rows; by default the session's.
    """
    cols = list(cols)
    spark = df.sparkSession
    x = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    pairs = [(a, b) for a in range(len(cols)) for b in range(a + 1, len(cols))]
    own = x.agg(*[f(F.col(c)).alias(f"{tag}{i}") for i, c in enumerate(cols)
                  for tag, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    known = [own[f"n{i}"] for i in range(len(cols))]
    own = spark.createDataFrame(
        [(c, c, known[i], 1.0 if known[i] and own[f"lo{i}"] < own[f"hi{i}"] else None, 1.0) for i, c in enumerate(cols)],
        "col_a string, col_b string, n bigint, corr double, _p double")
    if not pairs:
        return own
    edges = _edges(x, cols, known, block_bits)
    filled = x.select(*[F.coalesce(F.col(c), F.lit(float("nan"))).alias(f"_v{i}") for i, c in enumerate(cols)])
    checkpoint_dir(spark)
    counts = (filled.mapInArrow(_counts(edges, pairs), "_pair int, _a int, _b int, _w bigint")
              .groupBy("_pair", "_a", "_b").agg(F.sum("_w").alias("_w"))).checkpoint(eager=True)
    value_types = ", ".join(f"_v{i} double" for i in range(len(cols)))
    rows = filled.mapInArrow(_open_rows(edges), f"_col int, _cell int, {value_types}")
    if num_buckets:
        rows = rows.repartition(num_buckets, "_col", "_cell")
    terms = (rows.groupBy("_col", "_cell")
             .applyInArrow(_cell_terms(edges, pairs), "_pair int, " + ", ".join(f"{t} double" for t in TERMS))
             .withColumn("n", F.lit(0.0))
             .unionByName(_count_terms(counts, max(2 * len(e) + 1 for e in edges), merge_bits)))
    stats = (terms.groupBy("_pair").agg(*[F.sum(c).alias(c) for c in [*TERMS, "n"]])
             .withColumnRenamed("dis", "_dis"))
    n = F.col("n")
    tot = n * (n - 1) / 2
    cmd = tot - F.col("xtie") - F.col("ytie") + F.col("ntie") - 2 * F.col("_dis")
    denom = F.sqrt(tot - F.col("xtie")) * F.sqrt(tot - F.col("ytie"))
    tau = F.when(denom > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cmd / denom)))
    m = n * (n - 1.0)
    var = ((m * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18 + 2 * F.col("xtie") * F.col("ytie") / m
           + F.when(n > 2, F.col("x0") * F.col("y0") / (9 * m * (n - 2))).otherwise(F.lit(0.0)))
    z = F.try_divide(cmd, F.sqrt(var))
    c = F.least(F.col("_dis"), tot - F.col("_dis"))
    exact = (F.col("xtie") == 0) & (F.col("ytie") == 0) & ((n <= EXACT_MAX_N) | (c <= 1))
    p = (F.when((n < 2) | (tot - F.col("xtie") <= 0) | (tot - F.col("ytie") <= 0), F.lit(None))
         .when(exact, _kendall_exact_udf(F.when(exact, n), F.when(exact, c)))
         .when(var > 0, F.least(F.lit(1.0), 2 * norm_sf_col("_kz"))))
    names = spark.createDataFrame([(i, cols[a], cols[b]) for i, (a, b) in enumerate(pairs)],
                                  "_pair int, col_a string, col_b string")
    stats = stats.withColumn("_kz", F.abs(z))
    out = stats.select("_pair", n.cast("bigint").alias("n"), tau.alias("corr"), p.alias("_p"))
    # one row per column pair on the left: a few rows
    return names.join(out, "_pair", "left").select(
        "col_a", "col_b", F.coalesce(F.col("n"), F.lit(0)).alias("n"), "corr", "_p").unionByName(own)
