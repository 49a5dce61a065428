"""Distributed ordered windows: row_number, rank, dense_rank, running sums, LEAD / LAG and the latest
earlier row, without a single-partition sort.

``Window.orderBy(x)`` with no (or a low-cardinality) ``partitionBy`` makes Spark move every row into
one task.  Here the rows are dealt by ranges of the whole order instead:

1. ``range_number`` numbers the range of (partition keys, order keys, tie-break) a row is in.  The
   number is a pure expression of the row, so it needs no fixing on storage, and the tie-break splits a hot
   partition key or order value over many ranges like any other.
2. The rows are shuffled by that number and Spark's own window functions run inside
   (range, partition keys): numbers that restart in each range.
3. Only the first and the last partition key of a range can continue in another range.  Tasks
   aggregate one row per range (its *edges*: rows, distinct values, ties, sums, first and last rows of
   these two); prefix sums run over these rows, at most ``ranges.MAX_RANGES`` whatever the size of
   the input, and the result is broadcast.
4. The offsets are added to the local numbers; LEAD of a range's last row and LAG of its first
   come from the neighbouring range's edge, and so does the latest earlier row.

The result equals the plain window functions with ``ORDER BY <order keys>, <tie-break>`` (ranks
depend on the order keys only).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.ranges import key_struct, range_number
from cairn.plans.broadcast import broadcast_bounded
from cairn.session import checkpoint_dir


def _sort_expr(name: str, ascending: bool) -> Column:
    # Engine-independent NULL placement: NULLs last in both directions.
    return F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()


def _norm_order(order_by) -> list[tuple[str, bool]]:
    return [(item, True) if isinstance(item, str) else (item[0], bool(item[1])) for item in order_by]


def _addend(df: DataFrame, name: str) -> Column:
    """Value to sum: whole numbers stay whole (doubles would lose units beyond 2**53); NULL and NaN count as 0."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    c = F.col(name).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def ordered_window(df: DataFrame, order_by: Sequence, tiebreak: Sequence[str],
                   partition_by: Sequence[str] = (), sum_cols: Sequence[str] = (),
                   num_buckets: int | None = None, totals: bool = True, ranks: bool = True,
                   lead: Sequence[str] = (), lag: Sequence[str] = (),
                   latest: tuple[str, Sequence[str]] | None = None, materialize: bool = False) -> DataFrame:
    """Add global window numbers to ``df``.

    Args:
        order_by: order keys, ``"col"`` (ascending) or ``("col", ascending)``.
        tiebreak: columns that make the order total (unique together with the
            order and partition keys); row_number, running sums and ntile
            follow ``order_by`` then ``tiebreak``.
        partition_by: optional PARTITION BY keys (any cardinality, any skew).
        sum_cols: numeric columns for running sums (ROWS UNBOUNDED PRECEDING
            .. CURRENT ROW); NULL counts as 0 like SQL SUM over non-NULLs.
        num_buckets: number of ranges; by default a few for each of the session's
            shuffle partitions, which adaptive execution may join again.
        totals: add ``partition_rows`` and ``partition_sum_<col>``.
        ranks: add ``rank`` and ``dense_rank``.
        lead, lag: columns whose value in the next / previous row of the partition
            is added as ``lead_<col>`` / ``lag_<col>``.
        latest: (flag, columns): the values of ``columns`` in the latest row up to
            this one whose boolean column ``flag`` is true, as ``latest_<col>``.
        materialize: write ``df`` once to the shared folder before the three reads of this pass
            (sample, edges, rows): for an input that is more than a table scan.

    Adds ``row_number`` and what is asked for.  Columns whose names begin with two underscores are
    used inside; the input's columns may have any other name.
    """
    order, tiebreak, parts = _norm_order(order_by), list(tiebreak), list(partition_by)
    sum_cols, lead, lag = list(sum_cols), list(lead), list(lag)
    flag, latest_cols = (latest[0], list(latest[1])) if latest else (None, [])

    if materialize:
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    keys = [(c, True) for c in parts] + order + [(c, True) for c in tiebreak]
    rows = range_number(df, key_struct(df, keys), num_buckets, out="__r")
    rows = rows.repartition("__r").withColumn("__p", key_struct(df, [(c, True) for c in parts]))
    group = ["__r", "__p"]
    w = Window.partitionBy(*group).orderBy(*[_sort_expr(c, a) for c, a in keys[len(parts):]])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)

    peer = F.struct(*[F.col(c) for c, _ in order])
    local = rows.withColumns({
        "__rn": F.row_number().over(w).cast("long"),
        **({"__new": ~F.coalesce(F.lag(peer).over(w).eqNullSafe(peer), F.lit(False))} if ranks else {}),
        **{f"__s{i}": F.sum(_addend(df, c)).over(upto) for i, c in enumerate(sum_cols)},
        **({"__last": F.lead(F.lit(1)).over(w).isNull()} if lead else {}),
        **{f"__le{i}": F.lead(c).over(w) for i, c in enumerate(lead)},
        **{f"__la{i}": F.lag(c).over(w) for i, c in enumerate(lag)},
        **({"__at": F.last(F.when(F.col(flag), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(latest_cols)])),
                           ignorenulls=True).over(upto)} if latest else {}),
    })
    if ranks:
        # lag() of a partition's first row is no row: it starts a peer group whatever its value
        new = F.col("__new") | (F.col("__rn") == 1)
        local = local.withColumns({
            "__rank": F.max(F.when(new, F.col("__rn"))).over(upto),
            "__dense": F.sum(new.cast("long")).over(upto)})
    out = local
    if totals and parts:
        out = out.withColumns({
            "__n": F.count(F.lit(1)).over(whole),
            **{f"__t{i}": F.sum(_addend(df, c)).over(whole) for i, c in enumerate(sum_cols)}})

    edges = _edges(local, df, bool(parts), order, sum_cols, lead, lag, bool(latest), ranks)
    joined = out.join(broadcast_bounded(edges, "one row per range"), "__r", "left")
    in_first = F.col("__p") == F.col("__first_p")
    in_last = F.col("__p") == F.col("__end_p")

    def offset(field: str, zero) -> Column:
        return F.when(in_first, F.col("__first_" + field)).otherwise(zero)

    def total(field: str, here: str) -> Column:
        # of a partition without keys all rows are in the edges
        return (F.when(in_first, F.col("__first_" + field)).when(in_last, F.col("__end_" + field))
                .otherwise(F.col(here) if parts else F.lit(None)))

    zero = F.lit(0).cast("long")
    added = [(offset("before", zero) + F.col("__rn")).alias("row_number")]
    if ranks:
        tied = F.when(in_first & (F.col("__rank") == 1), F.col("__first_tied")).otherwise(zero)
        added += [(offset("before", zero) + F.col("__rank") - tied).alias("rank"),
                  (offset("dense", zero) + F.col("__dense")).alias("dense_rank")]
    if totals:
        added.append(total("n_all", "__n").alias("partition_rows"))
    for i, c in enumerate(sum_cols):
        added.append((F.col(f"__s{i}") + offset(f"off{i}", F.lit(0))).alias("running_" + c))
    if totals:
        added += [total(f"all{i}", f"__t{i}").alias("partition_sum_" + c) for i, c in enumerate(sum_cols)]
    added += [F.when(F.col("__last"), F.when(in_last, F.col("__end_next")[f"c{i}"])).otherwise(F.col(f"__le{i}"))
              .alias("lead_" + c) for i, c in enumerate(lead)]
    added += [F.when(F.col("__rn") == 1, F.when(in_first, F.col("__first_prev")[f"c{i}"])).otherwise(F.col(f"__la{i}"))
              .alias("lag_" + c) for i, c in enumerate(lag)]
    if latest:
        at = F.coalesce(F.col("__at"), F.when(in_first, F.col("__first_at")))
        added += [at[f"c{i}"].alias("latest_" + c) for i, c in enumerate(latest_cols)]
    return joined.select(*[F.col(c) for c in df.columns], *added)


def _edges(local: DataFrame, df: DataFrame, partitioned: bool, order, sum_cols, lead, lag, latest: bool,
           ranks: bool) -> DataFrame:
    """One row per range: offsets and totals of its first and its last partition key.

    What tasks aggregate has one row per range as well; the prefix sums over these rows are
    the only step outside the tasks.  Values of rows are moved as Arrow arrays, never converted.
    """
    peer, rn = key_struct(df, order), F.col("__rn")
    aggs = [F.count(F.lit(1)).alias("n")]
    if ranks:
        aggs += [F.max("__dense").alias("dist"), F.max("__rank").alias("top"),
                 F.min_by(peer, rn).alias("peer0"), F.max_by(peer, rn).alias("peer1")]
    aggs += [F.sum(_addend(df, c)).alias(f"s{i}") for i, c in enumerate(sum_cols)]
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(lead)]), rn).alias("row0"))
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(lag)]), rn).alias("row1"))
    if latest:
        # NULL where the partition has no such row in this range
        aggs.append(F.max_by("__at", rn).alias("held"))
    segments = local.groupBy("__r", "__p").agg(*aggs)
    one = F.struct(*[F.col(c) for c in segments.columns if c != "__r"])
    if partitioned:
        ends = segments.groupBy("__r").agg(F.min_by(one, "__p").alias("a"), F.max_by(one, "__p").alias("z"))
    else:
        ends = segments.select("__r", one.alias("a"), one.alias("z"))
    ends = ends.toArrow().sort_by("__r").combine_chunks()
    return _numbered_edges(df, ends, len(sum_cols), bool(lead), bool(lag), latest, ranks)


def _numbered_edges(df: DataFrame, ends: pa.Table, sums: int, lead: bool, lag: bool, latest: bool,
                    ranks: bool) -> DataFrame:
    ranges = len(ends)
    # the first key of range i is segment i, its last key segment ranges + i
    both = pa.chunked_array([*ends.column("a").chunks, *ends.column("z").chunks],
                            ends.schema.field("a").type).combine_chunks()
    field = {both.type.field(k).name: both.field(k) for k in range(both.type.num_fields)}
    plain = {k: field[k].to_pylist() for k in field if k not in ("row0", "row1", "held")}
    key = [tuple(p.values()) for p in plain["__p"]]
    peers = [[tuple(p.values()) for p in plain[k]] if ranks else None for k in ("peer0", "peer1")]
    walk = [s for i in range(ranges) for s in ((i,) if key[i] == key[ranges + i] else (i, ranges + i))]

    out = {k: [0] * (2 * ranges) for k in ("before", "n_all", "dense", "tied",
                                           *[f"off{i}" for i in range(sums)], *[f"all{i}" for i in range(sums)])}
    link: dict[str, list[int | None]] = {k: [None] * (2 * ranges) for k in ("prev", "next", "at")}
    at = 0
    while at < len(walk):
        run = [walk[at]]                         # the segments of one partition key
        while at + len(run) < len(walk) and key[walk[at + len(run)]] == key[run[0]]:
            run.append(walk[at + len(run)])
        at += len(run)
        rows, values, ties, carried = 0, 0, 0, None
        added = [0] * sums
        for j, s in enumerate(run):
            out["before"][s] = rows
            if ranks:
                joins = j > 0 and peers[1][run[j - 1]] == peers[0][s]
                out["dense"][s], out["tied"][s] = values - joins, ties if joins else 0
                values += plain["dist"][s] - joins
                # rows of this range's last value, and of earlier ranges if it began there
                tail = plain["n"][s] - plain["top"][s] + 1
                ties = tail + (ties if joins and plain["dist"][s] == 1 else 0)
            for i in range(sums):
                out[f"off{i}"][s] = added[i]
                added[i] += plain[f"s{i}"][s]
            link["prev"][s] = run[j - 1] if j else None
            link["next"][s] = run[j + 1] if j + 1 < len(run) else None
            link["at"][s] = carried
            if latest and field["held"][s].is_valid:
                carried = s
            rows += plain["n"][s]
        for s in run:
            out["n_all"][s] = rows
            for i in range(sums):
                out[f"all{i}"][s] = added[i]

    kinds = {f"s{i}": field[f"s{i}"].type for i in range(sums)}
    first = slice(0, ranges)
    # a range of one key has it as its first and as its last
    last = [ranges + i if key[i] != key[ranges + i] else i for i in range(ranges)]
    columns = {"__r": ends.column("__r"), "__first_p": field["__p"].slice(0, ranges),
               "__end_p": field["__p"].slice(ranges, ranges)}
    for k in ("before", "dense", "tied", "n_all"):
        columns["__first_" + k] = pa.array(out[k][first], pa.int64())
    columns["__end_n_all"] = pa.array([out["n_all"][s] for s in last], pa.int64())
    for i in range(sums):
        for k in (f"off{i}", f"all{i}"):
            columns["__first_" + k] = pa.array(out[k][first], kinds[f"s{i}"])
        columns[f"__end_all{i}"] = pa.array([out[f"all{i}"][s] for s in last], kinds[f"s{i}"])
    if lead:
        columns["__end_next"] = field["row0"].take(pa.array([link["next"][s] for s in last], pa.int64()))
    if lag:
        columns["__first_prev"] = field["row1"].take(pa.array(link["prev"][first], pa.int64()))
    if latest:
        columns["__first_at"] = field["held"].take(pa.array(link["at"][first], pa.int64()))
    return df.sparkSession.createDataFrame(pa.table(columns))


def percent_rank_col(rank: str = "rank", total: str = "partition_rows") -> Column:
    """PERCENT_RANK from a rank and the partition size: (rank-1)/(n-1), 0 if n=1."""
    return F.when(F.col(total) > 1, (F.col(rank) - 1) / (F.col(total) - 1)).otherwise(F.lit(0.0))


def ntile_col(k: int, row_number: str = "row_number", total: str = "partition_rows") -> Column:
    """NTILE(k) from a row number and the partition size (first n%k tiles get one more row)."""
    rn, n = F.col(row_number), F.col(total)
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return (F.when(rn <= big, F.ceil(rn / (q + 1)))
            .otherwise(r + F.ceil((rn - big) / q))).cast("bigint")
