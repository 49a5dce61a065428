"""Joins the reference's engine offers beyond equi-joins: the as-of join.

``asof_join`` matches every left row with the latest right row of the same key
whose timestamp is <= the left timestamp (left outer: no match gives NULLs).

Plan: left and right rows are unioned and put through one distributed ordered pass by
(key, timestamp, right before left).  In it a left row takes the latest right row above it in its own
range; what a range's first key had in earlier ranges is handed on by a prefix merge over the
ranges (one row each).  No per-key sort in one task, no pair enumeration and no join of rows
to rows, also for a key that holds a third of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordered import ordered_window


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              left_id: Sequence[str], right_id: Sequence[str], right_cols: Sequence[str],
              num_buckets: int | None = None) -> DataFrame:
    """Left rows with the ``right_cols`` of their as-of match.

    ``left_id`` / ``right_id`` identify rows uniquely within a side (they make the order total; among
    right rows of one timestamp the one with the largest id counts, in the ids' own order).  Equal
    timestamps match (right ts <= left ts).  Keys match as equal, NULL with NULL.
    """
    by, left_id, right_id, right_cols = list(by), list(left_id), list(right_id), list(right_cols)
    ltypes, rtypes = dict(left.dtypes), dict(right.dtypes)
    # each side's ids keep their own type: the other side has NULL there
    lcols, rcols = [c for c in left.columns if c not in by], right_cols
    lpart = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(False).alias("_right"),
                        *[F.col(c).alias(f"_li{i}") for i, c in enumerate(left_id)],
                        *[F.lit(None).cast(rtypes[c]).alias(f"_ri{i}") for i, c in enumerate(right_id)],
                        *[F.col(c).alias(f"_lv{i}") for i, c in enumerate(lcols)],
                        *[F.lit(None).cast(rtypes[c]).alias(f"_rv{i}") for i, c in enumerate(rcols)])
    rpart = right.select(*by, F.col(right_ts).alias("_ts"), F.lit(True).alias("_right"),
                         *[F.lit(None).cast(ltypes[c]).alias(f"_li{i}") for i, c in enumerate(left_id)],
                         *[F.col(c).alias(f"_ri{i}") for i, c in enumerate(right_id)],
                         *[F.lit(None).cast(ltypes[c]).alias(f"_lv{i}") for i, c in enumerate(lcols)],
                         *[F.col(c).alias(f"_rv{i}") for i, c in enumerate(rcols)])
    ids = [f"_ri{i}" for i in range(len(right_id))] + [f"_li{i}" for i in range(len(left_id))]
    values = [f"_rv{i}" for i in range(len(rcols))]
    # a right row without a timestamp matches nothing
    matched = ordered_window(lpart.unionByName(rpart.where(F.col("_ts").isNotNull())), ["_ts", ("_right", False)], ids,
                             partition_by=by, num_buckets=num_buckets, totals=False, ranks=False,
                             latest=("_right", values))
    known = F.col("_ts").isNotNull()         # nor does a left row without one
    return (matched.where(~F.col("_right"))
            .select(*by, *[F.col(f"_lv{i}").alias(c) for i, c in enumerate(lcols)],
                    *[F.when(known, F.col("latest_" + v)).alias(c) for v, c in zip(values, rcols)])
            .select(*left.columns, *right_cols))
