"""Window helpers at scale: ROW_NUMBER and LEAD/LAG over any partitioning.

``sequence`` numbers rows with the distributed ordered pass, in which a hot partition key is split
over many tasks.  LEAD and LAG come from the same pass: inside a range from its own rows, across a
border from the neighbouring range's first or last row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cairn.operators.ordered import ordered_window


def sequence(df: DataFrame, partition_by: Sequence[str], order_by: Sequence, tiebreak: Sequence[str],
             lead_cols: Sequence[str] = (), lag_cols: Sequence[str] = (),
             num_buckets: int | None = None) -> DataFrame:
    """Add ``row_number`` and ``lead_<c>`` / ``lag_<c>`` (offset 1) columns."""
    return ordered_window(df, order_by, tiebreak, partition_by=partition_by, num_buckets=num_buckets,
                          totals=False, ranks=False, lead=lead_cols, lag=lag_cols)
