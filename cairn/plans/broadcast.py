"""Size-checked broadcast.

A side is broadcast only when its size is proven: either the caller knows a
hard bound by construction (one row per month, ten rows after a top-10, one
row of totals) and says so with :func:`broadcast_bounded`, or the rows are
counted up to a limit first (:func:`broadcast_if_small`).  Beyond the limit
the plain DataFrame is returned and the planner (AQE, with its runtime size
measurement) chooses a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row limit for a dimension that is checked at run time before broadcasting.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def broadcast_bounded(df: DataFrame, bound: str) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction.

    ``bound`` documents the bound (e.g. ``"1 row: global totals"``); it is
    kept in the code so every broadcast names its proof.
    """
    if not bound:
        raise ValueError("a broadcast needs a stated size bound")
    return F.broadcast(df)


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave it to the planner.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops early), so
    it is cheap for real dimensions and bounded for large ones.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
