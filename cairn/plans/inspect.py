"""Plan inspection through the public ``explain()`` output (for tests and tools)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "simple") -> str:
    """The physical plan as printed by ``df.explain(mode)``."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def single_partition_feeds(df: DataFrame) -> list[str]:
    """For every ``Exchange SinglePartition``, the first operator below it that
    is not a row-wise Project/Filter (expression ids stripped)."""
    lines = [re.sub(r"#\d+L?", "", ln).strip(" :+-") for ln in plan_text(df).splitlines()]
    feeds = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            j = i + 1
            while j < len(lines) and lines[j].startswith(("Project", "Filter")):
                j += 1
            if j < len(lines):
                feeds.append(lines[j])
    return feeds


def is_bounded_feed(feed: str, bounded_keys: tuple[str, ...] = ("__r",)) -> bool:
    """True if a single-partition exchange is fed by a keyless (partial)
    aggregate or by an aggregate keyed on a bounded summary key (per range)."""
    m = re.search(r"(?:HashAggregate|SortAggregate|ObjectHashAggregate)\((?:keys|key)=\[([^\]]*)\]", feed)
    if not m:
        return False
    keys = [k.strip() for k in m.group(1).split(",") if k.strip()]
    return not keys or keys[0] in bounded_keys
