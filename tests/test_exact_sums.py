"""Sums of doubles against exact rational sums, under any order and partitioning."""

import math
import struct
from fractions import Fraction

import numpy as np
import pytest

from cairn.operators.exact_sums import exact_sums


def _nearest(values):
    total = sum((Fraction(v) for v in values), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def _bits(v):
    return struct.pack(">d", v)


def _groups():
    rng = np.random.default_rng(5)
    wide = (rng.normal(size=600) * 10.0 ** rng.integers(-8, 17, 600)).tolist()
    any_bits = [v for v in (struct.unpack(">d", rng.bytes(8))[0] for _ in range(400)) if math.isfinite(v)]
    return {
        "wide": wide, "any": any_bits, "cancel": wide + [-v for v in wide[:599]],
        "ties": [1.0, 2.0 ** -53], "above": [1.0, 2.0 ** -53, 2.0 ** -1074], "odd": [1.0 + 2.0 ** -52, 2.0 ** -53],
        "below": [1.0, 2.0 ** -53, -2.0 ** -1074],
        "small": [5e-324] * 7 + [-5e-324], "subnormal": [2.0 ** -1022, -2.0 ** -1060, 3e-320],
        "big": [1.7e308, 1.7e308, -1.7e308], "over": [1.7e308, 1.7e308], "under": [-1.7e308, -1.7e308],
        "edge": [v for k in range(-52, 52) for v in (math.ldexp(1.0, 20 * k - 14), -math.nextafter(math.ldexp(1.0, 20 * k - 14), 0))],
        "minus": [-v for v in (0.1, 0.2, 0.3, 1e16)], "zero": [0.0, -0.0], "tenths": [0.1] * 1000,
    }


@pytest.mark.parametrize("parts,descending", [(1, False), (7, True)])
def test_sum_is_the_nearest_double_in_any_order(spark, parts, descending):
    groups = _groups()
    rows = [(g, v) for g, values in groups.items() for v in values]
    rows = rows[::-1] if descending else rows
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r.g: r for r in exact_sums(df, ["g"], ["v"]).collect()}
    for g, values in groups.items():
        want = _nearest(values)
        assert _bits(got[g].sum_v) == _bits(want), (g, got[g].sum_v, want)
        assert got[g].n_v == len(values) and got[g].mean_v == want / len(values)


def test_missing_special_and_empty(spark):
    inf, nan = math.inf, math.nan
    rows = [("null", None, 1), ("some", None, 2), ("some", 2.5, 3), ("nan", nan, 4), ("nan", 1.0, 5),
            ("plus", inf, 6), ("plus", -1.0, 7), ("minus", -inf, 8), ("both", inf, 9), ("both", -inf, 10), (None, 4.0, 2 ** 40)]
    df = spark.createDataFrame(rows, "_c string, rows double, n long")
    got = {r["_c"]: r for r in exact_sums(df, ["_c"], ["rows", "n"]).collect()}
    assert got["null"]["n_rows"] == 0 and got["null"]["sum_rows"] is None and got["null"]["mean_rows"] is None
    assert (got["some"]["n_rows"], got["some"]["sum_rows"], got["some"]["sum_n"]) == (1, 2.5, 5.0)
    assert math.isnan(got["nan"]["sum_rows"]) and math.isnan(got["both"]["sum_rows"])
    assert got["plus"]["sum_rows"] == inf and got["minus"]["sum_rows"] == -inf
    assert got[None]["sum_rows"] == 4.0 and got[None]["mean_n"] == 2.0 ** 40
    empty = exact_sums(df.limit(0), [], ["rows"]).collect()
    assert [tuple(r) for r in empty] == [(0, None, None)]
    assert exact_sums(df.limit(0), ["_c"], ["rows"]).collect() == []


def test_rows_are_not_shuffled(spark):
    """The rows meet a partial sum before any exchange; no Python."""
    df = spark.range(1000).selectExpr("id % 3 AS g", "id / 7 AS v")
    plan = exact_sums(df, ["g"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "partial_sum" in plan
    assert plan.rindex("partial_sum") > plan.rindex("Exchange")     # printed from the result down to the scan
