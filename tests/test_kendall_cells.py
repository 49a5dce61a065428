"""Kendall's tau by cells: all kinds of cells beside a plain count of pairs, and what the work may cost."""

import math
import os
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cairn.operators import kendall as K


def plain(a, b):
    """(n, tau-b, z) from the signs of all pairs of rows that have both values."""
    kept = ~(np.isnan(a) | np.isnan(b))
    a, b = a[kept], b[kept]
    n = len(a)
    sa = (a[:, None] > a).astype(int) - (a[:, None] < a)
    sb = (b[:, None] > b).astype(int) - (b[:, None] < b)
    s, tot = int((sa * sb).sum()) // 2, n * (n - 1) // 2
    ta, tb = (np.unique(v, return_counts=True)[1].astype(object) for v in (a, b))

    def total(f, t):
        return sum(f(int(k)) for k in t)

    xt, yt = total(lambda t: t * (t - 1) // 2, ta), total(lambda t: t * (t - 1) // 2, tb)
    var = (n * (n - 1) * (2 * n + 5) - total(lambda t: t * (t - 1) * (2 * t + 5), ta)
           - total(lambda t: t * (t - 1) * (2 * t + 5), tb)) / 18
    var += 2 * xt * yt / (n * (n - 1))
    var += total(lambda t: t * (t - 1) * (t - 2), ta) * total(lambda t: t * (t - 1) * (t - 2), tb) / (9 * n * (n - 1) * (n - 2))
    return n, s / math.sqrt((tot - xt) * (tot - yt)), abs(s) / math.sqrt(var)


def odd_columns(n):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n)
    hot = np.where(rng.random(n) < 0.5, 0.25, x + rng.normal(size=n))       # half the rows one value
    few = rng.integers(0, 7, n).astype(float)
    many = rng.integers(0, 300, n).astype(float) - 0.3 * x                   # no value heavy
    ends = np.where(few == 3, np.inf, np.where(few == 5, -np.inf, np.where(few == 1, -0.0, np.where(few == 0, 0.0, x))))
    x[rng.random(n) < 0.1] = np.nan
    many[rng.random(n) < 0.2] = np.nan
    return {"x": x, "hot": hot, "few": few, "many": np.round(many), "ends": ends}


@pytest.mark.parametrize("bits,merge,dense", [(18, 5, True), (4, 1, True), (6, 2, False), (3, 3, False)])
def test_all_kinds_of_cells_beside_all_pairs(spark, monkeypatch, bits, merge, dense):
    if not dense:
        monkeypatch.setattr(K, "DENSE_COUNTS", 0)
        monkeypatch.setattr(K, "BATCH_ROWS", 100)
    cols = odd_columns(700)
    df = spark.createDataFrame(pd.DataFrame(cols)).repartition(5)
    got = K.kendall_pairs(df, list(cols), num_buckets=3, block_bits=bits, merge_bits=merge).toPandas()
    assert len(got) == 15
    for r, p in zip(got.itertuples(), got["_p"]):
        if r.col_a != r.col_b:
            n, tau, z = plain(cols[r.col_a], cols[r.col_b])
            assert r.n == n and abs(r.corr - tau) < 1e-12
            assert abs(p - math.erfc(z / math.sqrt(2))) < 1e-9


def test_open_cells_are_bounded(spark):
    """No open cell holds more than 2^bits rows, and rows of a column of few values are in none."""
    cols = odd_columns(6000)
    df = spark.createDataFrame(pd.DataFrame(cols)).repartition(3)
    names = list(cols)
    x = df.select(*[K.nan_to_null(K.F.col(c)).alias(c) for c in names])
    known = [int((~np.isnan(v)).sum()) for v in cols.values()]
    for bits in (5, 8, 11):
        for i, e in enumerate(K._edges(x, names, known, bits)):
            v = cols[names[i]]
            cells = K._cell(v, e)
            inside = cells[(cells >= 0) & (cells % 2 == 0)]
            assert len(inside) == 0 or np.bincount(inside).max() <= 1 << bits
            assert set(v[cells % 2 == 1][~np.isnan(v[cells % 2 == 1])]) <= set(e)
            if names[i] == "few":
                assert len(inside) == 0


def test_what_is_written_does_not_grow_with_rows_and_pairs(spark):
    """the points of all pairs were written and sorted; counts by cells are all that is written now."""
    from cairn.session import checkpoint_dir
    rng = np.random.default_rng(3)
    n = 40_000
    df = spark.createDataFrame(pd.DataFrame({"q": rng.integers(1, 51, n).astype(float), "e": rng.random(n),
                                             "d": rng.integers(0, 11, n) / 100, "t": rng.integers(0, 9, n) / 100}))
    at = checkpoint_dir(spark).removeprefix("file:")

    def written():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)

    before = written()
    r = K.kendall_pairs(df, ["q", "e", "d", "t"], block_bits=12).toPandas()
    assert len(r) == 10 and set(r.n) == {n}
    assert written() - before < n * 8


def test_a_group_fits_a_small_worker():
    """a full group of continuous values takes a few arrays of its length, and it is no longer than 2^18 rows."""
    rng = np.random.default_rng(4)
    n = 1 << K.BLOCK_BITS
    assert n <= 1 << 18
    values = [rng.random(n) for _ in range(5)]
    group = pa.table({"_col": pa.array(np.zeros(n, np.int32)), "_cell": pa.array(np.zeros(n, np.int32)),
                      **{f"_v{i}": pa.array(v) for i, v in enumerate(values)}})
    run = K._cell_terms([np.array([])] * 5, [(a, b) for a in range(5) for b in range(a + 1, 5)])
    tracemalloc.start()
    got = run(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 4 and peak < 80e6
