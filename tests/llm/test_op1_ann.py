import math

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import op1_ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, asked, k):
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.float32(v).astype(float)
    out = {}
    for q in good:
        if asked(q):
            d = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)
            out[q] = d[:k]
    return out


def run(spark, rows, asked=lambda c: c % 100 == 0, **how):
    df = spark.createDataFrame([(i, v, 0, "s", "r") for i, v in rows], SCHEMA)
    return op1_ann.nearest(df, asked(F.col("vec_id")), **how).collect()


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(0).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    want = brute(rows, lambda q: q % 100 == 0, 10)
    got = {}
    for r in run(spark, rows, least_candidates=600):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        exact = {i: d for d, i in near}
        hits += len(set(exact) & {m[1] for m in mine})
        assert all(abs(exact[m[1]] - m[2]) < 1e-12 for m in mine if m[1] in exact)
    assert hits >= 0.9 * 10 * len(want)


def test_ties_copies_and_bad_vectors(spark):
    hot = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, hot) for i in range(0, 300)]
    rows += [(1000, None), (1100, [0.0] * 4), (1200, [1.0, None, 0.0, 0.0]), (1300, [float("nan"), 1.0, 0.0, 0.0]),
             (1400, [float("inf"), 1.0, 0.0, 0.0]), (1500, []), (1600, [-0.0, 1.0, 0.0, 0.0]), (1601, [0.0, 1.0, 0.0, 0.0]),
             (2 ** 53 + 1, [0.5, 0.5, 0.0, 0.0]), (1700, [1.0, 1.0])]
    want = brute([r for r in rows if r[0] != 1700], lambda q: q % 100 == 0, 10)
    got = {}
    for r in run(spark, rows):
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(want)
    for q in want:
        assert [(s, i) for _, s, i in sorted(got[q])] == want[q]


def test_few_candidates_and_empty(spark):
    assert run(spark, []) == []
    got = run(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1)]
    assert run(spark, [(0, [1.0, 2.0])]) == []
