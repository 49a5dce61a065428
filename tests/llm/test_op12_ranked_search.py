"""Ranked search (12) against a plain loop over all documents and queries, and its DuckDB statement."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import op12_ranked_search as op

WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in counts:
            m = 50 + (50 * c.total() * n_docs) // total
            s = 0
            for t in set(words(text)):
                df = sum(t in x for _, x in counts)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (
                    (10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=50):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    for clash in ("id", "n", "t", "tf", "q", "rank", "score", "term"):
        d, q = d.withColumn(clash, F.lit("x")), q.withColumn(clash, F.lit("y"))
    got = op.search(d.repartition(3), q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def corpus(seed, docs, vocabulary):
    r = np.random.default_rng(seed)
    ws = [f"w{i}" for i in range(vocabulary)]
    p = 1 / np.arange(1, vocabulary + 1)
    return [(int(i), " ".join(r.choice(ws, int(r.integers(1, 40)), p=p / p.sum()))) for i in range(docs)]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_ranks_equal_the_plain_loop(spark, k, monkeypatch):
    monkeypatch.setattr(op, "SHARD_DOCS", 60)      # several shards a task
    docs = corpus(k, 400, 80) + [(1000 + i, "w3 w3 w70") for i in range(120)] + [(7, "w1 again"), (7, "w1 again")]
    items = [(1, "W0 w3 w70 w70"), (2, "w79, w78; w2"), (3, "nothing known"), (4, "w3"), (1, "another w5"), (4, "w3"),
             (None, "w9 w10 w11 w12 w13")]
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_odd_rows(spark, odd_rows):
    items = [(1, "the CAT word5 İx"), (2, None), (3, ""), (4, "--"), (5, "ünïcode 日本 ß"), (6, "id here 12")]
    got = run(spark, odd_rows, items)
    assert got == brute(odd_rows, items, 50) and any(g[2] is None for g in got)
    assert run(spark, [], items) == [] == run(spark, odd_rows, [])
    assert run(spark, [(1, None), (2, " ")], items) == []


def test_blocks_of_queries_and_long_texts(spark, monkeypatch):
    docs, items = corpus(3, 200, 50), [(i, f"w{i} w{i * 7 % 50} w0") for i in range(30)]
    want = brute(docs, items, 5)
    monkeypatch.setattr(op, "BLOCK_BYTES", 600)
    assert run(spark, docs, items, 5) == want
    monkeypatch.setattr(op, "CUT_BYTES", 64)
    text = "Word wörd  x1-" * 500
    assert op.count_terms(text.encode()) == Counter(t.encode() for t in words(text))


def test_reading_ends_early_with_final_scores():
    """One rare term decides: the frequent term's list is not read to its end, scores are exact."""
    n = 5000
    r = np.random.default_rng(1)
    has_rare = np.zeros(n, bool)
    has_rare[:20] = True
    sizes = 1 + has_rare.astype(int)
    terms = np.concatenate([[0, 1] if h else [0] for h in has_rare]).astype(np.int32)
    tf = r.integers(1, 9, len(terms)).astype(np.int32)
    length = r.integers(10, 90, n)
    shard = op.Shard(list(range(n)), length, sizes, terms, tf, n, int(length.sum()))
    query = [(0, 3), (1, 5000), (9, 10)]
    score = np.zeros(n, np.int64)
    for term, w in query[:2]:
        docs, impact = shard.list_of(term)
        assert (np.diff(impact) <= 0).all()
        score[docs] += impact * w
    best = sorted(shard.best(query, 10), key=lambda x: (-x[0], x[1]))[:10]
    assert best == [(int(score[i]), int(i)) for i in np.lexsort((np.arange(n), -score))[:10]]
    assert shard.best(query, 10, least=int(score.max()) + 1) == []
    assert shard.list_of(9) is None


def test_sql_equals_the_operator(spark, odd_rows):
    import pandas as pd
    docs = [r for r in odd_rows if r[0] != 6] + corpus(8, 150, 30)
    items = [(1, "the CAT w1 w2"), (2, "w3 w3 DOCUMENT number"), (3, None)]
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.register(f"_{name}", pd.DataFrame(rows, columns=[key, "text"]).astype({key: "Int64"}))
        con.execute(f"CREATE TABLE {name} AS SELECT CAST({key} AS BIGINT) AS {key}, text FROM _{name}")
    assert sorted(con.execute(op.SQL).fetchall(), key=str) == run(spark, docs, items)
