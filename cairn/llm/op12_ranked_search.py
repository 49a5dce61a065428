"""Ranked lexical search with no random access (12): impact-sorted reads and score intervals.

1. One pass over the documents counts terms; only those of the queries are kept, so a row is a
   document's length and its query terms with their counts, written to the shared folder.
2. Numbers of documents and terms come from aggregates of that table.
3. Tasks stream through the table in shards of bounded postings.  In a shard every query term has its
   documents by falling impact.  For each query the lists are read from the top, all down to the
   same contribution, which falls from step to step.  A document's score lies between the sum of
   what was read of it and that sum plus the heads of the lists it has not been met in.  Reading ends
   when no document outside the candidates can reach the k-th best lower bound and both bounds
   of every candidate agree: membership, ties and scores are final then.
4. A task carries its k-th best score from shard to shard as the bound to reach and returns k rows
   a query; a window over tasks times k rows a query gives the ranks.

Queries are taken in blocks whose terms have at most ``BLOCK_BYTES``; each block is a pass over all
documents.  The number of scoring tasks is the session's parallelism times ``TASKS_PER_CORE``, so the
last window has a bounded number of rows a query whatever the size of the input.

Null and empty texts have no terms: such documents count for nothing and such queries have no rows.
Equal query rows (id and text) are one query.  Repeated documents are documents of their own; a
null document id comes after the others among equal scores.  An empty table on either side gives no rows.  Only id and text
columns are read, so others may have any name.  A very long text is counted by and by.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize

BLOCK_BYTES = 16 << 20
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 21
TASKS_PER_CORE = 4
#: Contributions are read down to 1/STEP of the last bound in each step.
STEP = 4
CUT_BYTES = 1 << 20
#: In lower-cased UTF-8 a term is a run of digits, letters and bytes of other characters.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: One part of an impact is under 2**IMPACT_BITS: (10^9 tf) div (1000 tf + 20 m) is at most 10^6.
IMPACT_BITS = 20


def count_terms(text: bytes | None) -> Counter:
    """Term -> occurrences in a UTF-8 text, A-Z as a-z."""
    if not text:
        return Counter()
    if len(text) <= CUT_BYTES:
        return Counter(TERM.findall(text.lower()))
    out: Counter = Counter()
    found = (m.group() for m in TERM.finditer(text.lower()))
    while some := list(islice(found, CUT_BYTES // 8)):
        out.update(some)
    return out


def _query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """(id, terms) of the distinct queries that have terms, in blocks of bounded size."""
    rows = queries.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        items = [(r["id"], sorted(count_terms(r["text"].encode()))) for r in part.collect()]
        yield [(i, t) for i, t in items if t]


def postings(docs: DataFrame, terms: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a term: ``id``, ``n`` (its terms), numbers and counts of the query terms in it."""
    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            out: list[list] = [[], [], [], []]
            for i, value in zip(ids, texts):
                counts = count_terms(value.as_py())
                if counts:
                    hit = counts.keys() & terms.keys()
                    for column, v in zip(out, (i, counts.total(), [terms[t] for t in hit], [counts[t] for t in hit])):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "n", "t", "tf"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(
        work, "id long, n long, t array<int>, tf array<int>")


class Shard:
    """Documents of a shard, and for each term their numbers by falling impact."""

    def __init__(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray,
                 total_docs: int, total_terms: int):
        self.ids, self.docs = ids, len(ids)
        m = 50 + (50 * n * total_docs) // total_terms
        owner = np.repeat(np.arange(self.docs), sizes)
        tf = tf.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])
        order = np.argsort((terms.astype(np.int64) << IMPACT_BITS) - impact, kind="stable")
        self.owner, self.impact = owner[order], impact[order]
        self.found, self.start = np.unique(terms[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        at = int(np.searchsorted(self.found, term))
        if at == len(self.found) or self.found[at] != term:
            return None
        a, b = self.start[at], self.end[at]
        return self.owner[a:b], self.impact[a:b]

    def best(self, query: list[tuple[int, int]], k: int, least: int = 0) -> list[tuple[int, int]]:
        """(score, document number) of the documents that can be among the ``k`` best of the query's
        (term, weight): all with at least the k-th score here, if not under ``least``.  Scores are final."""
        lists = [(*got, w) for term, w in query if w > 0 and (got := self.list_of(term)) is not None]
        if not lists:
            return []
        lower = np.zeros(self.docs, np.int64)
        met = np.zeros((len(lists), self.docs), bool)
        at = [0] * len(lists)
        heads = np.array([int(f[0]) * w for _, f, w in lists], np.int64)
        down_to, candidates = int(heads.max()), None
        while True:
            down_to //= STEP
            for i, (docs, impact, w) in enumerate(lists):
                if heads[i] > down_to:
                    # impacts fall: how many of the unread ones contribute more
                    more = int(np.searchsorted(-impact[at[i]:], -(down_to // w), side="left"))
                    read = slice(at[i], at[i] + more)
                    lower[docs[read]] += impact[read] * w
                    met[i, docs[read]] = True
                    at[i] += more
                    heads[i] = int(impact[at[i]]) * w if at[i] < len(docs) else 0
            rest = int(heads.sum())
            pool = lower if candidates is None else lower[candidates]
            if len(pool) > k:
                least = max(least, int(np.partition(pool, len(pool) - k)[len(pool) - k]))
            if candidates is None and rest and rest >= least:
                continue                        # a document not met yet may still come in
            keep = np.flatnonzero(lower) if candidates is None else candidates
            keep = keep[lower[keep] + rest >= least]
            unseen = heads @ ~met[:, keep]      # what may still come for each
            keep, unseen = keep[lower[keep] + unseen >= least], unseen[lower[keep] + unseen >= least]
            candidates = keep
            if not unseen.any():
                return list(zip(lower[keep].tolist(), keep.tolist()))


def _top(rows: list[tuple], k: int) -> list[tuple]:
    """The first ``k`` of (score, id): highest score first, then the smallest id, null last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]


def _scorer(queries: list[list[tuple[int, int]]], k: int, total_docs: int, total_terms: int):
    def run(batches):
        best: list[list[tuple]] = [[] for _ in queries]
        waiting: list[pa.RecordBatch] = []
        docs = count = 0

        def score():
            table = pa.Table.from_batches(waiting).combine_chunks()
            t, tf = (table.column(c).combine_chunks() for c in ("t", "tf"))
            shard = Shard(table.column("id").to_pylist(), table.column("n").to_numpy(),
                          t.value_lengths().to_numpy(zero_copy_only=False), t.flatten().to_numpy(zero_copy_only=False),
                          tf.flatten().to_numpy(zero_copy_only=False), total_docs, total_terms)
            for q, query in enumerate(queries):
                least = best[q][-1][0] if len(best[q]) == k else 1
                got = [(s, shard.ids[d]) for s, d in shard.best(query, k, least)]
                best[q] = _top(best[q] + got, k)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                waiting.append(part)
                docs, count = docs + part.num_rows, count + len(part.column(2).flatten())
                if docs >= SHARD_DOCS or count >= SHARD_POSTINGS:
                    score()
                    waiting, docs, count = [], 0, 0
        if waiting:
            score()
        for at in range(0, len(queries), 100):
            rows = [(q, i, s) for q in range(at, min(at + 100, len(queries))) for s, i in best[q]]
            q, i, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())],
                                             names=["q", "doc_id", "score"])

    return run


def weight(docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * with_term + 1)))


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
           query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every query: query_key, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = queries.schema[query_key].dataType.simpleString()
    parts = []
    for items in _query_blocks(queries, query_key, query_text):
        terms = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
        table = materialize(postings(docs, terms, key, text), "postings")
        total = table.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total[0]:
            continue
        # one row per query term: bounded by the block
        df = dict(tuple(r) for r in table.select(F.explode("t").alias("t")).groupBy("t").count().collect())
        weighed = [[(terms[t], weight(total[0], df[terms[t]])) for t in ts if terms[t] in df] for _, ts in items]
        tasks = spark.sparkContext.defaultParallelism * TASKS_PER_CORE
        found = table.coalesce(tasks).mapInArrow(_scorer(weighed, k, total[0], total[1]),
                                                 "q int, doc_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"q int, `{query_key}` {kind}")
        parts.append(ranked.join(F.broadcast(names), "q").select(query_key, "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"`{query_key}` {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same ranking over all documents for DuckDB.
SQL = r"""
WITH items AS (SELECT DISTINCT item_id, text FROM benchmark),
query_terms AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM items),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
lengths AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY r),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
counts AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM query_terms) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term),
scores AS (
  SELECT q.item_id, q.text, c.r, any_value(l.doc_id) AS doc_id,
    CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * l.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM query_terms q JOIN counts c ON c.term = q.term JOIN weights w ON w.term = c.term JOIN lengths l ON l.r = c.r, totals t
  GROUP BY q.item_id, q.text, c.r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
