"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes cuts a text (UTF-8) wherever its value plus one is a
multiple of the block size, 3 * 2**k, so that cuts depend on local content alone.  Each chunk gives
one of 64 characters; a fingerprint is ``block size : signature : signature at twice the size``.
The block size is the smallest with about 64 chunks, halved until the signature has 32 characters.
A signature's 64th character stands for all of the rest of the text, so the whole text counts.

Two fingerprints are compared at equal block sizes: 1 - distance / total length, where the distance
counts insertions and deletions, provided that they share a run of seven characters (of all, where
the shorter has fewer); else, and where no block sizes are equal, the likeness is 0.

Edge cases: a null text is an empty one; the fingerprint of an empty text is ``3::`` and its likeness
to another such is 1; documents of one id follow each other by text (an id that fills several ranges: by a
hash of the text first); null ids come last; with one document its own text is the next; a very long text is
hashed whole, in memory in proportion to it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import in_range_order, partitions_for, range_buckets

WINDOW = 7
LENGTH = 64
LEAST = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHARS = np.frombuffer(ALPHABET.encode(), np.uint8)
_ROLL = np.uint32(0x01000193)  # odd multiplier of the window hash
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the chunk hash
_BUFFER = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up, down = np.full(n, _STEP, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS = _powers(1)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of many texts; the rolling and chunk hashes run over all of them at once."""
    global _POWERS
    out: list[str] = []
    at = 0
    while at < len(texts):
        size, end = WINDOW, at
        while end < len(texts) and (end == at or size < _BUFFER):
            size += len(texts[end]) + WINDOW
            end += 1
        if size > len(_POWERS[0]):
            _POWERS = _powers(size)
        out += _some(texts[at:end])
        at = end
    return out


def _some(texts: list[bytes]) -> list[str]:
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    wide = data.astype(np.uint32) + np.uint32(1)
    roll = wide.copy()
    for k in range(1, WINDOW):  # a text's first bytes see the zeros of the gap before it
        roll *= _ROLL
        roll[k:] += wide[:-k]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    roll ^= roll >> np.uint32(13)
    cut = np.flatnonzero(roll % np.uint32(3) == 2)
    third = (roll[cut].astype(np.int64) + 1) // 3
    level = np.bitwise_count((third & -third) - 1).astype(np.int64)  # how often 2 divides it
    up, down = _POWERS
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    ends = np.cumsum([len(t) + WINDOW for t in texts])
    starts = ends - np.array([len(t) for t in texts], dtype=np.int64)
    low, high = np.searchsorted(cut, starts), np.searchsorted(cut, ends)
    found: list[tuple[int, np.ndarray, int]] = []
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist()):
        where, lev = cut[a:b], level[a:b]
        k = max(0, int(np.ceil(np.log2(max(1, e - s) / (LEAST * LENGTH))))) if e - s > LEAST * LENGTH else 0
        while k and np.count_nonzero(lev >= k) < LENGTH // 2:
            k -= 1
        for j in (k, k + 1):
            stops = where[lev >= j][:LENGTH] + 1
            if len(stops) >= LENGTH:
                stops = np.append(stops[:LENGTH - 1], e)
            elif e > s and (not len(stops) or stops[-1] < e):
                stops = np.append(stops, e)
            found.append((s, stops, k))
    lengths = [len(x[1]) for x in found]
    stops = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.int64)
    begins = np.empty_like(stops)
    begins[1:] = stops[:-1]
    heads = np.cumsum(lengths) - lengths
    for h, (s, x, _) in zip(heads, found):
        if len(x):
            begins[h] = s
    h = (sums[stops] - sums[begins]) * down[begins]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    sign = _CHARS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    cuts = [sign[a:a + n] for a, n in zip(heads.tolist(), lengths)]
    return [f"{LEAST << found[i][2]}:{cuts[i]}:{cuts[i + 1]}" for i in range(0, len(found), 2)]


def _common(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures (64 characters at most),
    with one bit per place of the first: set bits of the row that are not yet used up count."""
    n = len(pairs)
    a = np.zeros((n, LENGTH), np.uint8)
    b = np.zeros((n, LENGTH), np.uint8)
    for i, (x, y) in enumerate(pairs):
        a[i, :len(x)] = np.frombuffer(x.encode(), np.uint8)
        b[i, :len(y)] = np.frombuffer(y.encode(), np.uint8)
    rows = np.full(n, ~np.uint64(0), np.uint64)
    for j in range(LENGTH):
        hit = np.packbits((a == b[:, j:j + 1]) & (a != 0), axis=1, bitorder="little").view("<u8")[:, 0]
        use = rows & hit
        rows = (rows + use) | (rows - use)
    return np.bitwise_count(~rows).astype(np.int64)


def _run(x: str, y: str) -> bool:
    n = min(WINDOW, len(x), len(y))
    have = {x[i:i + n] for i in range(len(x) - n + 1)}
    return any(y[i:i + n] in have for i in range(len(y) - n + 1))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of fingerprints, pair by pair."""
    out = np.zeros(len(left))
    at: list[int] = []
    pairs: list[tuple[str, str]] = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1.0
            continue
        n, x1, x2 = x.split(":")
        m, y1, y2 = y.split(":")
        n, m = int(n), int(m)
        if n == m:
            both = [(x1, y1), (x2, y2)]
        elif n == 2 * m:
            both = [(x1, y2)]
        elif m == 2 * n:
            both = [(x2, y1)]
        else:
            both = []
        for p in both:
            if p[0] and p[1] and _run(*p):
                at.append(i)
                pairs.append(p)
    if pairs:
        total = np.array([len(x) + len(y) for x, y in pairs])
        np.maximum.at(out, np.array(at), 2 * _common(pairs) / total)
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, fingerprint) of whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(fingerprints([t.encode() for t in texts]), pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, n_chars long, fingerprint string")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, docs_per_range: int = 2_500) -> DataFrame:
    """Each document beside its edited text (its second half replaced by the start of the next
    document in descending id order, the first after the last) and beside that next document.

    Ranges of ids, 8,192 at most, are sorted and read in order; the first document of each range is also sent
    to the end of the range before it, so the text moves once.
    """
    spark = docs.sparkSession
    lowest = -(2 ** 63)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("__key"),
                       F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    tasks = partitions_for(spark, n, 4 * docs_per_range)
    placed, ranges = range_buckets(base, "__key", -(-n // docs_per_range), tie="text")
    # the largest id of each range that has rows, and the range that comes before it in falling order
    tops = range_buckets_tops(placed)
    # one guest a range: of the rows with its largest id the first by text
    firsts = (placed.join(F.broadcast(tops), [placed["__bucket"] == tops["__of"], placed["__key"] == tops["__top"]])
              .groupBy(F.col("__to").alias("__bucket")).agg(F.max("__key").alias("__key"), F.max("doc_id").alias("doc_id"),
                                                           F.min("text").alias("text")))
    rows = (placed.select("__bucket", "__key", "doc_id", "text", F.lit(False).alias("__guest"))
            .unionByName(firsts.withColumn("__guest", F.lit(True))))
    ordered = (in_range_order(rows, ranges, min(tasks, ranges), "__guest", F.col("__key").desc(), "text")
               .select("__bucket", "__guest", "doc_id", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row has not come yet, and the last that has
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                held.append(row)
                size += len(row[3])
                if size > _BUFFER and len(held) > 1:
                    yield _beside(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield _beside(held)

    return ordered.mapInArrow(work, RESULT_DDL)


def range_buckets_tops(placed: DataFrame) -> DataFrame:
    """One row per range with rows: the range, its largest key, and the range whose last document
    it follows (the next higher one; the lowest for the highest)."""
    w = Window.orderBy("__of")
    tops = placed.groupBy(F.col("__bucket").alias("__of")).agg(F.max("__key").alias("__top"))
    lowest = F.min("__of").over(Window.partitionBy())
    return tops.select("__of", "__top", F.coalesce(F.lead("__of").over(w), lowest).alias("__to"))


def _beside(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but the last that are not guests; each row's next is the one after it."""
    own: list[tuple[int, str, str]] = []
    for i in range(len(rows) - 1):
        bucket, guest, doc, text = rows[i]
        if not guest and rows[i + 1][0] == bucket:
            half = len(text) // 2
            own.append((i, text[:len(text) - half] + rows[i + 1][3][:half], doc))
    prints = fingerprints([r[3].encode() for r in rows])
    edited = [x[1].encode() for x in own]
    edited_prints = fingerprints(edited)
    mine, after = [prints[x[0]] for x in own], [prints[x[0] + 1] for x in own]
    cols = [[x[2] for x in own], [len(rows[x[0]][3]) for x in own], [hashlib.sha256(e).hexdigest() for e in edited],
            mine, edited_prints, likeness(mine, edited_prints), likeness(mine, after)]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, RESULT)], schema=RESULT)
