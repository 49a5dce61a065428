"""Bound-certified best-fit packing of token sequences.

Every document's ids (with an end id) are cut only where they exceed a sequence; the pieces are
dealt into partitions and each partition is packed best-fit decreasing.  Dual-feasible functions
give a lower bound on the sequences any packing of that partition needs.  A partition that meets
its bound is final.  The others give their loosely filled sequences away: these are dealt anew, by a
hash that differs each round, into as many pools as their rows need (a pool has about as many rows as
a partition, however many sequences are loose) and packed again; a pool keeps its old sequences if
the new packing is not smaller.  Rounds go on while they save sequences.

Edge cases: a null or empty text is a document of its end id alone; repeated rows are packed each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize
from cairn.llm.tokens import WordTokenizer, default_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, "
          "offset long, loose boolean, partition_bins long, partition_bound long")
#: A sequence is given away when at least this share of it is free.
LOOSE = 0.01


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: PIECES.  ``salt`` tells repeated rows apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, step, n = WordTokenizer.of(tokenizer_path), end_id.to_bytes(4, "little"), 4 * capacity, 0
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[tuple] = []
            names = b.column(0).to_pylist()
            for low, high, ids, places in tok.batch(b.column(1)):
                for doc, x, y in zip(names[low:high], places, places[1:]):
                    n += 1
                    own = ids[x:y] + end
                    for i, at in enumerate(range(0, len(own), step)):
                        part = own[at:at + step]
                        out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), first + n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)]
                                             if out else [pa.array([], t.type) for t in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place of each item, and the number of bins."""
    bins, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_sizes, n = 0, 0  # free_sizes: bit f is set when a bin with f free places exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = free_sizes >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = open_by_free[f].pop()
            if not open_by_free[f]:
                free_sizes ^= 1 << f
        else:
            f, b, n = capacity, n, n + 1
        bins[i], at[i] = b, capacity - f
        if f > s:
            open_by_free[f - s].append(b)
            free_sizes |= 1 << (f - s)
    return bins, at, n


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    For a threshold t, sizes over capacity - t count as a whole bin and sizes under t as nothing.
    For a number k, a size counts as the whole (k+1)-ths of a bin it exceeds, in k-ths of a bin,
    and as itself where it is a whole number of (k+1)-ths.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[:capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    upto, weight = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(0, capacity // 2 + 1)
    below = np.where(t > 0, weight[np.maximum(t - 1, 0)], 0)
    whole = upto[capacity] - upto[capacity - t]
    best = int((-(-(whole * capacity + weight[capacity - t] - below) // capacity)).max())
    for k in range(1, 65):
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, int(-(-int((value * count).sum()) // (k * capacity))))
    return best


def _packer(capacity: int, round_: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "salt"], ascending=False, kind="stable")
        sizes = rows["length"].to_numpy(np.int64)
        bins, at, n = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        base = (round_ << 56) + (int(key[0]) << 28)
        was = rows["sequence_id"].to_numpy(np.int64)
        if round_ and n >= len(np.unique(was)):
            ids, place, n = was, rows["offset"].to_numpy(np.int64), len(np.unique(was))
            _, bins = np.unique(was, return_inverse=True)
        else:
            ids, place = base + bins, at
        fill = np.bincount(bins, sizes, minlength=n)
        loose = (n > bound) & (capacity - fill[bins] >= LOOSE * capacity)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "salt"]].assign(
            sequence_id=ids, offset=place, loose=loose, partition_bins=n, partition_bound=bound)
    return pack


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_partition: int = 50_000, rounds: int = 8) -> DataFrame:
    """Place every piece: PACKED rows, each with its last partition's bins and lower bound."""
    pieces = materialize(pieces, "pieces")
    n = pieces.count()
    parts = max(1, -(-n // rows_per_partition))
    todo = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(parts))) \
        .withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    done: list[DataFrame] = []
    given = None
    for r in range(rounds + 1):
        got = materialize(todo.groupBy("__part").applyInPandas(_packer(capacity, r), PACKED), f"packed-{r}")
        loose = F.col("loose")
        made, used, content, rows = got.groupBy("sequence_id").agg(
            F.first("loose").alias("loose"), F.sum("length").alias("__length"), F.count(F.lit(1)).alias("__rows")).agg(
            F.count(F.lit(1)), F.count(F.when(loose, 1)), F.sum(F.when(loose, F.col("__length"))),
            F.sum(F.when(loose, F.col("__rows")))).first()
        spare = used - -(-(content or 0) // capacity)
        if r == rounds or spare <= 0 or (given is not None and made >= given):
            done.append(got)
            break
        given = used
        done.append(got.filter("not loose"))
        parts = max(1, -(-rows // rows_per_partition))
        todo = got.filter("loose").withColumn("__part", F.pmod(F.xxhash64("sequence_id", F.lit(r + 1)), F.lit(parts)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048,
                   end_id: int = 0) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path or default_path(), capacity, end_id), capacity)
