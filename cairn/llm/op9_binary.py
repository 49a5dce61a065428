"""Token ids in Simple-8b word-aligned files.

A 64-bit word has a 4-bit selector and 60 bits of payload; the selector says how many ids of which
width share the payload.  Id values of 60 bits and more are escapes: their word holds a place in a
list of raw values beside it.  Encoding takes the largest count that fits at each place.  Decoding
works on all words of one selector at a time.

File format: Parquet rows, one per block of whole documents; blocks, and the files by name, are in ascending
id order.  A block has its range number, its place in the range, the ids before it in the range, the documents' ids and
lengths, the words, the escapes, and the id offset of every ``STRIDE``-th word, from which decoding
can start.  Ranges are of the document id, 8,192 at most, so (range, place) is the order of the whole corpus.

Edge cases: a null or empty text is a document of its end id alone; rows with a null id come first;
repeated ids follow each other by text (an id that fills several ranges: by a hash of the text first); a very
long text is one block; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import in_range_order, partitions_for, range_buckets, scratch
from cairn.llm.tokens import WordTokenizer, default_path

#: Ids in one word by selector; selector 0 is the escape.  Widths are the whole bits of 60 / count.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, *(60 // COUNTS[2:])])
PAYLOAD = np.uint64((1 << 60) - 1)
#: Words between two stored id offsets.
STRIDE = 1024
#: A block is closed when it has this many ids.
BLOCK_IDS = 1 << 16

BLOCK = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()),
                   ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                   ("words", pa.binary()), ("escapes", pa.binary()), ("offsets", pa.binary())])
BLOCK_DDL = ("range int, block int, ids_before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
             "words binary, escapes binary, offsets binary")


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and the id offset of every STRIDE-th word."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    wide = ids > PAYLOAD
    escapes = ids[wide]
    selector = np.full(n, 15, np.int64)
    at = np.arange(n)
    for s in range(14, 0, -1):  # a count that fits nowhere leaves no place for the next, larger one
        c, over = int(COUNTS[s]), np.zeros(n + 1, np.int64)
        np.cumsum(ids >> np.uint64(WIDTHS[s]) != 0, out=over[1:])
        at = at[at + c <= n]
        at = at[over[at + c] == over[at]]
        if not len(at):
            break
        selector[at] = s
    selector[wide] = 0
    count = COUNTS[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += count[i]
    first = np.asarray(starts, dtype=np.int64)
    chosen = selector[first]
    words = np.zeros(len(first), np.uint64)
    place_of_escape = np.cumsum(wide) - 1
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            body = place_of_escape[first[mine]].astype(np.uint64)
        else:
            c, w = int(COUNTS[s]), int(WIDTHS[s])
            body = np.zeros(len(mine), np.uint64)
            for j in range(c if w else 0):
                body |= ids[first[mine] + j] << np.uint64(j * w)
        words[mine] = body | np.uint64(s << 60)
    return words, escapes, first[::STRIDE]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of the words, a selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        body, c, w = words[mine] & PAYLOAD, int(COUNTS[s]), int(WIDTHS[s])
        first = ends[mine] - c
        if s == 0:
            ids[first] = escapes[body.astype(np.int64)]
        elif w:
            mask = np.uint64((1 << w) - 1)
            for j in range(c):
                ids[first + j] = (body >> np.uint64(j * w)) & mask
    return ids


def decode_from(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n - 1 of a block, decoding only the strides that hold them."""
    a = int(np.searchsorted(offsets, start, side="right")) - 1
    b = int(np.searchsorted(offsets, start + n, side="left"))
    got = decode(words[a * STRIDE:b * STRIDE], escapes)
    return got[start - int(offsets[a]):start - int(offsets[a]) + n]


def _block(range_: int, block: int, before: int, docs: list, ids: list[bytes]) -> list:
    words, escapes, offsets = encode(np.frombuffer(b"".join(ids), "<u4"))
    lengths = [len(x) // 4 for x in ids]
    return [range_, block, before, sum(lengths), docs, lengths, words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(), offsets.astype("<i8").tobytes()]


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), BLOCK)], schema=BLOCK)


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2,
          docs_per_range: int = 5_000) -> None:
    """Encode every document and write the blocks to ``path``, in ascending ``doc_id`` order."""
    spark, file = docs.sparkSession, tokenizer_path or default_path()
    n = docs.count()
    tasks = partitions_for(spark, n, 2 * docs_per_range)
    placed, ranges = range_buckets(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", -(-n // docs_per_range),
                                   tie="text")
    ordered = in_range_order(placed, ranges, min(tasks, ranges), "doc_id", "text").select("__bucket", "doc_id", "text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = WordTokenizer.of(file), end_id.to_bytes(4, "little")
        now, block, before, size, ids, names = None, 0, 0, 0, [], []
        for b in batches:
            ranges, docs_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            for low, high, got, places in tok.batch(b.column(2)):
                for range_, doc, x, y in zip(ranges[low:high], docs_[low:high], places, places[1:]):
                    if ids and (range_ != now or size >= BLOCK_IDS):
                        yield _rows([_block(now, block, before, names, ids)])
                        block, before, size, ids, names = block + 1, before + size, 0, [], []
                    if range_ != now:
                        now, block, before = range_, 0, 0
                    ids.append(got[x:y] + end)
                    names.append(doc)
                    size += len(ids[-1]) // 4
        if ids:
            yield _rows([_block(now, block, before, names, ids)])

    ordered.mapInArrow(code, BLOCK_DDL).write.parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) decoded from the files at ``path``."""
    blocks = spark.read.parquet(path)
    sums = blocks.groupBy("range").agg(F.sum("n_ids").alias("__ids"))
    # one row per range, MAX_RANGES at most
    ranges = sums.select("range", (F.sum("__ids").over(Window.orderBy("range")) - F.col("__ids")).alias("__first"))
    schema = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                range_, before, docs, lengths, words, escapes = (b.column(c)[i].as_py() for c in range(6))
                ids = decode(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8")).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                sums = [zlib.crc32(ids[4 * x:4 * y]) for x, y in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([range_] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                                                  pa.array(begins + before, pa.int64()), pa.array(lengths, pa.int64()),
                                                  pa.array(sums, pa.int64())], schema=schema)

    decoded = blocks.select("range", "ids_before", "doc_ids", "lengths", "words", "escapes").mapInArrow(
        expand, "range int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return decoded.join(ranges, "range").select("doc_id", (F.col("__first") + F.col("place")).alias("start"),
                                                "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    path = scratch(docs.sparkSession, "ids")
    write(docs, path, tokenizer_path, end_id)
    return read_back(docs.sparkSession, path)
