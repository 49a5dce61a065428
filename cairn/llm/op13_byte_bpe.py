"""Byte-level BPE encoding and decoding by merge replay over the distinct words of the corpus (13).

A text is cut into words by the tokenizer's pattern; equal words have equal ids.  The corpus is
worked off in parts of bounded vocabulary: a part's distinct words stand one after another as
byte tokens, linked left and right, and an inverted index leads from each pair of tokens that the
ranks join to the places where the pair stands.  Pairs are taken in rank order; each is merged at
all its places in all words at once, and only the two neighbours of a merged place get new index
entries.  The ids of the words are then gathered for their occurrences.

Parts are cut where the bytes of new words reach ``PART_BYTES``, also inside one very long text; the
words of earlier parts of a task stay known, ``KNOWN_WORDS`` at most.  So memory depends neither on the
length of a text nor on the size of a partition.  Nothing is shuffled, and a lost executor costs the
parts it worked on.

Nulls are empty texts (no ids); an empty text has no ids and decodes to no bytes; repeated rows
and null ids are kept as they are; an empty table gives an empty table.  Of the input's columns only the key
and the text are read, so others may have any name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of new distinct words that share one index, and words whose ids a task keeps.
PART_BYTES, KNOWN_WORDS = 1 << 20, 300_000
#: Longer texts are cut into words by and by.
CUT_CHARS = 1 << 16
#: Word occurrences (4 bytes each) that wait for their part's ids at most.
PART_WORDS = 1 << 21
#: Ids (4 bytes each) or rows in a batch that leaves a task.
BATCH_IDS, BATCH_ROWS = 1 << 20, 1000


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id; ids are merge ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """The ranks as pairs of ids, and the replay of all merges over a list of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = max(ranks.values()) + 1
        self.bytes_to_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        base, pairs = self.base, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * base + b] = rank
        #: left id -> right id -> rank of the joined token
        self.joins: list[dict[int, int]] = [{} for _ in range(base)]
        for code, rank in pairs.items():
            self.joins[code // base][code % base] = rank
        self.codes = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.code_ranks = np.fromiter((pairs[c] for c in self.codes.tolist()), np.int64, len(pairs))

    def _index(self, ids: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """Rank of a pair -> its places, ascending; no pair crosses the end of a word."""
        if len(ids) < 2:
            return {}
        code = ids[:-1] * self.base + ids[1:]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[at] == code
        known[ends[:-1] - 1] = False
        places = np.flatnonzero(known)
        rank = self.code_ranks[at[places]]
        order = np.argsort(rank, kind="stable")
        found, first = np.unique(rank[order], return_index=True)
        groups = np.split(places[order], first[1:])
        return {r: g.tolist() for r, g in zip(found.tolist(), groups)} if len(found) else {}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all non-empty words one after another, ids in each word)."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = [self.ranks.get(w, -1) for w in words]      # a word that is a token is not merged
        whole_at = np.array(whole, np.int64)
        cut = [w for w, t in zip(words, whole) if t < 0]
        ids, counts = self._replay(cut) if cut else (np.empty(0, np.int64), np.empty(0, np.int64))
        n = np.ones(len(words), np.int64)
        n[whole_at < 0] = counts
        out = np.empty(int(n.sum()), np.uint32)
        owner = np.repeat(whole_at, n)
        out[owner >= 0] = owner[owner >= 0]
        out[owner < 0] = ids
        return out, n

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        start = self.bytes_to_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(start)
        right = np.arange(1, n + 1)
        right[ends - 1] = -1
        left = np.arange(-1, n - 1)
        left[ends - lengths] = -1
        index = self._index(start, ends)
        token, right, left = start.tolist(), right.tolist(), left.tolist()
        joins = self.joins
        queue = list(index)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            after_rank = joins[rank].get         # what the merged token makes with its right neighbour
            held, later = -1, []                 # a word that has a lower pair now, and its places
            for p in sorted(index.pop(rank)):    # overlapping places: the leftmost first
                a, q = token[p], right[p]
                if a < 0 or q < 0 or joins[a].get(token[q]) != rank:
                    continue
                if held >= 0:
                    if int(np.searchsorted(ends, p, side="right")) == held:
                        later.append(p)
                        continue
                    held = -1
                after, before = right[q], left[p]
                token[p], token[q], right[p] = rank, -1, after
                if after >= 0:
                    left[after] = p
                    new = after_rank(token[after])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(queue, new)
                        if new < rank:
                            held = int(np.searchsorted(ends, p, side="right"))
                if before >= 0:
                    new = joins[token[before]].get(rank)
                    if new is not None:
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heappush(queue, new)
                        if new < rank:
                            held = int(np.searchsorted(ends, p, side="right"))
            if later:
                index[rank] = later
                heappush(queue, rank)
        left_over = np.array(token, np.int64)
        alive = left_over >= 0
        return left_over[alive], np.add.reduceat(alive.astype(np.int64), ends - lengths)


class _Words(dict):
    """Word -> its number; a word that is asked for the first time gets the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.new_size = 0

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        self.new_size += len(word)
        return k


class _Part:
    """Rows that wait for ids: the words of their texts by number, and the words known so far."""

    def __init__(self, replay: MergeReplay, pattern):
        self.replay, self.pattern = replay, pattern
        self.keys: list = []
        self.pieces: list[list[bytes]] = []      # by row
        self.spans: list[tuple[int, int]] = []   # (row, its first word in this part)
        self.seen = array("i")
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        self.ids, self.first, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def full(self) -> bool:
        return self.words.new_size >= PART_BYTES or len(self.seen) >= PART_WORDS

    def _cut(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CUT_CHARS:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, CUT_CHARS // 8)):
            yield some

    def add(self, key, text: str) -> None:
        row = len(self.keys)
        self.keys.append(key)
        self.pieces.append([])
        self.spans.append((row, len(self.seen)))
        for words in self._cut(text):
            if self.full():
                self.encode()
                self.spans.append((row, 0))
            self.seen.extend(map(self.words.__getitem__, words))

    def encode(self) -> None:
        """Replay the merges over the new words, hand the ids to the rows, start a new part."""
        ids, n = self.replay.encode([w.encode() for w in self.words.new])
        self.first = np.concatenate((self.first, np.cumsum(n) - n + len(self.ids)))
        self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, n))
        seen = np.frombuffer(self.seen, np.int32) if self.seen else np.empty(0, np.int32)
        counts = self.counts[seen]
        borders = np.concatenate(([0], np.cumsum(counts)))
        place = np.arange(borders[-1]) + np.repeat(self.first[seen] - borders[:-1], counts)
        out = self.ids[place].astype("<u4")
        ends = [start for _, start in self.spans[1:]] + [len(seen)]
        for (row, start), end in zip(self.spans, ends):
            self.pieces[row].append(out[borders[start]:borders[end]].tobytes())
        self.spans, self.seen = [], array("i")
        self.words.new, self.words.new_size = [], 0
        if len(self.words) > KNOWN_WORDS:
            self._forget()

    def take(self) -> Iterator[tuple[list, list[bytes]]]:
        """The rows whose texts have ended, with their ids, in portions."""
        self.encode()
        at = size = 0
        for i in range(len(self.keys)):
            size += sum(map(len, self.pieces[i]))
            if i + 1 == len(self.keys) or size >= 4 * BATCH_IDS or i + 1 - at >= BATCH_ROWS:
                yield self.keys[at:i + 1], [b"".join(p) for p in self.pieces[at:i + 1]]
                at, size = i + 1, 0
        self.keys, self.pieces = [], []


def _encoder(path: str, pattern: str):
    def run(batches):
        import regex
        part = _Part(MergeReplay(read_ranks(path)), regex.compile(pattern))

        def out(schema):
            for keys, rows in part.take():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, schema.field(0).type), pa.array([len(r) // 4 for r in rows], pa.int64()),
                     pa.array(rows, pa.binary())], names=[schema.names[0], "n_tokens", "ids"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                part.add(key, text.as_py() or "")
                if part.full() or len(part.keys) >= 20 * BATCH_ROWS:
                    yield from out(schema)
        if part.keys:
            yield from out(schema)

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
    slim = docs.select(key, text)
    fields = [T.StructField(key, slim.schema[0].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids", T.BinaryType())]
    return slim.mapInArrow(_encoder(path or default_path(), pattern or default_pattern()), T.StructType(fields))


def decode(ids: str | Column, path: str | None = None) -> Column:
    """The bytes that a binary column of ids stands for; null stays null."""
    place = path or default_path()
    table: list[pa.Array] = []

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        if not table:
            ranks = read_ranks(place)
            by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                by_id[rank] = token
            table.append(pa.array(by_id, pa.binary()))
        # one document at a time: 4 bytes become at most the longest token
        return pa.array([None if v is None else _bytes_of(table[0], v) for v in column.to_pylist()], pa.binary())

    return run(F.col(ids) if isinstance(ids, str) else ids)


def _bytes_of(table: pa.Array, ids: bytes) -> bytes:
    got = table.take(pa.array(np.frombuffer(ids, "<u4")))
    if got.null_count:
        raise ValueError("an id is not in the vocabulary")
    _, offsets, data = got.buffers()
    if not len(got):
        return b""
    at = np.frombuffer(offsets, np.int32, len(got) + 1, got.offset * 4)
    return data[int(at[0]):int(at[-1])].to_pybytes()


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode ``docs`` and decode the ids: doc_id, n_tokens, and the SHA-256 of ids and decoded bytes."""
    got = encode(docs, path=path)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(decode("ids", path), 256).alias("decoded_sha256"))
