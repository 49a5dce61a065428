"""Byte-level BPE (13) against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from cairn.llm import op13_byte_bpe as op


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("library", pat_str=op.default_pattern(), mergeable_ranks=op.read_ranks(op.default_path()),
                             special_tokens={})


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_rows_equal_the_librarys(spark, documents, odd_rows, library):
    docs = documents(odd_rows)
    for clash in ("ids", "n_tokens", "decoded"):
        docs = docs.withColumn(clash, F.lit(1))
    got = sorted(tuple(r) for r in op.digests(docs).fillna(-1).collect())
    want = []
    for i, text in odd_rows:
        ids = library.encode_ordinary(text or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert op.digests(documents([(1, "x")]).limit(0)).collect() == []


def test_parts_cut_inside_texts_change_nothing(spark, documents, library, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("abe  thnigo'sñ9.\n") for _ in range(r.choice([0, 3, 50, 4000]))) for _ in range(60)]
    replay = op.MergeReplay(op.read_ranks(op.default_path()))
    for limits in ((40, 1 << 21), (1 << 20, 7), (1000, 300)):
        monkeypatch.setattr(op, "PART_BYTES", limits[0])
        monkeypatch.setattr(op, "PART_WORDS", limits[1])
        monkeypatch.setattr(op, "CUT_CHARS", 64)
        monkeypatch.setattr(op, "KNOWN_WORDS", limits[1] * 3 // 2)
        part, got = op._Part(replay, regex.compile(op.default_pattern())), {}
        for i, text in enumerate(texts):
            part.add(i, text)
            if part.full():
                got.update(kv for keys, rows in part.take() for kv in zip(keys, rows))
        got.update(kv for keys, rows in part.take() for kv in zip(keys, rows))
        assert [got[i] for i in range(60)] == [as_bytes(library.encode_ordinary(t)) for t in texts]


def test_words_of_any_bytes(library):
    r, replay = random.Random(1), op.MergeReplay(op.read_ranks(op.default_path()))
    for _ in range(40):
        words = [bytes(r.choice(b"ab eth ingsoABC\xc3\xa9\xff0 1") for _ in range(r.choice([1, 2, 3, 5, 9, 30, 300])))
                 for _ in range(50)]
        ids, n = replay.encode(words)
        ends = np.cumsum(n)
        assert [ids[a:b].tolist() for a, b in zip(ends - n, ends)] == [library._encode_single_piece(w) for w in words]


def plain(ranks, word):
    """The definition: the lowest pair, the leftmost first, until none is left."""
    parts = [bytes([b]) for b in word]
    if word in ranks:
        return [ranks[word]]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_ranks_that_fall_while_merging():
    """A merge may make a pair of lower rank; that word takes it before its other places."""
    r = random.Random(9)
    for seed in range(60):
        tokens = [bytes([b]) for b in range(256)]
        more = set()
        while len(more) < 40:
            more.add(bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))))
        tail = sorted(more)
        r.shuffle(tail)               # ranks in no order of length
        ranks = {t: i for i, t in enumerate(tokens + tail)}
        replay = op.MergeReplay(ranks)
        words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 25))) for _ in range(40)]
        ids, n = replay.encode(words)
        ends = np.cumsum(n)
        assert [ids[a:b].tolist() for a, b in zip(ends - n, ends)] == [plain(ranks, w) for w in words]


def test_decode_rejects_unknown_ids(spark):
    df = spark.createDataFrame([(as_bytes([50_000, 0]),), (None,), (b"",)], "ids binary")
    got = [r[0] for r in df.select(op.decode("ids")).collect()]
    assert got[1] is None and bytes(got[2]) == b"" and len(got[0]) > 1
    with pytest.raises(Exception):
        spark.createDataFrame([(as_bytes([4_000_000_000]),)], "ids binary").select(op.decode("ids")).collect()
