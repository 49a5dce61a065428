"""Token counts (3), packing (5) and Simple-8b files (9) against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import op3_token_counts, op5_packing, op9_binary
from cairn.llm.common import scratch
from cairn.llm.tokens import WordTokenizer, default_path


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_words_give_the_tokenizers_ids(encode):
    r, tok = random.Random(5), WordTokenizer(default_path(), most=50)
    letters = "aB é.'%,-_1 \n\t\xa0ßÉ<|>“ºİ\x1c日s t"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += [None, "", "don't we'll I'm.'s <|endoftext|> x<|startoftext|>y -'s a-'s 'S", "y" * 500]
    got = [ids[a:b] for _, _, ids, at in tok.batch(pa.array(texts)) for a, b in zip(at, at[1:])]
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == encode(t) == np.frombuffer(tok.ids(t), "<u4").tolist()


def test_edits_keep_the_full_count(encode):
    r, tok = random.Random(3), WordTokenizer(default_path())
    for _ in range(60):
        s = "".join(r.choice("ab é'\n xyZ%1") for _ in range(r.randint(0, 2000)))
        parts = op3_token_counts.segments(s, 50)
        tree = op3_token_counts.CountedText(parts, [tok.count(p) for p in parts])
        for _ in range(6):
            a = r.randint(0, len(s))
            b = min(len(s), a + r.choice([0, 1, 5, 200, 1000]))
            new = "".join(r.choice("ab c\n'z") for _ in range(r.choice([0, 1, 3, 400])))
            tree.edit(a, b, new, tok)
            s = s[:a] + new + s[b:]
            assert "".join(tree.parts) == s and tree.tokens[1] == len(encode(s))


def test_edit_tables_and_kept_segments(spark, documents, odd_rows, encode):
    docs = documents([x for x in odd_rows if x[0] != 2])
    edits = spark.createDataFrame([(1, 1, 4, 7, "dog"), (1, 0, 0, 0, "Well, "), (6, 0, 100, 90_000, None),
                                   (4, 0, 5, 2, "new text"), (3, 0, None, None, "was null"), (77, 0, 0, 1, "z")],
                                  "doc_id long, seq int, start long, end long, replacement string")
    joined = op3_token_counts.attach_edits(docs, edits)
    state = op3_token_counts.build(docs)
    again = op3_token_counts.attach_edits(state.select("doc_id", "text", "segment_chars", "segment_tokens"), edits)
    for df, state in ((joined, False), (again, True)):
        got = {r.doc_id: r for r in op3_token_counts.apply_edits(df, keep=True, state=state).collect()}
        assert len(got) == docs.count()
        text = {i: t or "" for i, t in odd_rows}
        want = dict(text)
        want[1] = "Well, " + text[1]
        want[1] = want[1][:4] + "dog" + want[1][7:]
        want[6] = text[6][:100] + text[6][90_000:]
        want[4], want[3] = "new text", "was null"
        for i, r in got.items():
            assert r.text == want[i] and r.n_tokens == len(encode(text[i])) and r.edited_tokens == len(encode(want[i]))
            assert sum(r.segment_tokens) == r.edited_tokens and sum(r.segment_chars) == len(want[i]) == r.edited_chars
        assert got[6].recounted_chars < 2000


def test_packing(spark, documents, odd_rows, encode):
    got = op5_packing.pack_documents(documents(odd_rows), capacity=128).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in odd_rows:
        ids = np.array(encode(t) + [0], "<u4")
        copies = sum(j == i for j, _ in odd_rows)
        want = sorted([(p, p * 128, len(x), zlib.crc32(x.tobytes())) for p, x in
                       enumerate(np.split(ids, range(128, len(ids), 128)))] * copies)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == want
    check_packing(got, 128)
    assert op5_packing.pack_documents(documents([])).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    bound = op5_packing.lower_bound(np.array([r.length for r in rows]), capacity)
    assert bound <= len(bins)
    return len(bins), bound


def test_exchange_between_partitions(spark):
    r = random.Random(2)
    rows = [(i, 0, 0, r.choice([90, 60, 55, 41, 40, 39, 33, 21, 7]), 0, i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, op5_packing.PIECES)
    many = op5_packing.pack(pieces, capacity=100, rows_per_partition=50, rounds=0).collect()
    got = op5_packing.pack(pieces, capacity=100, rows_per_partition=50).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000))
    assert check_packing(got, 100)[0] <= check_packing(many, 100)[0]


def test_loose_sequences_never_meet_in_one_group(spark):
    r = random.Random(6)
    rows = [(i, 0, 0, r.randint(300, 499), 0, i) for i in range(6000)]
    pieces = spark.createDataFrame(rows, op5_packing.PIECES)
    alone = op5_packing.pack(pieces, capacity=2048, rows_per_partition=200, rounds=0).collect()
    got = op5_packing.pack(pieces, capacity=2048, rows_per_partition=200).collect()
    assert sorted(x.doc_id for x in got) == list(range(6000))
    assert check_packing(got, 2048)[0] <= check_packing(alone, 2048)[0]
    assert max(x.partition_bins for x in got) < 100  # about four pieces in a sequence


def test_lower_bound_never_exceeds_a_packing():
    r = np.random.default_rng(0)
    for _ in range(200):
        sizes = r.integers(1, 31, r.integers(0, 30))
        _, _, n = op5_packing.best_fit_decreasing(sizes, 30)
        assert op5_packing.lower_bound(sizes, 30) <= n
    assert op5_packing.lower_bound(np.array([16, 16, 16]), 30) == 3
    assert op5_packing.lower_bound(np.array([11, 11, 11, 11, 11]), 30) == 3


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 70_000):
        for high in (1, 2, 300, 49408, 2 ** 40):
            ids = r.integers(0, high, n).astype(np.uint64)
            if n > 5:
                ids[3], ids[0] = 2 ** 63 + 5, 2 ** 60
            words, escapes, offsets = op9_binary.encode(ids)
            assert (op9_binary.decode(words, escapes) == ids).all()
            if n > 500:
                assert (op9_binary.decode_from(words, escapes, offsets, 100, 333) == ids[100:433]).all()


def test_files(spark, documents, odd_rows, encode):
    path = scratch(spark, "test-ids")
    op9_binary.write(documents(odd_rows), path, docs_per_range=7)
    got = op9_binary.read_back(spark, path).collect()
    order = sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at, want = 0, []
    for i, t in order:
        ids = np.array(encode(t) + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda x: x[1]) == want
    assert op9_binary.round_trip(documents([])).count() == 0
