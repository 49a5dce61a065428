"""Operators beside plain second versions, written from their definitions."""

import heapq
import itertools
import random

from cairn.llm import op4_sharding, op6_fingerprints

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def triggers(data):
    """The mixed hash of the last seven bytes at every byte."""
    window = [1] * 7
    for byte in data:
        window = window[1:] + [byte + 1]
        h = sum(w * 0x01000193 ** m for m, w in enumerate(window)) % 2 ** 32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2 ** 32
        yield h ^ (h >> 13)


def signature(data, block):
    def letter(h):
        h ^= h >> 29
        return ALPHABET[h * 0xBF58476D1CE4E5B9 % 2 ** 64 >> 58]

    out, h, power, left = "", 0, 1, False
    for byte, t in zip(data, triggers(data)):
        h, power, left = (h + (byte + 1) * power) % 2 ** 64, power * 0x9E3779B97F4A7C15 % 2 ** 64, True
        if (t + 1) % block == 0 and len(out) < 63:
            out, h, power, left = out + letter(h), 0, 1, False
    return out + letter(h) if left else out


def plain_fingerprint(data):
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum((t + 1) % block == 0 for t in triggers(data)) < 32:
        block //= 2
    return f"{block}:{signature(data, block)}:{signature(data, 2 * block)}"


def plain_likeness(left, right):
    if left == right:
        return 1.0
    (n, *a), (m, *b) = left.split(":"), right.split(":")
    mine, theirs = {int(n): a[0], 2 * int(n): a[1]}, {int(m): b[0], 2 * int(m): b[1]}
    best = 0.0
    for block in mine.keys() & theirs.keys():
        x, y = mine[block], theirs[block]
        run = min(7, len(x), len(y))
        if not run or not {x[i:i + run] for i in range(len(x) - run + 1)} & {y[i:i + run] for i in range(len(y) - run + 1)}:
            continue
        row = list(range(len(y) + 1))       # insertions and deletions from x's start to each start of y
        for i, c in enumerate(x, 1):
            before, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(before[j - 1] if c == d else 1 + min(before[j], row[-1]))
        best = max(best, 1 - row[-1] / (len(x) + len(y)))
    return best


def samples():
    r = random.Random(8)
    words = ["river", "stone", "Ünïcode", "日本", "a", "to", "of", "the", "light", "12.5%", "😀"]
    out = [b"", b"x", b"abc", b"seven b", b"a" * 5000, bytes(3000)]
    for n in (3, 20, 33, 64, 200, 900, 4000):
        out.append(" ".join(r.choice(words) + str(r.randrange(30)) for _ in range(n)).encode())
        cut = len(out[-1]) // 2
        out += [out[-1][:cut] + b" changed here " + out[-1][cut:], out[-1][cut:], out[-1] + out[-1][:40]]
    return out


def test_fingerprints_equal_the_plain_ones():
    texts = samples()
    prints = op6_fingerprints.fingerprints(texts)
    assert prints == [plain_fingerprint(t) for t in texts]
    pairs = list(itertools.product(prints, prints))
    got = op6_fingerprints.likeness([a for a, _ in pairs], [b for _, b in pairs])
    want = [plain_likeness(a, b) for a, b in pairs]
    assert max(abs(g - w) for g, w in zip(got, want)) < 1e-12
    assert sum(0 < w < 1 for w in want) > 20      # not only equal and foreign texts


def plain_differencing(sizes, k):
    """Sums of the k sets, smallest first, above the smallest: the two partial partitions of largest spread are
    joined, the largest set of one with the smallest of the other, until one is left."""
    heap = [(-s, n, [0] * (k - 1) + [s]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(x + y for x, y in zip(a, reversed(b)))
        both = [x - both[0] for x in both]
        heapq.heappush(heap, (-both[-1], n, both))
        n += 1
    return heap[0][2]


def sums_of(sizes, places, k):
    sums = [0] * k
    for s, p in zip(sizes, places):
        sums[p] += s
    return sorted(sums)


def test_differencing_equals_the_plain_one():
    r = random.Random(3)
    for k, n in ((2, 9), (3, 20), (7, 60), (40, 500)):
        sizes = [r.randrange(1, 10 ** 9) for _ in range(n)]      # no ties to be broken in another way
        got = sums_of(sizes, op4_sharding.karmarkar_karp(sizes, k), k)
        assert [x - got[0] for x in got] == plain_differencing(sizes, k)
        assert sum(got) == sum(sizes)


def test_differencing_beside_the_best_partition():
    """Two sets: never better than all partitions tried, and within the largest item of the best."""
    r = random.Random(5)
    for _ in range(20):
        sizes = [r.randrange(1, 1000) for _ in range(10)]
        best = min(abs(sum(sizes) - 2 * sum(c)) for n in range(11) for c in itertools.combinations(sizes, n))
        low, high = sums_of(sizes, op4_sharding.karmarkar_karp(sizes, 2), 2)
        assert best <= high - low <= best + max(sizes)
