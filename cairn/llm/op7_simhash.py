"""SimHash near-duplicates by a distributed vantage-point tree.

Fingerprint: the text with A-Z lower-cased is cut into words, every run of four words joined by
blanks is a shingle (all words where there are fewer), and a bit is 1 if it is set in more than half
of the shingles' XXH64 values (seed 42, unsigned).

Links: distinct fingerprints only.  The upper levels of a vantage-point tree come from a bounded
sample: a node holds a vantage fingerprint and the median distance to it; what lies within goes
left, the rest right.  Every fingerprint has one home shard (leaf).  A fingerprint at home on the
left whose distance is within the radius of the border also visits the right, and a visitor goes
wherever the triangle inequality does not rule a partner out; so every pair within the radius meets
in the home shard of one of the two.  Inside a shard distances are exact, and only a spanning set of
its links is returned, never all pairs.  The links' connected components are found on Spark.

Edge cases: a null or empty text and one of white space alone have fingerprint zero, linked like any
other; a row without an id has a fingerprint but no component; repeated rows and equal texts share a
fingerprint; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import components, join_hot_safe, materialize

SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits of the shingles' hashes, as an unsigned 64-bit number."""
    import xxhash
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        first, ends = first[:len(parts) - words + 1], ends[words - 1:]
    else:
        first, ends = first[:1], ends[-1:]
    digest, counts, half = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(first) / 2
    for at in range(0, len(first), 1 << 16):
        a, b = first[at:at + (1 << 16)].tolist(), ends[at:at + (1 << 16)].tolist()
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a, b)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts > half, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Rows (doc_id, fp, text_hash); ``fp`` holds the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], schema=schema)

    cols = (F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.select(*cols).mapInArrow(work, "doc_id long, fp long, text_hash long")


class Tree:
    """Upper levels of a vantage-point tree over 64-bit fingerprints."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, seed: int = 7):
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, border, left, right; a leaf is ~number
        self.leaves, self.radius = 0, radius
        self._rng = np.random.default_rng(seed)
        self.root = self._grow(np.sort(sample), leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        if len(points) > leaf:
            best = None
            for v in self._rng.choice(points, min(8, len(points)), replace=False):
                d = np.bitwise_count(points ^ v)
                for border in {int(np.median(d)), int(np.median(d)) - 1}:
                    left = int((d <= border).sum())
                    # points that would go both ways, then the balance of the sides
                    near = int(((d > border - self.radius) & (d <= border + self.radius)).sum())
                    cost = near + abs(len(points) - 2 * left)
                    if 0 < left < len(points) and (best is None or cost < best[0]):
                        best = (cost, v, border, d <= border)
            if best is not None:
                _, v, border, inside = best
                n = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                left, right = self._grow(points[inside], leaf), self._grow(points[~inside], leaf)
                self.nodes[n] = (int(v), border, left, right)
                return n
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, leaf, whether it is at home there)."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            n, at, home = todo.pop()
            if not len(at):
                continue
            if n < 0:
                found.append((at, ~n, home))
                continue
            v, border, left, right = self.nodes[n]
            d = np.bitwise_count(points[at] ^ np.uint64(v)).astype(np.int64)
            inside = d <= border
            go_left = np.where(home, inside, d - self.radius <= border)
            go_right = ~inside | (d + self.radius > border)
            todo.append((left, at[go_left], home[go_left]))
            todo.append((right, at[go_right], (home & ~inside)[go_right]))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
        return (np.concatenate([x[0] for x in found]), np.concatenate([np.full(len(x[0]), x[1]) for x in found]),
                np.concatenate([x[2] for x in found]))


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component after the links (a, b) join those of ``root``."""
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _shard_links(radius: int):
    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Spanning links of one shard's part: the points that ask in part i, home points or
        visitors, against the home points that answer in part j."""
        _, i, j = (int(k) for k in key)
        rows = rows.sort_values("fp", kind="stable")
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        base = np.flatnonzero(rows["home"].to_numpy(bool) & (rows["answers"].to_numpy(np.int64) == j))
        ask = np.flatnonzero(rows["asks"].to_numpy(np.int64) == i)
        root = np.arange(len(fp))
        for at in range(0, len(ask), 512):
            block = ask[at:at + 512]
            d = np.bitwise_count(fp[block][:, None] ^ fp[base][None, :])
            x, y = np.nonzero(d <= radius)
            root = _roots(len(fp), block[x], base[y], root)
        tied = np.flatnonzero(root != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pd.DataFrame({"a": signed[tied], "b": signed[root[tied]]})
    return links


def links(prints: DataFrame, radius: int = 4, leaf: int = 32_768, sample: int = 200_000,
          block: int = 65_536, ask_block: int = 131_072) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that span every group within ``radius``.

    ``sample`` bounds the fingerprints that the tree's upper levels are fitted on; every
    fingerprint is then routed.  A shard's home points answer in parts of about ``block``, all its
    points ask in parts of about ``ask_block`` (askers pass by 512 at a time), and a task holds one
    part of each, so its memory is bounded whatever the size of a shard.
    """
    spark = prints.sparkSession
    n = prints.count()
    seen = prints.orderBy(F.xxhash64("fp", F.lit(1))).limit(sample) if n > sample else prints
    points = np.array([r[0] for r in seen.collect()], dtype=np.int64).view(np.uint64)
    tree = Tree(points, max(64, leaf * len(points) // max(1, n)), radius)
    shared = spark.sparkContext.broadcast(tree)
    schema = pa.schema([("fp", pa.int64()), ("shard", pa.int32()), ("home", pa.bool_())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, shard, home = shared.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(shard.astype(np.int32)), pa.array(home)],
                                             schema=schema)

    routed = materialize(prints.select("fp").mapInArrow(route, "fp long, shard int, home boolean"), "routed")
    # the list has one row per shard that is cut into parts
    large = (routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ask_block).cast("int").alias("m"),
                                         F.greatest(F.lit(1), F.ceil(F.count_if("home") / block)).cast("int").alias("n"))
             .filter((F.col("m") > 1) | (F.col("n") > 1)))
    sized = routed.join(F.broadcast(large), "shard", "left").withColumns(
        {"m": F.coalesce("m", F.lit(1)), "n": F.coalesce("n", F.lit(1))}).withColumns(
        {"asks": F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"),
         "answers": F.pmod(F.xxhash64("fp", F.lit(2)), F.col("n")).cast("int")})
    # a point asks every part of the home points and, at home, answers every part of the askers
    ask = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.col("asks").alias("i"), o.alias("j")))
    answer = F.transform(F.sequence(F.lit(0), F.col("m") - 1),
                         lambda o: F.struct(o.alias("i"), F.col("answers").alias("j")))
    meet = F.array_distinct(F.when(F.col("home"), F.concat(ask, answer)).otherwise(ask))
    dealt = sized.select("fp", "home", "asks", "answers", "shard", F.explode(meet).alias("p")) \
        .select("fp", "home", "asks", "answers", "shard", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    return dealt.groupBy("shard", "i", "j").applyInPandas(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Rows (doc_id, fp, text_hash, group, component_id): the group's smallest fingerprint and doc_id."""
    rows = materialize(add_fingerprint(docs, words=words), "prints")
    total = rows.count()
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("__first"), F.count(F.lit(1)).alias("__n")),
                          "classes")
    found = components(links(classes.select("fp"), radius), "simhash-cc")
    member = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "__first", F.coalesce("component", "fp").alias("__group"))
    first = member.groupBy("__group").agg(F.min("__first").alias("component_id"))
    of_print = materialize(member.join(first, "__group")
                           .select("fp", F.col("__group").alias("group"), "component_id"), "classes-of")
    out = join_hot_safe(rows, of_print, "fp", classes.select("fp", "__n"), total)
    return out.select("doc_id", "fp", "text_hash", "group",
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id.  Rows without an id all stay.

    Rows to drop are named by id and text hash.  Where the kept id itself has several rows in the
    group, one of them stays.
    """
    found = materialize(near_duplicates(docs, words, radius), "groups")
    tagged = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))) \
        .withColumn("__id", F.col("doc_id").cast("long"))
    named = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("group").alias("__group"),
                         (F.col("doc_id") != F.col("component_id")).alias("__drop"))
    kept = tagged.join(named.filter("__drop").select("__id", "__hash").distinct(), ["__id", "__hash"], "left_anti")
    own = named.filter("not __drop")
    twice = own.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__group")
    if twice.isEmpty():
        return kept.select(docs.columns)
    again = own.join(twice, "__group").select("__id", "__hash", "__group").distinct()
    lone = kept.join(again, ["__id", "__hash"]).dropDuplicates(["__group"])
    rest = kept.join(again, ["__id", "__hash"], "left_anti")
    return rest.select(docs.columns).unionByName(lone.select(docs.columns))
