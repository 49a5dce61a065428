"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its lower-cased words, the words' first four and five
letters, pairs of neighbouring words, and pairs with one word between, hashed into 2**bits places.
The model is fitted in one pass over a bounded sample of labelled rows (``most`` rows, the
first by a hash of the id); every coordinate has its own learning rate and L1 keeps most
weights at zero, so the weights that are left (2**bits at most) are collected and broadcast.

Edge cases: a null or empty text, or one without words, scores by the bias alone; rows without a
label or with a null id do not train; an id with several labels counts as toxic if one says so;
without any labelled row every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint32(2654435761)  # the odd number nearest 2**32 / the golden ratio
_KEPT_WORDS = 400_000
_SEGMENT = 1 << 16


class Features:
    """Places of a text's features; words are hashed once while they are remembered."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, {}
        self.table = np.zeros((1 << 12, 3), np.uint32)

    def _rows(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) > _KEPT_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    n = known[w] = len(known)
                    if n >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    b = w.encode("utf-8", "surrogatepass")
                    self.table[n] = (zlib.crc32(b), zlib.crc32(w[:4].encode("utf-8", "surrogatepass"), 4),
                                     zlib.crc32(w[:5].encode("utf-8", "surrogatepass"), 5))
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return self.table[at]

    def places(self, text: str | None) -> np.ndarray:
        words = _WORDS.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint32)
        # a word run is looked up in parts, each with fewer words than are remembered
        rows = np.concatenate([self._rows(words[i:i + _SEGMENT]) for i in range(0, len(words), _SEGMENT)])
        h = rows[:, 0]
        got = [h, rows[:, 1], rows[:, 2]]
        if len(words) > 1:
            got.append((h[:-1] * np.uint32(31) ^ h[1:]) + np.uint32(1))
        if len(words) > 2:
            got.append((h[:-2] * np.uint32(37) ^ h[2:]) + np.uint32(2))
        return (np.concatenate(got) * _MIX) >> np.uint32(32 - self.bits)


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # the last place is the bias, which has no L1
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(np.unique(places).astype(np.int64), len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((np.abs(self.z) > self.l1) | (np.arange(len(self.z)) == len(self.z) - 1))
        return at, self.weights(at)


def held_out(id_col: str | Column) -> Column:
    """The fold that is never learnt from; a null id is in none."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 40_000, bits: int = BITS) -> np.ndarray | None:
    """Weights, the bias last; None where no row is labelled."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__label")))
    order = F.xxhash64("__id", F.lit(17))
    sample = known.orderBy(order).limit(most)
    # at most ``most`` rows of two numbers; an id with several texts gives one of them, chosen by hash before
    # the rows meet, so that the learning task never has more than ``most`` texts
    text = F.struct(F.xxhash64("text").alias("hash"), "text")
    rows = (docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(sample), "__id")
            .groupBy("__id", "__label").agg(F.min(text).alias("__text"))
            .select("__label", F.col("__text.text").alias("text"), order.alias("__order"))
            .repartition(1).sortWithinPartitions("__order").select("__label", "text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features, n = Ftrl(bits), Features(bits), 0
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                model.learn(features.places(text), label)
                n += 1
        if n:
            at, w = model.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["place", "weight"])

    got = rows.mapInArrow(learn, "place long, weight double").toPandas()
    if got.empty:
        return None
    weights = np.zeros((1 << bits) + 1, np.float64)
    weights[got["place"].to_numpy()] = got["weight"].to_numpy()
    return weights


def scorer(weights: np.ndarray, bits: int = BITS):
    """text -> score, for use inside a task."""
    features, used = Features(bits), weights[:-1] != 0

    def score(text: str | None) -> float:
        at = features.places(text)
        s = weights[np.unique(at[used[at]])].sum() + weights[-1]
        return float(1.0 / (1.0 + np.exp(-np.clip(s, -35, 35))))
    return score


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    fold = held_out("doc_id").alias("held_out")
    if weights is None:
        return docs.select(F.col("doc_id").cast("long"), fold, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(shared.value)
        for b in batches:
            s = np.array([of(t) for t in b.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             schema=schema)

    return docs.select(F.col("doc_id").cast("long"), fold, "text").mapInArrow(
        work, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they are."""
    weights = fit(docs, labels)
    if weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = scorer(shared.value)
        for texts in parts:
            yield texts.map(lambda t: of(t) < threshold, na_action=None).astype(bool)

    return docs.filter(clean(F.col("text")))
