"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each table turns unit vectors by three rounds of random signs and a Hadamard transform and assigns
them to the nearest signed axis, its cell.  A query visits, in every table, the cells of its
largest coordinates: ``probes`` of them, and further ones until the visited cells hold
``least_candidates`` vectors.  Cells are worked on in parts of bounded size; a part computes exact
distances in blocks and returns the best ``k`` of each query, so no list of candidate pairs exists.
The parts' lists are merged into each query's ``k`` nearest.

Equal vectors are indexed once, with their ``k + 1`` smallest ids (no larger id can be among the
nearest, ties going to smaller ids).  The index holds every vector; nothing is fitted.

Edge cases: null, zero and empty vectors and those with null or non-finite components take no part;
vectors of another dimension than the most frequent take none either; repeated ids are kept once,
the first by vector hash; fewer than ``k`` candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize

FOUND = "query_id long, vec_id long, score double"


class Rotations:
    """Hadamard pseudo-rotations of one dimension, by seed: the same in every task."""

    def __init__(self, dim: int, tables: int, seed: int = 20):
        self.dim, self.size = dim, 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def turn(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, :self.dim] = x
        for signs in self.signs[table]:
            y *= signs
            h = 1
            while h < self.size:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), self.size)
                h *= 2
            y /= np.sqrt(self.size)
        return y

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """Nearest signed axis: 2 * axis, plus 1 on its negative side."""
        y = self.turn(x, table)
        axis = np.abs(y).argmax(1)
        return 2 * axis + (y[np.arange(len(y)), axis] < 0)

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """All cells, nearest first."""
        y = self.turn(x, table)
        return np.argsort(-np.stack([y, -y], axis=2).reshape(len(y), -1), axis=1, kind="stable")


def usable(vec: Column) -> Column:
    """Vectors that take part: some component, all finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def one_per_id(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, key, v): of each id the usable vector with the smallest hash, which stands for the id both in the
    index and as a query, in whatever order its rows come."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    # adding zero turns -0.0 into 0.0
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))) \
        .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("v") == (size[0] if size else 0)).groupBy("id") \
        .agg(F.min(F.struct(F.xxhash64("v").alias("key"), "v")).alias("s")).select("id", "s.key", "s.v")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Rows (rep, ids, vec): each different vector once, with its k + 1 smallest ids in order."""
    # each map task keeps k + 1 rows of a group at most, so a frequent vector does not meet in one task
    w = Window.partitionBy("key", "v").orderBy("id")
    few = rows.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k + 1)
    return few.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")) \
        .select(F.element_at("ids", 1).alias("rep"), "ids", F.col("v").alias("vec"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = 12, probes: int = 8, least_candidates: int = 4000, part_rows: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the nearest found of each row that ``queries`` holds for,
    by Euclidean distance, among all rows but itself."""
    spark = vectors.sparkSession
    rows = one_per_id(vectors, id_col, vec_col)
    base = materialize(distinct_vectors(rows, k), "vectors")
    n, dim = base.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    ids = vectors.filter(queries).select(F.col(id_col).cast("long").alias("id")).distinct()
    asked = rows.join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turns = Rotations(dim, tables)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            cells = np.concatenate([turns.cells(x, t) + t * 2 * turns.size for t in range(tables)])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0)] * tables), pa.array(cells.astype(np.int32))],
                                             ["rep", "cell"])

    cells = materialize(base.select("rep", "vec").mapInArrow(index, "rep long, cell int"), "cells")
    # one row per cell: tables * 2 * dimension of them
    held = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    count = np.zeros((tables, 2 * turns.size), np.int64)
    for r in held:
        count[r["cell"] // (2 * turns.size), r["cell"] % (2 * turns.size)] = r["n"]
    parts = -(-count // part_rows)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            order = np.stack([turns.probes(x, t) for t in range(tables)], axis=1)
            # cells nearer than the i-th are visited if they hold too little together
            seen = sum(np.cumsum(count[t][order[:, t]], axis=1) for t in range(tables))
            depth = np.maximum(probes, 1 + (seen < least_candidates).sum(1))
            at, cell, part = [], [], []
            for i in range(len(x)):
                for t in range(tables):
                    for c in order[i, t, :depth[i]].tolist():
                        for p in range(int(parts[t, c])):
                            at.append(i)
                            cell.append(c + t * 2 * turns.size)
                            part.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cell, pa.int32()),
                                              pa.array(part, pa.int32())], ["query_id", "cell", "part"])

    wanted = asked.mapInArrow(visit, "query_id long, cell int, part int")
    flat = parts.reshape(-1)
    split = F.element_at(F.array(*[F.lit(int(p)) for p in flat]), F.col("cell") + 1)
    left = cells.join(base, "rep").select("cell", F.pmod(F.xxhash64("rep"), split).cast("int").alias("part"),
                                          F.lit(0).cast("long").alias("query_id"), "vec", "ids")
    right = wanted.join(asked, "query_id").select("cell", "part", "query_id", F.col("q").alias("vec"),
                                                  F.lit(None).cast("array<bigint>").alias("ids"))

    def rerank(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ask = rows["ids"].isna().to_numpy()
        if not ask.any() or ask.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        stored = rows[~ask]
        x, names = np.stack(stored["vec"].to_list()), stored["ids"].to_list()
        first = np.array([i[0] for i in names], np.int64)
        q, qid = np.stack(rows.loc[ask, "vec"].to_list()), rows.loc[ask, "query_id"].astype(np.int64).to_numpy()
        out: list[tuple[int, int, float]] = []
        for v, query in zip(q, qid.tolist()):
            d = np.sqrt(np.square(x - v).sum(1))
            # k + 1 nearest vectors, one of which may be the query's own; ties to smaller ids
            near = np.argpartition(d, k)[:k + 1] if len(d) > k + 1 else np.arange(len(d))
            if len(d) > k + 1:
                near = np.flatnonzero(d <= d[near].max())
            near = near[np.lexsort((first[near], d[near]))][:k + 1]
            got = sorted((float(d[i]), int(n)) for i in near for n in names[i] if n != query)
            out += [(query, n, s) for s, n in got[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.unionByName(right).groupBy("cell", "part").applyInPandas(rerank, FOUND).distinct()
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
