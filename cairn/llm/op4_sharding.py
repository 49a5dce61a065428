"""Balanced sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups (all rows of one text) keep together, so byte balance is a number-partitioning problem.
Group sizes are summed on Spark.  A group larger than 1 / (200 x shards) of all bytes is an item
of its own (there can be at most 200 x shards of those); all other groups are dealt into
``packets`` packets by their key's hash, and each packet is an item.  The number of items thus has
a bound that does not depend on the input.  Differencing then starts from one partial partition
per item, repeatedly takes the two with the largest spread and lays them over each other in
opposite order.  Items go back to the rows by broadcast joins, so no row is shuffled by its text.

Edge cases: a null text counts as an empty one (16 bytes, the group of the empty text); repeated
rows are separate rows of one group; an empty table gives no rows; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, partitions_for, text_key

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: An item of its own is larger than all bytes / (BIG_PER_SHARD x shards).
BIG_PER_SHARD = 200
PACKETS = 8192


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """Part (0 .. k-1) of each item, by k-way differencing."""
    nodes: list[tuple] = []
    heap: list[tuple] = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = s
        nodes.append((i, None, None))
        heap.append((-int(s), i, sums))
    if not nodes:
        return []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, high = heapq.heappop(heap)
        _, b, low = heapq.heappop(heap)
        sums = high + low[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), len(nodes) - 1, sums - sums[-1]))
    part = [0] * len(sizes)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        n, names = todo.pop()
        a, b, order = nodes[n]
        if b is None:
            part[a] = int(names[0])
            continue
        of_a, of_b = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        of_a[order] = names
        of_b[k - 1 - order] = names
        todo += [(a, of_a), (b, of_b)]
    return part


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          packets: int = PACKETS, rows_per_task: int = 200_000) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot); ``slot`` counts a shard's rows from 0 without gaps."""
    return _place(docs, shards, id_col, text_col, packets, rows_per_task, [])


def _place(docs: DataFrame, shards: int, id_col: str, text_col: str, packets: int, rows_per_task: int,
           own: list[str]) -> DataFrame:
    """The rows of ``shard``, with the columns ``own`` of the documents (numbers that tell rows apart)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), text_key(text).alias("__key"), *own), "shard-rows")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    groups = materialize(rows.groupBy("__key").agg(F.sum("size").alias("__bytes")), "shard-groups")
    least = (total or 0) // (BIG_PER_SHARD * shards)
    packet = F.pmod(F.xxhash64("__key"), F.lit(packets)).cast("int").alias("__packet")
    big = groups.filter(F.col("__bytes") > least).select("__key", "__bytes").collect()
    small = (groups.filter(F.col("__bytes") <= least).groupBy(packet)
             .agg(F.sum("__bytes").alias("__bytes")).collect())
    items = sorted(((r["__bytes"], bytes(r["__key"]), None) for r in big), reverse=True)
    items += sorted(((r["__bytes"], None, r["__packet"]) for r in small), reverse=True)
    part = karmarkar_karp([x[0] for x in items], shards)
    of_big = spark.createDataFrame([(bytearray(x[1]), p) for x, p in zip(items, part) if x[1] is not None],
                                   "__key binary, __own int")
    of_packet = spark.createDataFrame([(x[2], p) for x, p in zip(items, part) if x[1] is None],
                                      "__packet int, __with int")
    placed = (rows.withColumn("__packet", packet)
              .join(F.broadcast(of_big), "__key", "left").join(F.broadcast(of_packet), "__packet", "left")
              .select("doc_id", "size", "text_crc32", *own, F.coalesce("__own", "__with").alias("shard"),
                      F.pmod(F.xxhash64("doc_id", "__key"), F.lit(partitions_for(spark, n, rows_per_task))).alias("__b")))
    counts = placed.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("shard", "__b", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__b"))
                                            - F.col("__n")).alias("__before"))
    w = Window.partitionBy("shard", "__b").orderBy("doc_id", "text_crc32", *own)
    return (placed.withColumn("__i", F.row_number().over(w)).join(before, ["shard", "__b"])
            .select("doc_id", "size", "text_crc32", *own, "shard", (F.col("__before") + F.col("__i") - 1).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write the rows (id, text), each once, as one folder ``shard=k`` per shard.

    Rows are numbered once, in a written copy, and get their places by that number: ids may be null
    or repeated, and texts of one id may have equal checksums.
    """
    rows = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row")), "shard-texts")
    places = _place(rows, shards, "doc_id", "text", PACKETS, 200_000, ["__row"])
    (rows.join(places.select("__row", "text_crc32", "shard", "slot"), "__row")
     .select("doc_id", "text_crc32", "text", "shard", "slot")
     .repartition(F.col("shard"), F.pmod("slot", F.lit(16))).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
