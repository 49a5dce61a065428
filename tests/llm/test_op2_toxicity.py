import random
import zlib

from pyspark.sql import functions as F

from cairn.llm import op2_toxicity
from cairn.llm.common import read


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = op2_toxicity.score(docs, op2_toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out") \
        .groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    clean, toxic = n.get((0, 0), 0) + n.get((0, 1), 0), n.get((1, 0), 0) + n.get((1, 1), 0)
    assert n.get((0, 1), 0) <= 0.02 * clean and n.get((1, 1), 0) >= 0.75 * toxic


def small(spark, n=600):
    r = random.Random(1)
    plain = ["apple", "river", "stone", "cloud", "green", "walks", "over", "under", "seven", "light"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[r.randrange(30)] = "vilest"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_fold_is_not_learnt_and_edges(spark, documents, odd_rows):
    rows, labels = small(spark)
    docs = documents(rows)
    weights = op2_toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(op2_toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (op2_toxicity.fit(docs, flipped) == weights).all()
    got = {r.doc_id: r for r in op2_toxicity.score(docs, weights).collect()}
    for i, t in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int("vilest" in t) and 0 <= got[i].score <= 1
    odd = op2_toxicity.score(documents(odd_rows), weights).collect()
    assert len(odd) == len(odd_rows) and all(r.predicted == 0 for r in odd)
    kept = op2_toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in rows if "vilest" not in t}


def test_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, None)])
    assert op2_toxicity.fit(docs, none) is None
    assert [r.score for r in op2_toxicity.score(docs, None).collect()] == [0.0, 0.0]
    assert op2_toxicity.reject(docs, none).count() == 2
    assert op2_toxicity.score(documents([]), op2_toxicity.fit(docs, none)).count() == 0
