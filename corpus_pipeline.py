"""The corpus pipeline: toxicity, near-duplicates, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and reread as the next stage's documents.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import op2_toxicity, op5_packing, op7_simhash, op10_mixing
from cairn.llm.common import materialize, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    return op2_toxicity.reject(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: 4-word shingles, 4 differing bits at most."""
    return op7_simhash.deduplicate(docs, words=4, radius=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to bring language and quality domains to their target weights; the
    smallest rate is 1, so every document stays."""
    labelled = op10_mixing.quality_domains(docs, read(spark, sf_dir, "labels"))
    return op10_mixing.remix(docs, labelled, op10_mixing.TARGETS, total=None, least_rate=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 2048."""
    got = op5_packing.pack_documents(docs, capacity=2048, end_id=0)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      "partition_bins", "partition_bound")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The stages train a classifier and compare fingerprints; SQL cannot express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
