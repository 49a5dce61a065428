"""The thin contract queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import (op1_ann, op2_toxicity, op3_token_counts, op4_sharding, op5_packing, op6_fingerprints,
                       op7_simhash, op8_html, op9_binary, op10_mixing, op11_whitening, op12_ranked_search,
                       op13_byte_bpe)
from cairn.llm.common import read


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return op2_toxicity.score(docs, op2_toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op3_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits: the first 64 characters again
    at a quarter, a tenth (200 characters at most) cut at the middle, and 40 characters in upper
    case in place of as many at three quarters."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.char_length("text")
    edit = lambda a, b, r: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"),
                                    r.alias("replacement"))
    half, late = F.floor(n / 2), F.floor(n * 3 / 4)
    edits = F.array(edit(F.floor(n / 4), F.floor(n / 4), F.substring("text", 1, 64)),
                    edit(half, half + F.least(F.lit(200), F.floor(n / 10)), F.lit("")),
                    edit(late, late + 40, F.upper(F.substring("text", 1, 40))))
    return op3_token_counts.apply_edits(docs.withColumn("edits", edits))


def op4_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op4_sharding.shard(read(spark, sf_dir, "documents"), shards=40)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op5_packing.pack_documents(read(spark, sf_dir, "documents"), capacity=2048, end_id=0)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      "partition_bins", "partition_bound")


def op6_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op7_vp_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op7_simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, radius=4)
    bits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return got.select("doc_id", bits.alias("fingerprint"), "component_id")


def op8_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_html.extract(read(spark, sf_dir, "pages"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_binary.round_trip(read(spark, sf_dir, "documents"), end_id=2)


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target weights of language and quality domains."""
    docs = read(spark, sf_dir, "documents")
    labelled = op10_mixing.quality_domains(docs, read(spark, sf_dir, "labels"))
    return op10_mixing.mix(docs, labelled, op10_mixing.TARGETS)


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_whitening.whiten(read(spark, sf_dir, "embeddings"), components=4)


def op12_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_byte_bpe.digests(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_cross_polytope": op1_cross_polytope,
    "op2_ftrl_toxicity": op2_ftrl_toxicity,
    "op3_token_counts": op3_token_counts_query,
    "op4_karmarkar_karp": op4_karmarkar_karp,
    "op5_best_fit": op5_best_fit,
    "op6_ctph": op6_ctph,
    "op7_vp_simhash": op7_vp_simhash,
    "op8_tag_paths": op8_tag_paths,
    "op9_simple8b": op9_simple8b,
    "op10_soft_mixing": op10_soft_mixing,
    "op11_exact_whitening": op11_exact_whitening,
    "op12_nra": op12_nra,
    "op13_merge_replay": op13_merge_replay,
}

ORACLE_SQL: dict[str, str] = {"op12_nra": op12_ranked_search.SQL}
