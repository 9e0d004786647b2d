"""Thin queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockdedup, bpe, langid, licenses, lm, packing, puquality, quality, shallot, sigtree, toxicity, urlfilter, whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op5_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockdedup.groups(_documents(spark, sf_dir))


def op6_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.link_components(_documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(_documents(spark, sf_dir))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op11_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.held_out_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_host_quality, op2_toxicity, op3_bpe_round_trip, op4_license_scan, op5_block_dedup, op6_signature_trees,
        op7_url_filter, op8_language, op9_bloom_lm, op10_packing, op11_shallot, op12_pu_quality, op13_whitening,
    )
}

ORACLES = {
    "op1_host_quality": quality.ORACLE_SQL,
    "op4_license_scan": licenses.ORACLE_SQL,
    "op5_block_dedup": blockdedup.ORACLE_SQL,
    "op6_signature_trees": sigtree.ORACLE_SQL,
    "op7_url_filter": urlfilter.ORACLE_SQL,
    "op11_shallot": shallot.ORACLE_SQL,
}
