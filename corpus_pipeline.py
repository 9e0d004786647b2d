"""Pipeline over ``documents``: toxicity, host quality rules, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame with the
columns of ``documents``; the last returns the packed pieces. Stages are written as Parquet and read again.

Defined results: a null or empty text is never toxic but has too few words, so it goes with the quality rules; a null
source is a host of its own; rows repeat freely, as of equal and of near equal texts one row stays whatever its id, null
ids last; texts are read whole however long; other columns pass through all stages but the last, which returns the
pieces' columns only; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import blockdedup, packing, quality, sigtree, toxicity
from tickloom.llm.common import materialise


#: Rows that cross between Spark and Python at once: texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_bad_hosts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return blockdedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return sigtree.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_bad_hosts),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("packing", pack),
]

#: Learned scores and packing have no SQL twin; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
