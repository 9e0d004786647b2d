"""Resampling that goes on where it stopped (R4, R5): full buckets, the state of each series, and a checkpoint for each interval."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import STATE, resample_step
from . import versions

CHECKPOINT = "interval string, last_processed_date date, record_count long, status string"


def _checkpoint(spark: SparkSession, root: str, known: dict) -> DataFrame:
    return spark.read.schema(CHECKPOINT).parquet(f"{root}/{known['checkpoint']}") if known else spark.createDataFrame([], CHECKPOINT)


def run(bars: DataFrame, root: str, widths: Iterable[int], force_full: bool = False) -> DataFrame:
    """Resample the bars that the last run hasn't seen into buckets of each width, and give the checkpoint after it.

    A run reads bars from the earliest last date of its state on (a filter that reaches the files) and appends a folder of
    full buckets. Buckets, state and checkpoint of a run count from the moment when the manifest names them, all at
    once, so a run that fails leaves what was there. ``force_full`` starts anew. A width that the last run hadn't is
    read in full; the others go on. A symbol that appears is found by its bars past the earliest last date.
    """
    spark, widths = bars.sparkSession, list(widths)
    known = {} if force_full else versions.read_manifest(spark, root)
    state = spark.read.schema(STATE).parquet(f"{root}/{known['state']}") if known else spark.createDataFrame([], STATE)
    closed, after = [], []
    for n in widths:
        interval, own = f"{n}d", bars
        mine = state.where(F.col("interval") == interval)
        first = mine.agg(F.min("last_date")).first()[0] if known else None
        if first is not None:
            own = bars.where(F.col("date") > F.lit(first))
            # Symbols that have just appeared are read from their first bar on.
            appeared = own.select("symbol").distinct().join(mine.select("symbol"), "symbol", "left_anti")
            if not appeared.isEmpty():
                own = own.unionByName(bars.where(F.col("date") <= F.lit(first)).join(appeared, "symbol", "left_semi"))
        done, then = resample_step(state, own, n, interval)
        closed.append(done.withColumn("interval", F.lit(interval)))
        after.append(then)
    kept = state.where(~F.col("interval").isin([f"{n}d" for n in widths]))
    folder = versions.write_version(reduce(DataFrame.unionByName, closed).select("interval", "symbol", "date", "open", "high", "low", "close", "volume"), root, "buckets")
    states = versions.write_version(reduce(DataFrame.unionByName, after, kept), root, "state")
    last = spark.read.schema(STATE).parquet(f"{root}/{states}").groupBy("interval").agg(F.max("last_date").alias("last_processed_date"))
    count = spark.read.parquet(f"{root}/{folder}").groupBy("interval").agg(F.count(F.lit(1)).alias("n"))
    before = _checkpoint(spark, root, known).select("interval", F.col("record_count").alias("m"))
    # Intervals are a handful; one without any bar has a row too.
    names = spark.createDataFrame([(f"{n}d",) for n in widths], "interval string").join(before, "interval", "full").join(last, "interval", "left").join(count, "interval", "left")
    total = F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))
    report = names.select("interval", "last_processed_date", total.alias("record_count"), F.when(F.col("last_processed_date").isNotNull(), "completed").otherwise("empty").alias("status"))
    point = versions.write_version(report, root, "checkpoint")
    intervals = sorted({*known.get("intervals", []), *(f"{n}d" for n in widths)})
    versions.swap_manifest(spark, root, {"buckets": [*known.get("buckets", []), folder], "state": states, "checkpoint": point, "intervals": intervals})
    return read_checkpoint(spark, root)


def read_checkpoint(spark: SparkSession, root: str) -> DataFrame:
    """Last date, full buckets and status of each interval."""
    return _checkpoint(spark, root, versions.read_manifest(spark, root))


def read_buckets(spark: SparkSession, root: str, with_open: bool = True) -> DataFrame:
    """All buckets; those that aren't full yet come from the state."""
    known = versions.read_manifest(spark, root)
    columns = ["interval", "symbol", "date", "open", "high", "low", "close", "volume"]
    out = spark.read.parquet(*[f"{root}/{b}" for b in known["buckets"]]).select(*columns)
    if not with_open:
        return out
    left = spark.read.schema(STATE).parquet(f"{root}/{known['state']}").where("start IS NOT NULL")
    return out.unionByName(left.withColumnRenamed("start", "date").select(*columns))
