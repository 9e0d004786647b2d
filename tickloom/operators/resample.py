"""Resampling of bars (R operators)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ohlcv_agg(by: str | Column = "date") -> list[Column]:
    """A1: first, highest, lowest, last and sum in the order of ``by``."""
    return [F.min_by("open", by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", by).alias("close"), F.sum("volume").alias("volume")]


def bucket_start(date: str | Column, n: int | Column) -> Column:
    """First day of the n-day bucket counted from 1970-01-01."""
    days = F.unix_date(F.col(date) if isinstance(date, str) else date)
    n = F.lit(n) if isinstance(n, int) else n
    return F.date_from_unix_date((F.floor(days / n) * n).cast("int"))


def resample_calendar(bars: DataFrame, n: int) -> DataFrame:
    """N-day bars of the calendar, labelled by their first day; n <= 1 leaves the bars."""
    if n <= 1:
        return bars
    return bars.groupBy("symbol", bucket_start("date", n).alias("bucket")).agg(*ohlcv_agg()).withColumnRenamed("bucket", "date")


def resample_time(bars: DataFrame, seconds: int) -> DataFrame:
    """R1 for bars whose ``date`` is a time: buckets of so many seconds from 1970-01-01 on, labelled by their first moment."""
    micros = F.unix_micros("date")
    start = F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))
    return bars.groupBy("symbol", start.alias("bucket")).agg(*ohlcv_agg()).withColumnRenamed("bucket", "date")


def resample_all(bars: DataFrame, ns: Iterable[int], also: tuple[str, ...] = ()) -> DataFrame:
    """Several widths at once, with a column ``n``: one explode, one shuffle. also: further columns that tell series apart."""
    spread = bars.withColumn("n", F.explode(F.array(*[F.lit(n) for n in ns])))
    return spread.groupBy("symbol", "n", *also, bucket_start("date", F.col("n")).alias("bucket")).agg(*ohlcv_agg()).withColumnRenamed("bucket", "date")


def last_buckets(last: DataFrame, ns: Iterable[int]) -> DataFrame:
    """(n, date): of each width the bar that holds the last date, so the last bar of ``resample_all``. last: one row ``date``, the bars' last date."""
    return last.withColumn("n", F.explode(F.array(*[F.lit(n) for n in ns]))).select("n", bucket_start("date", F.col("n")).alias("date"))


def resample_rows(bars: DataFrame, n: int, after: str | None = None, by: str = "date") -> DataFrame:
    """N bars each, counted per symbol over distinct dates (or rows); only buckets that start after ``after``."""
    w = Window.partitionBy("symbol").orderBy("date")
    place = F.dense_rank().over(w) if by == "date" else F.row_number().over(w)
    out = bars.withColumn("bucket", F.floor((place - 1) / n)).groupBy("symbol", "bucket").agg(F.min("date").alias("date"), *ohlcv_agg())
    if after is not None:
        out = out.where(F.col("date") > F.lit(after).cast("date"))
    return out.drop("bucket")


def resample_incremental(target: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """The target with the buckets of the source that start past each symbol's last one."""
    last = target.groupBy("symbol").agg(F.max("date").alias("last"))
    new = resample_rows(source, n, by="row").join(last, "symbol", "left").where(F.col("last").isNull() | (F.col("date") > F.col("last")))
    return target.unionByName(new.drop("last"))


def resample_checkpoint(resampled: DataFrame, interval: str) -> DataFrame:
    """What a run leaves behind; the next run starts after ``last_processed_date``."""
    return resampled.agg(F.lit(interval).alias("interval"), F.max("date").alias("last_processed_date"), F.count(F.lit(1)).alias("record_count")).withColumn("status", F.when(F.col("record_count") > 0, "completed").otherwise("empty"))


def resume_from(checkpoints: DataFrame, bars: DataFrame, interval: str, force_full: bool = False) -> DataFrame:
    """The bars that a run still has to read."""
    if force_full:
        return bars
    last = checkpoints.where((F.col("interval") == interval) & (F.col("status") == "completed")).agg(F.max("last_processed_date").alias("last"))
    return bars.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.col("date") > F.col("last"))).drop("last")


#: What a series' resampling carries from run to run: the last date read, the bars counted, and the bucket that isn't full.
STATE = "symbol string, interval string, last_date date, bars long, start date, open double, high double, low double, close double, volume double"


def resample_step(state: DataFrame, bars: DataFrame, n: int, interval: str) -> tuple[DataFrame, DataFrame]:
    """Full buckets of n bars from those past each symbol's last date, and the state after them.

    Bars are counted on from the state, and the bucket that was open is put in front as if it were a bar. So a run
    costs its new bars, and runs one after the other give what one run over all bars gives.
    """
    old = state.where(F.col("interval") == interval)
    known = old.select(F.col("symbol").alias("_s"), "last_date", F.col("bars").alias("before"))
    new = bars.join(known, bars["symbol"].eqNullSafe(F.col("_s")), "left").where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date")))
    at = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    prices = ["open", "high", "low", "close", "volume"]
    rows = new.select("symbol", "date", *prices, at.alias("at"), F.col("date").alias("seen"))
    opened = old.where("start IS NOT NULL").select("symbol", F.col("start").alias("date"), *prices, F.col("bars").alias("at"), F.col("last_date").alias("seen"))
    idle = old.where("start IS NULL").select("symbol", F.lit(None).cast("date").alias("date"), *[F.lit(None).cast("double").alias(p) for p in prices], F.col("bars").alias("at"), F.col("last_date").alias("seen"))
    full = rows.unionByName(opened).withColumn("bucket", F.floor((F.col("at") - 1) / n))
    buckets = full.groupBy("symbol", "bucket").agg(F.min("date").alias("date"), *ohlcv_agg("at"), F.max("at").alias("last"), F.max("seen").alias("seen"))
    closed = buckets.where(F.col("last") == (F.col("bucket") + 1) * n)
    last = buckets.select("symbol", "last", "seen", F.when(F.col("last") != (F.col("bucket") + 1) * n, F.struct("date", *prices)).alias("left"))
    last = last.unionByName(idle.select("symbol", F.col("at").alias("last"), "seen", F.lit(None).cast(last.schema["left"].dataType).alias("left")))
    # The series' last place tells its last bucket; of an idle state and new bars the new bars have it.
    ends = last.groupBy("symbol").agg(F.max("seen").alias("last_date"), F.max("last").alias("bars"), F.max_by("left", "last").alias("left"))
    after = ends.select("symbol", F.lit(interval).alias("interval"), "last_date", "bars", F.col("left.date").alias("start"), *[F.col(f"left.{p}").alias(p) for p in prices])
    return closed.select("symbol", "date", *prices), after
