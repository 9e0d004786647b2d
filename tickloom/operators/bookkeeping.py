"""Keeping track of what was ingested (G operators)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import with_day


def _date(d: str | Column) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else d


def update_watermark(wm: DataFrame, batch: DataFrame, date: str | Column) -> DataFrame:
    """G1: the batch's symbols get a new current row; their old one is closed."""
    new = batch.select("symbol").distinct().select("symbol", _date(date).alias("latest_date"), F.lit(1).cast("long").alias("records_count"), F.lit(True).alias("is_current"))
    seen = new.select(F.col("symbol").alias("_s"))
    old = wm.join(seen, wm["symbol"] == seen["_s"], "left").withColumn("is_current", F.col("is_current") & F.col("_s").isNull()).drop("_s")
    return old.unionByName(new, allowMissingColumns=True)


def missing_dates(wm: DataFrame, today: str | Column | DataFrame, hour_et: int | Column = 16, n: int = 30) -> DataFrame:
    """Weekdays after the watermark up to the last day there can be data for, the latest n of them."""
    day, hour = F.col("_day"), F.lit(hour_et) if isinstance(hour_et, int) else hour_et
    last = F.when((hour >= 16) & F.dayofweek(day).between(2, 6), day).otherwise(F.date_sub(day, 1))
    at = with_day(wm.where("is_current").agg(F.max("latest_date").alias("done")), today).select(last.alias("last"), F.coalesce(F.date_add("done", 1), F.date_sub(day, n)).alias("start"))
    days = at.where("start <= last").select(F.explode(F.sequence("start", "last")).alias("date")).where(F.dayofweek("date").between(2, 6))
    return days.orderBy(F.desc("date")).limit(n)


def new_symbols(meta: DataFrame, wm: DataFrame) -> DataFrame:
    """Active symbols without a current watermark, and those with a single one of few records."""
    active = meta.where(F.lower(F.col("active")) == "true").select("symbol")
    none = active.join(wm.where("is_current").select("symbol").distinct(), "symbol", "left_anti").withColumn("reason", F.lit("NO_WATERMARK"))
    few = wm.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("records_count").alias("c")).where("n = 1 AND c <= 5").select("symbol")
    short = active.join(few, "symbol", "left_semi").join(none.select("symbol"), "symbol", "left_anti").withColumn("reason", F.lit("LIMITED_HISTORY"))
    return none.unionByName(short).distinct()


def needs_backfill(meta: DataFrame, bars: DataFrame, n: int = 100) -> DataFrame:
    """Active symbols with fewer than n bars, fewest first."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    out = meta.where(F.lower(F.col("active")) == "true").select("symbol").join(counts, "symbol", "left")
    return out.where(F.coalesce("bars", F.lit(0)) < n).orderBy(F.asc_nulls_first("bars"), "symbol")


def active_symbols(meta: DataFrame, types: Iterable[str] | None = None, min_marketcap: int | None = None, max_marketcap: int | None = None, industries: Iterable[str] | None = None) -> DataFrame:
    """G5"""
    out = meta.where(F.lower(F.trim("active")) == "true")
    if types:
        out = out.where(F.col("type").isin(list(types)))
    if min_marketcap is not None:
        out = out.where(F.col("marketcap") >= min_marketcap)
    if max_marketcap is not None:
        out = out.where(F.col("marketcap") <= max_marketcap)
    if industries:
        cond = F.lit(False)
        for term in industries:
            cond = cond | F.col("industry").ilike(f"%{term}%")
        out = out.where(cond)
    return out


def scannable(meta: DataFrame, bars: DataFrame, date: str | Column | DataFrame) -> DataFrame:
    """Active symbols (unknown counts as active) that have a bar on the date."""
    live = meta.where(F.coalesce(F.lower(F.col("active")), F.lit("true")) == "true").select("symbol")
    return live.join(with_day(bars, date).where(F.col("date") == F.col("_day")).select("symbol"), "symbol", "left_semi")


def freshness(snap: DataFrame, date: str | Column) -> DataFrame:
    """G7"""
    return snap.agg(F.max("date").alias("max_date")).select("max_date", (F.col("max_date") < _date(date)).alias("stale"))


def trading_days(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays of [start, end] without the holidays, with the trading days before and after."""
    days = spark.range(1).select(F.explode(F.sequence(_date(start), _date(end))).alias("date")).where(F.dayofweek("date").between(2, 6))
    if holidays is not None:
        days = days.join(holidays.select("date"), "date", "left_anti")
    # A calendar has some thousand rows, so the one window over all of it is small.
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    return days.withColumns({"prev": F.lag("date").over(w), "next": F.lead("date").over(w)})


def with_session(df: DataFrame, ts: str, holidays: DataFrame | None = None, into: str = "in_session", tz: str = "America/New_York") -> DataFrame:
    """Whether a time lies in a session, holidays (date) left out. Holidays are a short list, which Spark sends to the rows."""
    out = df.withColumn(into, F.coalesce(in_session(F.col(ts), tz), F.lit(False)))
    if holidays is None:
        return out
    day = holidays.select(F.col("date").alias("_holiday")).distinct()
    out = out.join(day, F.from_utc_timestamp(F.col(ts), tz).cast("date") == F.col("_holiday"), "left")
    return out.withColumn(into, F.col(into) & F.col("_holiday").isNull()).drop("_holiday")


def in_session(ts: Column, tz: str = "America/New_York") -> Column:
    """09:30 to 16:00 of the exchange's time on a weekday; ``with_session`` knows holidays."""
    local = F.from_utc_timestamp(ts, tz)
    minute = F.hour(local) * 60 + F.minute(local)
    return F.dayofweek(local).between(2, 6) & (minute >= 570) & (minute < 960)


def distribution(df: DataFrame) -> DataFrame:
    """Rows and symbols by month."""
    return df.groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def archive_stats(archive: DataFrame) -> DataFrame:
    return archive.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def retention_report(log: DataFrame) -> DataFrame:
    """Runs of the retention whose numbers don't agree."""
    return log.withColumn("consistent", F.col("archived") == F.col("deleted"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """G11"""
    return counts(df, keys).where("n > 1")


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stats(df: DataFrame, col: str = "close") -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("least"), F.max(col).alias("greatest"))


def days_to_complete(bars: DataFrame, n: int, calendar: DataFrame, today: str | Column) -> DataFrame:
    """Trading days that the open n-day candle of each symbol still lacks."""
    days = calendar.where(F.col("date") <= _date(today)).agg(F.sort_array(F.collect_list("date")).alias("days"))  # a calendar is short
    last = bars.groupBy("symbol").agg(F.max("date").alias("start")).crossJoin(F.broadcast(days))
    passed = F.size(F.filter("days", lambda d: d >= F.col("start")))
    return last.select("symbol", "start", F.greatest(F.lit(0), F.lit(n) - passed).alias("days_left"))
