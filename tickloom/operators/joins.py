"""Joins along time (J operators)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_day(df: DataFrame, day: str | Column | DataFrame, name: str = "_day") -> DataFrame:
    """``df`` with a day as column ``name``: a date, a column, or the first column of a table of one row, which is sent to the tasks.

    A day that a table computes is never fetched by the driver, so it is part of the plan.
    """
    if isinstance(day, DataFrame):
        return df.crossJoin(F.broadcast(day.select(F.col(day.columns[0]).cast("date").alias(name))))
    return df.withColumn(name, F.lit(day).cast("date"))


def asof_state(base: DataFrame, higher: DataFrame, cols: Iterable[str], by=("symbol",)) -> DataFrame:
    """The latest state at or before each base bar. Both sides are stacked and the last value is carried on, so no range join grows.

    A column that both sides have is that of ``higher``.
    """
    cols, keys = list(cols), [*by, "date"]
    kept = [c for c in base.columns if c not in keys and c not in cols]
    state_type = higher.select(F.struct(*cols).alias("s")).schema["s"].dataType
    if kept:
        left = base.select(*keys, F.struct(*kept).alias("_base"), F.lit(None).cast(state_type).alias("_state"), F.lit(1).alias("_side"))
    else:
        left = base.select(*keys, F.struct(F.lit(0).alias("_none")).alias("_base"), F.lit(None).cast(state_type).alias("_state"), F.lit(1).alias("_side"))
    right = higher.select(*keys, F.lit(None).cast(left.schema["_base"].dataType).alias("_base"), F.struct(*cols).alias("_state"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("_state", F.last("_state", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*keys, *[F.col(f"_base.`{c}`").alias(c) for c in kept], *[F.col(f"_state.`{c}`").alias(c) for c in cols])


def asof_event(base: DataFrame, higher: DataFrame, col: str, default: str | None = None, by=("symbol",)) -> DataFrame:
    """An event only on its own date, else the default."""
    events = higher.groupBy(*by, "date").agg(F.max(col).alias(col))
    base = base.drop(col)
    return base.join(events, [*by, "date"], "left").withColumn(col, F.coalesce(col, F.lit(default)) if default is not None else F.col(col))


def nth_bar_after(picks: DataFrame, bars: DataFrame, ns: Iterable[int], date: str = "scan_date", last: str | None = None) -> DataFrame:
    """For each pick the close of its n-th bar after ``date``, as columns close_n, and as ``last`` the symbol's last close.

    Each bar carries its next closes along; bars and picks are put in one order by date, and a pick takes those of the
    last bar at or before its date, or counts from the first bar on if there is none. Bars are read once, and there is
    no join over a range of dates.
    """
    ns = sorted(ns)
    w = Window.partitionBy("symbol").orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.struct(*[F.lead("close", n).over(w).alias(f"close_{n}") for n in ns])
    ends = F.struct(*[F.nth_value("close", n).over(whole).alias(f"close_{n}") for n in ns], F.last("close").over(whole).alias("last"))
    right = bars.select("symbol", "date", following.alias("next"), ends.alias("ends"))
    left = picks.select("symbol", F.col(date).alias("date"), F.struct(*picks.columns).alias("pick"))
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = right.select("*", empty(left, "pick"), F.lit(0).alias("side")).unionByName(left.select("*", empty(right, "next"), empty(right, "ends"), F.lit(1).alias("side")))
    by_then = Window.partitionBy("symbol").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"next": F.last("next", ignorenulls=True).over(by_then), "ends": F.first("ends", ignorenulls=True).over(Window.partitionBy("symbol"))}).where("side = 1")
    closes = [F.when(F.col("next").isNotNull(), F.col(f"next.close_{n}")).otherwise(F.col(f"ends.close_{n}")).alias(f"close_{n}") for n in ns]
    return both.select("pick.*", *closes, *([F.col("ends.last").alias(last)] if last else []))


#: Days in a bucket of the interval join.
BUCKET_DAYS = 32


def bars_in_trade(trades: DataFrame, bars: DataFrame, days: int = BUCKET_DAYS) -> DataFrame:
    """The bars after a trade's entry up to its exit.

    An interval join over buckets of time: a trade is listed in each bucket that it touches, and a bar lies in one, so
    both meet by symbol and bucket. A trade meets its own bars and at most those of two buckets' edges, however long the
    symbol's history is, and a symbol with many bars is spread by time.
    """
    (bucket,) = [c for c in ("_bucket", "__bucket", "___bucket") if c not in (*trades.columns, *bars.columns)][:1]
    of = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    t = trades.withColumn(bucket, F.explode(F.sequence(of("entry_date"), F.greatest(of("entry_date"), of("exit_date")))))
    b = bars.withColumnRenamed("symbol", "_symbol").withColumn("_at", of("date"))
    met = t.join(b, (F.col("symbol") == F.col("_symbol")) & (F.col(bucket) == F.col("_at")) & (F.col("date") > F.col("entry_date")) & (F.col("date") <= F.col("exit_date")))
    return met.drop("_symbol", "_at", bucket)


def full_counts(left: DataFrame, right: DataFrame, keys: list[str], fill: int = 0) -> DataFrame:
    """Full outer join with missing counts as 0."""
    return left.join(right, keys, "full").na.fill(fill)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def pivot_by_rank(df: DataFrame, ks: Iterable[int], value: str = "close", by: str = "symbol", order: str = "date") -> DataFrame:
    """The values at places k from the latest on, as columns."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    ks = sorted(ks)
    ranked = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= ks[-1])
    return ranked.groupBy(by).agg(*[F.max(F.when(F.col("_k") == k, F.col(value))).alias(f"{value}_{k}") for k in ks])
