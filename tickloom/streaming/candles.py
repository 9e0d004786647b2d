"""Candle cascade, channel signals and price alerts on streams (M operators).

The candle functions are plain DataFrame functions, so the same code runs on a stream and, for tests and
backfills, on a table. On a stream rows later than the watermark are dropped (M14).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.serving import vwap_agg
from ..sources.readers import valid_bars
from ..sources.sinks import upsert_table, with_ttl
from . import state

#: Levels of the cascade: window, the level below, and how late rows may be.
LEVELS = {"1m": ("1 minute", None, "30 seconds"), "5m": ("5 minutes", "1m", "30 seconds"), "15m": ("15 minutes", "5m", "1 minute"), "30m": ("30 minutes", "15m", "1 minute"), "1h": ("1 hour", "15m", "2 minutes"), "2h": ("2 hours", "1h", "5 minutes"), "4h": ("4 hours", "2h", "10 minutes")}
PRICE = ("open_price", "high_price", "low_price", "close_price")


def candles(events: DataFrame, width: str = "1 minute", delay: str = "30 seconds", order: tuple[str, ...] = ("event_time", "event_id"), name: str = "1m") -> DataFrame:
    """M1: candles of valid raw events, ordered by event time."""
    rows = valid_bars(events)
    order = [c for c in order if c in rows.columns]
    if rows.isStreaming:
        rows = rows.withWatermark("event_time", delay)
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    out = rows.groupBy("symbol", _window(rows, "event_time", width)).agg(*_ohlc(by), F.count(F.lit(1)).alias("trade_count"), vwap_agg().alias("vwap"))
    return _named(out, name, width)


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def _window(rows: DataFrame, at: str, width: str) -> Column:
    """The window of a time, as ``w``: a stream needs Spark's own; on a table its start in microseconds is plain arithmetic, whose code stays small over many levels."""
    if rows.isStreaming:
        return F.window(at, width).alias("w")
    micros = F.lit(1_000_000 * _seconds(width))
    at = F.unix_micros(F.col(at).cast("timestamp"))
    return (at - F.pmod(at, micros)).alias("w")


def _ohlc(order: Column) -> list[Column]:
    return [F.min_by("open_price", order).alias("open_price"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"), F.max_by("close_price", order).alias("close_price"), F.sum("volume").alias("volume")]


def _named(out: DataFrame, name: str, width: str) -> DataFrame:
    start, end = F.col("w.start"), F.col("w.end")
    if not out.isStreaming:
        start, end = F.timestamp_micros("w"), F.timestamp_micros(F.col("w") + 1_000_000 * _seconds(width))
    return out.select("symbol", *PRICE, "volume", "trade_count", "vwap", start.alias("window_start"), end.alias("window_end"), F.lit(name).alias("interval_type"))


def candles_1m(events: DataFrame) -> DataFrame:
    return candles(events)


def roll_up(lower: DataFrame, name: str, compat_end: bool = False) -> DataFrame:
    """M2-M7: candles of a level from those of the level below, by their start (``compat_end``: by their end)."""
    width, _, delay = LEVELS[name]
    at = "window_end" if compat_end else "window_start"
    rows = lower.withWatermark(at, delay) if lower.isStreaming else lower
    out = rows.groupBy("symbol", _window(rows, at, width)).agg(*_ohlc(F.col(at)), F.sum("trade_count").alias("trade_count"), vwap_agg("vwap").alias("vwap"))
    return _named(out, name, width)


def cascade(events: DataFrame, name: str) -> DataFrame:
    """A level from raw events through all levels below it. A stream has one query for each level, with a table between (``run_level``)."""
    below = LEVELS[name][1]
    return candles_1m(events) if below is None else roll_up(cascade(events, below), name)


def run_level(out: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> DataStreamWriter:
    """A query that appends finished candles of a level to a table from which the next level streams."""
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True) if available_now else writer


def channel_signals(candles_15m: DataFrame, least: float = 0.3) -> DataFrame:
    """M8: signals of the channel of the averages over 3 and 36 hours. ``stream_rule`` runs it on a stream."""
    seconds = F.unix_timestamp("window_start")
    w = Window.partitionBy("symbol").orderBy(seconds)
    # Rounded, so that an average of equal prices equals the price.
    mean = lambda c, minutes: F.round(F.avg(c).over(w.rangeBetween(-60 * minutes, 0)), 8)
    out = candles_15m.withColumns({"avg_180m": mean("close_price", 180), "avg_2160m": mean("close_price", 2160), "_v": mean("volume", 300)})
    out = out.withColumn("volume_ratio", F.when(F.col("_v") > 0, F.col("volume") / F.when(F.col("_v") > 0, F.col("_v"))))
    out = out.withColumns({"_c": F.lag("close_price").over(w), "_e": F.lag("avg_180m").over(w)})
    c, e12, e144 = F.col("close_price"), F.col("avg_180m"), F.col("avg_2160m")
    near = lambda x: F.abs(c - x) <= 0.001 * x
    kind = (
        F.when((c > e12) & (e12 > e144) & (F.col("_c") <= F.col("_e")), "breakout_long")
        .when((c < e12) & (e12 < e144) & (F.col("_c") >= F.col("_e")), "breakout_short")
        .when(near(e144) & (e12 > e144), "support")
        .when(near(e12) & (e12 < e144), "resistance")
    )
    raw = 200 * F.abs(c - e12) / F.when(e12 != 0, e12) + F.least(F.lit(0.3), 0.1 * F.coalesce("volume_ratio", F.lit(0.0))) + F.least(F.lit(0.2), 10 * F.abs(e12 - e144) / F.when(e144 != 0, e144))
    out = out.withColumns({"signal": kind, "strength": F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))})
    return out.where(F.col("signal").isNotNull() & (F.col("strength") > least)).drop("_v", "_c", "_e")


def signal_metadata(df: DataFrame) -> DataFrame:
    """M9"""
    width = 100 * F.abs(F.col("avg_180m") - F.col("avg_2160m")) / F.when(F.col("avg_2160m") != 0, F.col("avg_2160m"))
    versus = 100 * (F.col("close_price") - F.col("vwap")) / F.when(F.col("vwap") != 0, F.col("vwap"))
    r = F.col("volume_ratio")
    volume = F.when(r > 2, "high").when(r > 1.5, "above_avg").when(r < 0.5, "low").otherwise("normal")
    return df.withColumn("metadata", F.to_json(F.struct(width.alias("channel_width"), versus.alias("price_vs_vwap"), volume.alias("volume_class"))))


def price_alerts(candles: DataFrame, config: DataFrame) -> DataFrame:
    """Enabled alerts (alert_id, user_id, symbol, operator, threshold, price_type, enabled) that a candle sets off. A stream joins a table here."""
    on = config.where("enabled").withColumnRenamed("symbol", "_symbol")
    both = candles.join(on, F.col("symbol") == F.col("_symbol")).drop("_symbol")
    value = F.col("close_price")
    for kind in ("open", "high", "low"):
        value = F.when(F.col("price_type") == kind, F.col(f"{kind}_price")).otherwise(value)
    op, t = F.col("operator"), F.col("threshold")
    hit = F.when(op == ">", value > t).when(op == ">=", value >= t).when(op == "<", value < t).when(op == "<=", value <= t).when(op == "==", value == t)
    text = F.concat_ws(" ", "symbol", "price_type", "operator", F.col("threshold").cast("string"))
    return both.withColumns({"price": value, "message": text}).where(hit).select("alert_id", "user_id", "symbol", "window_start", "price", "message")


def price_change_alerts(candles: DataFrame, percent: float = 5.0) -> DataFrame:
    """Candles whose close moved by so many percent against the candle before. ``stream_rule`` runs it on a stream."""
    before = F.lag("close_price").over(Window.partitionBy("symbol").orderBy("window_start"))
    move = F.when(before != 0, 100 * (F.col("close_price") - before) / F.when(before != 0, before))
    return candles.withColumn("change_pct", move).where(F.abs("change_pct") >= percent)


def dedupe_alerts(alerts: DataFrame, within: str = "5 minutes", time: str = "window_start", keys: tuple[str, ...] = ("alert_id", "symbol"), delay: str = "1 minute") -> DataFrame:
    """An alert is shown if none of its key was shown within the time before it; the same on a stream and on a table."""
    return state.dedupe(alerts, within, time, keys, delay)


def route_candles(stream: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Candles to a table by interval, with expiry; rows that don't fit go to quarantine and stop nothing.

    Both tables have a folder for each batch number, so a batch that is tried again replaces its own rows.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        ok = F.coalesce(F.col("symbol").isNotNull() & F.col("interval_type").isin(*LEVELS) & (F.col("close_price") >= 0), F.lit(False))
        with_ttl(batch.where(ok)).write.mode("overwrite").partitionBy("interval_type").parquet(f"{root}/candles/batch={epoch}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{root}/quarantine/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_upsert(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None, partition_by: list[str] | None = None) -> DataStreamWriter:
    """Each micro-batch is upserted into a table; only the partitions that it touches are written again.

    Without ``partition_by`` the rows are dealt to ``BUCKETS`` partitions by a hash of the keys. A batch that is tried
    again gives the same table.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        if partition_by:
            upsert_table(batch, path, keys, partition_by, order)
        else:
            upsert_table(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")), path, keys, ["bucket"], order)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


#: Partitions of an upserted table that names none.
BUCKETS = 64


def stream_rule(stream: DataFrame, rule: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, back: str = "36 hours", by: tuple[str, ...] = ("symbol",), time: str = "window_start") -> DataStreamWriter:
    """A rule that looks back over earlier candles of a series, on a stream of finished candles.

    State keeps each series' look-back (``state.with_history``), so a micro-batch reads its own candles and the state of
    their series, never the history. Both are written to ``root/seen``, as the rule reads them more than once; what it
    finds for the batch's own candles goes to ``root/found`` by batch number, so a batch that is tried again replaces
    its own rows.
    """
    keys = [*by, time]

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/seen")
        seen = batch.sparkSession.read.schema(batch.schema).parquet(f"{root}/seen")
        found = rule(seen.drop("fresh"))
        found.join(seen.where("fresh").select(*keys).distinct(), keys, "left_semi").write.mode("overwrite").parquet(f"{root}/found/batch={epoch}")

    rows = state.with_history(stream, back, by, time)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
