"""Further registered queries: sources, cleaning, bookkeeping, single components of strategies, and serving details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, bookkeeping, conditions, indicators, joins, resample, serving, strategies
from ..schemas import CANDLE_EVENT
from ..sources import driver_tables as t
from ..sources import readers, resampled, sinks, versions
from ..streaming import candles
from . import catalog, sql
from .registry import _r, query, rounded

KEY, OHLCV = catalog.KEY, catalog.OHLCV

# sources


@query(f"WITH {sql.bars('supplier')} SELECT {OHLCV} FROM bars WHERE symbol IN ('1', '2', '3') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def bars_in_range(spark: SparkSession, d: str) -> DataFrame:
    return readers.load_bars(t.bars(spark, d, "supplier"), ["1", "2", "3"], "1996-01-01", "1997-06-30").select(*OHLCV.split(", "))


_MTF = " UNION ALL ".join(f"SELECT {OHLCV}, '{n}d' AS timeframe FROM ({sql.resampled(n)})" for n in (1, 3, 8))


@query(f"WITH {sql.bars()} {_MTF}")
def multi_timeframe_bars(spark: SparkSession, d: str) -> DataFrame:
    return readers.load_multi_timeframe(t.bars(spark, d), ["1d", "3d", "8d", "9x"]).select(*OHLCV.split(", "), "timeframe")


@query(f"WITH {sql.bars('nation')} SELECT {OHLCV}, 3 AS interval FROM ({sql.resampled(3)}) UNION ALL SELECT {OHLCV}, 5 FROM ({sql.resampled(5)})")
def silver_union(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "nation")
    return readers.load_silver({n: resample.resample_calendar(b, n) for n in (3, 5)}).select(*OHLCV.split(", "), "interval")


@query(f"WITH {sql.bars('supplier')} SELECT symbol, max(date) AS latest_date, (SELECT count(*) FROM bars WHERE date = (SELECT max(date) FROM bars)) AS bars_on_last FROM bars GROUP BY symbol")
def latest_dates(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "supplier")
    return readers.latest_date(b, "symbol").crossJoin(F.broadcast(readers.latest_rows(b).agg(F.count(F.lit(1)).alias("bars_on_last"))))


# cleaning


@query(f"WITH {sql.RAW} SELECT CAST(timestamp AS DATE) AS date, symbol, open, high, low, close, volume::DOUBLE AS volume FROM raw")
def canonical_bars(spark: SparkSession, d: str) -> DataFrame:
    return readers.to_double(readers.normalize_bars(t.raw_ohlcv(spark, d)))


@query("SELECT event_type AS symbol, round(value, 4) AS open_price, round(value + 1, 4) AS high_price, CAST(NULL AS DOUBLE) AS low_price, round(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, value - 1), 4) AS close_price, event_id AS volume, epoch_us(ts) // 1000 AS event_ms FROM events")
def vendor_events(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select(
        F.col("event_type").alias("sym"), F.col("value").alias("o"), (F.col("value") + 1).alias("high"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("c"), (F.col("value") - 1).alias("close"),
        F.col("event_id").alias("v"), F.unix_millis(F.col("ts").cast("timestamp")).alias("e"),
    )
    return rounded(readers.normalize_event(e).withColumn("low_price", F.col("low_price").cast("double")), 4)


@query(f"WITH {sql.META} SELECT symbol, name, marketcap, industry, type FROM meta WHERE type IN ('CS', 'ETF', 'PFD') AND market = 'ASIA' AND type = 'ETF'")
def vendor_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = t.symbol_metadata(spark, d).withColumnsRenamed({"symbol": "ticker", "marketcap": "market_cap", "industry": "sic_description"})
    return readers.optional_filter(readers.tradable(readers.map_metadata(m)).where("market = 'ASIA'"), type="ETF").select("symbol", "name", "marketcap", "industry", "type")


@query(f"""WITH {sql.bars()} SELECT symbol, CAST(open AS DECIMAL(10,2)) AS open, CAST(high AS DECIMAL(10,2)) AS high, CAST(low AS DECIMAL(10,2)) AS low,
CAST(close AS DECIMAL(10,2)) AS close, CAST(volume AS BIGINT) AS volume, epoch_ms(CAST(date AS TIMESTAMP)) // 1000 AS seconds FROM bars""")
def vendor_bars(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d).select("symbol", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), (F.unix_timestamp(F.col("date").cast("timestamp")) * 1000).alias("t"))
    out = readers.from_vendor_bar(b)
    return out.select("symbol", "open", "high", "low", "close", "volume", F.unix_timestamp("timestamp").alias("seconds"))


_UNIT = "CASE l_linenumber % 4 WHEN 0 THEN l_linenumber || ' Hours' WHEN 1 THEN l_linenumber || 'min' WHEN 2 THEN l_linenumber || 'minutes' ELSE l_linenumber || 'Day' END"


@query(f"""SELECT replace({_UNIT}, ' ', '') AS name, CASE l_linenumber % 4 WHEN 0 THEN l_linenumber || 'h'
WHEN 3 THEN l_linenumber || 'd' ELSE l_linenumber || 'm' END AS interval, count(*) AS n FROM lineitem GROUP BY ALL""")
def interval_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber").cast("string")
    unit = F.when(F.col("l_linenumber") % 4 == 0, "Hours").when(F.col("l_linenumber") % 4 == 1, "min").when(F.col("l_linenumber") % 4 == 2, "minutes").otherwise("Day")
    named = t.table(spark, d, "lineitem").select(F.concat(k, unit).alias("name"))
    return named.withColumn("interval", readers.normalize_interval(F.col("name"))).groupBy("name", "interval").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql.META} SELECT symbol, '{{\"industry\":\"' || industry || '\",\"marketcap\":' || marketcap || '}}' AS metadata, industry AS flat_industry FROM meta")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    m = readers.with_metadata(t.symbol_metadata(spark, d), industry=F.col("industry"), marketcap=F.col("marketcap"))
    nested = m.select("symbol", "metadata", F.struct(F.col("industry").alias("flat_industry")).alias("alerts"))
    return readers.flatten_alerts(nested)


# table maintenance


@query(f"WITH {sql.bars()} SELECT {OHLCV} FROM bars WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-04-15'")
def gap_window(spark: SparkSession, d: str) -> DataFrame:
    return sinks.recover_gap(t.bars(spark, d), "1997-03-01", "1997-04-15").select(*OHLCV.split(", "))


@query(f"WITH {sql.bars('supplier')} SELECT symbol, date AS scan_date, close FROM bars WHERE date <> DATE '1997-03-03'")
def staging_cleared(spark: SparkSession, d: str) -> DataFrame:
    return sinks.clear_staging(t.bars(spark, d, "supplier").select("symbol", F.col("date").alias("scan_date"), "close"), "1997-03-03")


@query(f"""WITH {catalog._level_sql('1h')} SELECT symbol, '1m' AS interval_type, epoch_ms(ws) // 1000 AS start, epoch_ms(ws) // 1000 + 7 * 86400 AS expire_at
FROM c_1m UNION ALL SELECT symbol, '1h', epoch_ms(ws) // 1000, epoch_ms(ws) // 1000 + 90 * 86400 FROM c_1h""")
def expiry(spark: SparkSession, d: str) -> DataFrame:
    e = t.stream_events(spark, d)
    both = candles.cascade(e, "1m").unionByName(candles.cascade(e, "1h"))
    return sinks.with_ttl(both).select("symbol", "interval_type", F.unix_timestamp("window_start").alias("start"), "expire_at")


@query(f"""WITH {sql.bars()}, r AS ({sql.resampled(5)}) SELECT '5d' AS interval, max(date) AS last_processed_date, count(*) AS record_count,
'completed' AS status, (SELECT count(*) FROM bars WHERE date > (SELECT max(date) FROM r WHERE date < DATE '1997-01-01')) AS left_to_read FROM r
WHERE date < DATE '1997-01-01'""")
def resample_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d)
    done = resample.resample_checkpoint(resample.resample_calendar(b, 5).where("date < '1997-01-01'"), "5d")
    left = resample.resume_from(done, b, "5d").agg(F.count(F.lit(1)).alias("left_to_read"))
    return done.crossJoin(F.broadcast(left))


# bookkeeping


@query(f"""WITH {sql.bars()}, hol AS (SELECT DISTINCT date FROM bars WHERE day(date) = 1), days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders
WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5), c AS (SELECT CAST(g AS DATE) AS date FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01',
INTERVAL 1 DAY) r(g) WHERE dayofweek(g) BETWEEN 1 AND 5 AND CAST(g AS DATE) NOT IN (SELECT date FROM hol)) SELECT date,
lag(date) OVER (ORDER BY date) AS prev, lead(date) OVER (ORDER BY date) AS next FROM c""")
def trading_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays but those first days of a month on which there are bars, as holidays."""
    return bookkeeping.trading_days(spark, "1995-01-01", "1997-12-31", t.bars(spark, d).where("day(date) = 1").select("date").distinct())


@query("""WITH l AS (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS lt FROM events) SELECT event_id, dayofweek(lt) BETWEEN 1 AND 5 AND hour(lt) * 60 + minute(lt) >= 570 AND hour(lt) * 60 + minute(lt) < 960 AND day(lt) <> 2 AS in_session FROM l""")
def session_flags(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    second = e.select(F.from_utc_timestamp("at", "America/New_York").cast("date").alias("date")).where("day(date) = 2").distinct()
    return bookkeeping.with_session(e, "at", second).select("event_id", "in_session")


@query(f"WITH {sql.bars('supplier')} SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date FROM bars WHERE date < DATE '1996-01-01'")
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.archive_stats(t.bars(spark, d, "supplier").where("date < '1996-01-01'"))


_RUN = """SELECT '{0}' AS run, count(*) FILTER (old) AS old_rows, {1} AS archived, {2} AS deleted, CASE WHEN {1} = count(*) FILTER (old) THEN 'success' WHEN {1} > 0 THEN 'partial_success' ELSE 'failed' END AS status,
{1} = {2} AS consistent, count(*) - {2} AS kept FROM o"""
_ODD_DAYS = "count(*) FILTER (old AND day(timestamp) % 2 = 1)"


@query(f"""WITH {sql.RAW}, o AS (SELECT *, CAST(timestamp AS DATE) < DATE '1998-12-31' - INTERVAL 37 MONTHS AS old FROM raw)
{_RUN.format("empty", "count(*) FILTER (old)", "count(*) FILTER (old)")} UNION ALL {_RUN.format("half", _ODD_DAYS, f"CASE WHEN {_ODD_DAYS} > 0 THEN count(*) FILTER (old) ELSE 0 END")} UNION ALL {_RUN.format("full", "0", "0")}""")
def retention_report(spark: SparkSession, d: str) -> DataFrame:
    """Three runs, into an archive that is empty, holds the even days, and holds all, with what they leave."""
    raw = t.raw_ohlcv(spark, d).withColumn("date", F.to_date("timestamp"))
    runs = []
    for name, archive in (("empty", raw.limit(0)), ("half", raw.where("day(date) % 2 = 0")), ("full", raw)):
        kept, _, log = sinks.archive_split(raw, archive, "1998-12-31")
        runs.append(bookkeeping.retention_report(log).select(F.lit(name).alias("run"), "*").crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("kept")))))
    return reduce(DataFrame.unionByName, runs)


@query(f"""WITH {sql.bars('supplier')}, l AS (SELECT symbol, max(date) AS start FROM bars GROUP BY symbol), c AS (SELECT CAST(g AS DATE) AS date
FROM range(TIMESTAMP '1992-01-01', TIMESTAMP '1999-01-01', INTERVAL 1 DAY) r(g) WHERE dayofweek(g) BETWEEN 1 AND 5) SELECT symbol, start, greatest(0,
500 - (SELECT count(*) FROM c WHERE date >= start AND date <= DATE '1998-12-31'))::INT AS days_left FROM l""")
def days_to_complete(spark: SparkSession, d: str) -> DataFrame:
    calendar = bookkeeping.trading_days(spark, "1992-01-01", "1998-12-31")
    return bookkeeping.days_to_complete(t.bars(spark, d, "supplier"), 500, calendar, "1998-12-31")


@query(f"""WITH {sql.bars('nation')}, a AS (SELECT symbol, count(*) AS early FROM bars WHERE date < DATE '1993-01-01' AND symbol < 'J' GROUP BY symbol),
b AS (SELECT symbol, count(*) AS late FROM bars WHERE date > DATE '1997-12-31' AND symbol > 'C' GROUP BY symbol) SELECT symbol, coalesce(early,
0) AS early, coalesce(late, 0) AS late FROM a FULL JOIN b USING (symbol)""")
def full_counts(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "nation")
    early = b.where("date < '1993-01-01' AND symbol < 'J'").groupBy("symbol").agg(F.count(F.lit(1)).alias("early"))
    late = b.where("date > '1997-12-31' AND symbol > 'C'").groupBy("symbol").agg(F.count(F.lit(1)).alias("late"))
    return joins.full_counts(early, late, ["symbol"])


# components of strategies


def _setup(spark: SparkSession, d: str, component: dict) -> DataFrame:
    return conditions.apply_setup(t.bars(spark, d), component).select("symbol", "date", "setup_valid")


@query(f"WITH {sql.bars()} SELECT {KEY}, true AS setup_valid FROM bars")
def setup_none(spark: SparkSession, d: str) -> DataFrame:
    return _setup(spark, d, {"type": "NONE"})


@query(f"WITH {sql.bars()}, {catalog._RSI} SELECT {KEY}, coalesce(rsi_14 >= 40 AND rsi_14 <= 60, false) AS setup_valid FROM rsi")
def setup_rsi_momentum(spark: SparkSession, d: str) -> DataFrame:
    return _setup(spark, d, {"type": "RSI_MOMENTUM", "min": 40, "max": 60})


@query(f"WITH {sql.bars()}, s AS (SELECT *, {sql.rolling('avg', 'close', 50)} AS f, {sql.rolling('avg', 'close', 200)} AS g FROM bars) SELECT {KEY}, coalesce(f < g, false) AS setup_valid FROM s")
def setup_sma_trend(spark: SparkSession, d: str) -> DataFrame:
    return _setup(spark, d, {"type": "SMA_TREND", "direction": "BELOW"})


_MACD = f"{sql.bars()}, {sql.ema('bars', (12, 26))}, m AS (SELECT symbol, date, close, ema_12 - ema_26 AS line FROM e), {sql.ema('m', (9,), 's', 'line')}"


@query(f"WITH RECURSIVE {_MACD} SELECT {KEY}, coalesce(round(line - ema_9, 9) > 0, false) AS setup_valid FROM s WHERE abs(line - ema_9) > 1e-9")
def setup_macd_trend(spark: SparkSession, d: str) -> DataFrame:
    """Bars on which the lines differ by more than rounding."""
    out = conditions.apply_setup(t.bars(spark, d), {"type": "MACD_TREND"})
    return out.where(F.abs(F.col("macd_12_26") - F.col("macd_signal_12_26_9")) > 1e-9).select("symbol", "date", "setup_valid")


@query(f"""WITH {sql.bars()}, s AS (SELECT *, {sql.rolling('avg', 'close', 20)} AS a, {sql.rolling('avg', 'close', 50)} AS b FROM bars), x AS (SELECT *,
lag(a) OVER w AS a1, lag(b) OVER w AS b1 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT {KEY}, coalesce(a > b AND a1 <= b1,
false) AS setup_valid FROM x""")
def setup_threshold_cross(spark: SparkSession, d: str) -> DataFrame:
    return _setup(spark, d, {"type": "INDICATOR_THRESHOLD", "indicator": "SMA", "params": {"period": 20}, "operator": "CROSS_ABOVE", "indicator2": "sma_50"})


@query(f"""WITH {sql.bars()}, s AS (SELECT *, {sql.rolling('avg', 'close', 20)} AS a FROM bars), x AS (SELECT *, lag(close) OVER w AS c1, lag(a) OVER w AS a1
FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT {KEY}, CASE WHEN close < a AND c1 >= a1 THEN 'SELL' ELSE 'HOLD' END AS signal FROM x""")
def trigger_price_indicator(spark: SparkSession, d: str) -> DataFrame:
    return conditions.apply_trigger(t.bars(spark, d), {"type": "PRICE_CROSSOVER", "indicator": "sma_20", "direction": "BELOW"}).select("symbol", "date", "signal")


@query(f"""WITH {sql.bars()}, {catalog._RSI}, x AS (SELECT *, lag(rsi_14) OVER (PARTITION BY symbol ORDER BY date) AS r1 FROM rsi) SELECT {KEY}, CASE
WHEN rsi_14 < 70 AND r1 >= 70 AND close < open THEN 'SELL' ELSE 'HOLD' END AS signal FROM x""")
def reversal_overbought(spark: SparkSession, d: str) -> DataFrame:
    return conditions.apply_trigger(t.bars(spark, d), {"type": "REVERSAL", "reversal": "RSI_OVERBOUGHT"}).select("symbol", "date", "signal")


@query(f"""WITH {sql.bars()}, {catalog._RSI} SELECT {KEY}, coalesce(NOT (rsi_14 > 50) OR close > open, false) AS setup_valid, CASE
WHEN coalesce(NOT (rsi_14 > 50) OR close > open, false) AND rsi_14 <= 45 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN coalesce(volume >= 50,
false) THEN 'SELL' END AS exit_signal FROM rsi""")
def expression_components(spark: SparkSession, d: str) -> DataFrame:
    rsi = {"indicator": "RSI"}
    setup = {"type": "EXPRESSION", "expression": {"op": "OR", "conditions": [{"op": "NOT", "condition": {"op": "GT", "left": rsi, "right": {"const": 50}}}, {"op": "PATTERN", "pattern": "GREEN_CANDLE"}]}}
    trigger = {"type": "EXPRESSION", "signal_value": "SELL", "expression": {"op": "LTE", "left": rsi, "right": {"const": 45}}}
    leave = {"type": "EXPRESSION", "expression": {"op": "GTE", "left": {"price": "volume"}, "right": {"const": 50}}}
    out = conditions.compile_strategy({"components": {"setup": setup, "trigger": trigger, "exit": leave}})(t.bars(spark, d))
    return out.select("symbol", "date", "setup_valid", "signal", "exit_signal")


#: A strategy document in the wire format, with position rules and a rule of its own.
DOCUMENT = {
    "strategy_name": "dip", "timeframe": "1d",
    "components": {
        "setup": {"type": "EXPRESSION", "timeframe": "1d", "expression": {"op": "GT", "left": {"indicator": "SMA", "params": {"period": 20}}, "right": {"indicator": "SMA", "params": {"period": 50}}}},
        "trigger": {"type": "CANDLE_PATTERN", "timeframe": "1d", "pattern": "GREEN_CANDLE"},
        "exit": {"type": "CONDITIONAL_OR_FIXED", "timeframe": "1d", "conditions": [
            {"type": "INDICATOR_CROSS", "indicator": "rsi_14", "direction": "DOWN", "value": 70}, {"type": "STOP_LOSS_PCT", "value": 0.03}, {"type": "TAKE_PROFIT_PCT", "value": 0.06},
        ]},
    },
}


@query(catalog.ORACLES_JSON)
def strategy_document(spark: SparkSession, d: str) -> DataFrame:
    return conditions.run_document(t.bars(spark, d), DOCUMENT).select("symbol", "date", "setup_valid", "signal", "exit_signal")


@query(f"WITH RECURSIVE {catalog._LED} SELECT symbol, trade_no, entry_date, exit_date, reason, round(pnl, 4) AS pnl FROM ledger WHERE run_id = 'tight'")
def document_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The document's own stops reach the ledger."""
    p = conditions.exit_parameters(DOCUMENT["components"]["exit"])
    params = spark.createDataFrame([("document", p["stop_loss"], p["take_profit"], p["trailing_stop"], p["max_days"], p["anchor"], p["anchor_offset"])], backtest.PARAMETERS)
    trades, _ = backtest.backtest(conditions.run_document(t.bars(spark, d, "nation"), DOCUMENT), params)
    return rounded(trades.select("symbol", "trade_no", "entry_date", "exit_date", "reason", "pnl"), 4)


MULTI = {
    "strategy_name": "aligned", "timeframe": "1d",
    "components": {
        "setup": {"type": "EXPRESSION", "timeframe": "5d", "expression": {"op": "GT", "left": {"price": "close"}, "right": {"indicator": "SMA", "params": {"period": 20}}}},
        "trigger": {"type": "EXPRESSION", "timeframe": "3d", "expression": {"op": "CROSS_ABOVE", "left": {"price": "close"}, "right": {"indicator": "SMA", "params": {"period": 10}}}},
        "exit": {"type": "EXPRESSION", "timeframe": "1d", "expression": {"op": "CROSS_BELOW", "left": {"price": "close"}, "right": {"indicator": "SMA", "params": {"period": 50}}}},
    },
}


@query(f"""WITH {sql.bars()}, b5 AS ({sql.resampled(5)}), b3 AS ({sql.resampled(3)}), s5 AS (SELECT *, coalesce(close > {sql.rolling("avg", "close", 20)},
false) AS setup_valid FROM b5), m3 AS (SELECT *, {sql.rolling("avg", "close", 10)} AS m FROM b3),
c3 AS (SELECT *, close > m AND lag(close) OVER w <= lag(m) OVER w AS up FROM m3 WINDOW w AS (PARTITION BY symbol ORDER BY date)), t3 AS (SELECT c3.symbol, c3.date, CASE
WHEN up AND coalesce(s5.setup_valid, false) THEN 'BUY' ELSE 'HOLD' END AS signal FROM c3 ASOF LEFT JOIN s5 ON s5.symbol = c3.symbol AND c3.date >= s5.date),
b1 AS (SELECT *, {sql.rolling("avg", "close", 50)} AS m FROM bars), x1 AS (SELECT *, close < m AND lag(close) OVER w >= lag(m) OVER w AS down FROM b1 WINDOW w AS
(PARTITION BY symbol ORDER BY date)),
a AS (SELECT x1.symbol, x1.date, x1.down, coalesce(s5.setup_valid, false) AS setup_valid FROM x1 ASOF LEFT JOIN s5 ON s5.symbol = x1.symbol AND x1.date >= s5.date)
SELECT a.symbol, a.date, a.setup_valid, coalesce(t3.signal, 'HOLD') AS signal, CASE WHEN a.down THEN 'SELL' END AS exit_signal FROM a LEFT JOIN t3 ON t3.symbol = a.symbol
AND t3.date = a.date""")
def multi_timeframe_strategy(spark: SparkSession, d: str) -> DataFrame:
    return conditions.run_document(t.bars(spark, d), MULTI).select("symbol", "date", "setup_valid", "signal", "exit_signal")


_STACKED = "SELECT symbol, timeframe, date, f > g AS up FROM st"


@query(f"""WITH {sql.bars()}, stacked AS ({_MTF}), st AS (SELECT *, {sql.rolling('avg', 'close', 20, 'symbol, timeframe')} AS f,
{sql.rolling('avg', 'close', 50, 'symbol, timeframe')} AS g FROM stacked) SELECT symbol, timeframe, date, coalesce(f > g, false) AS setup_valid, CASE
WHEN coalesce(f > g, false) AND close > open THEN 'BUY' ELSE 'HOLD' END AS signal FROM st""")
def stacked_strategy(spark: SparkSession, d: str) -> DataFrame:
    """A document over stacked timeframes: each series by itself."""
    out = conditions.compile_strategy(DOCUMENT)(readers.load_multi_timeframe(t.bars(spark, d), ["1d", "3d", "8d"]))
    return out.select("symbol", "timeframe", "date", "setup_valid", "signal")


# the scan


@query(f"WITH {sql.bars('supplier')} SELECT {OHLCV} FROM bars WHERE date BETWEEN (SELECT max(date) FROM bars) - 400 AND (SELECT max(date) FROM bars)")
def scan_window(spark: SparkSession, d: str) -> DataFrame:
    return strategies.scan_window(t.bars(spark, d, "supplier"), days=400).select(*OHLCV.split(", "))


_CROSS = f"{sql.bars('supplier')}, {catalog._GC}, sig AS (SELECT symbol, date, close, CASE WHEN f > g AND f1 <= g1 THEN 'BUY' ELSE 'HOLD' END AS signal FROM x)"


@query(f"WITH {_CROSS} SELECT symbol, max(date) AS date, 'BUY' AS signal FROM sig WHERE signal = 'BUY' GROUP BY symbol")
def latest_signals(spark: SparkSession, d: str) -> DataFrame:
    return strategies.latest_signal(strategies.golden_cross(t.bars(spark, d, "supplier")))


@query(f"WITH {_CROSS} SELECT symbol, date, close FROM sig WHERE signal = 'BUY' AND date = (SELECT max(date) FROM sig WHERE signal = 'BUY')")
def latest_buys(spark: SparkSession, d: str) -> DataFrame:
    out = strategies.golden_cross(t.bars(spark, d, "supplier"))
    last = out.where("signal = 'BUY'").agg(F.max("date").alias("last"))
    until = out.crossJoin(F.broadcast(last)).where(F.col("date") <= F.col("last"))
    return strategies.latest_buys(until).select("symbol", "date", "close")


_BUYS = f"""WITH {_CROSS}, b AS (SELECT symbol, date, 'BUY' AS signal, close AS price, (CASE day(date) % 3 WHEN 0 THEN 1
WHEN 1 THEN 3 ELSE 6 END) / 6.0 AS confidence, true AS setup_valid, 'y' || year(date) AS strategy_name FROM sig WHERE signal = 'BUY')"""


def _buys(spark: SparkSession, d: str) -> DataFrame:
    """All crosses there are, with few different confidences, by year."""
    out = strategies.golden_cross(t.bars(spark, d, "supplier")).where("signal = 'BUY'")
    k = F.dayofmonth("date") % 3
    confidence = F.when(k == 0, 1.0).when(k == 1, 3.0).otherwise(6.0) / 6.0
    return out.select("symbol", "date", "signal", F.col("close").alias("price"), confidence.alias("confidence"), "setup_valid", F.concat(F.lit("y"), F.year("date")).alias("strategy_name"))


@query(f"""{_BUYS} SELECT date AS scan_date, symbol, strategy_name, signal, CAST(price AS DECIMAL(12,4)) AS price,
CAST(confidence AS DECIMAL(5,4)) AS confidence, '{{\"setup_valid\":true,\"strategy_name\":\"' || strategy_name || '\"}}' AS metadata FROM b""")
def staging_rows(spark: SparkSession, d: str) -> DataFrame:
    return strategies.to_staging(_buys(spark, d).withColumn("setup_valid", F.lit(True)))


@query(f"""{_BUYS}, m AS (SELECT symbol, strategy_name, max(confidence) AS confidence FROM b GROUP BY ALL), r AS (SELECT *, dense_rank() OVER
(PARTITION BY strategy_name ORDER BY confidence DESC) AS dense_rank FROM (SELECT DISTINCT symbol, strategy_name, confidence FROM b)),
k AS (SELECT r.* FROM r JOIN m USING (symbol, strategy_name, confidence) WHERE dense_rank <= 2) SELECT symbol, strategy_name, round(confidence::DOUBLE, 6) AS confidence,
dense_rank::INT AS dense_rank, (row_number() OVER (PARTITION BY strategy_name ORDER BY confidence DESC, symbol))::INT AS rank FROM k""")
def rank_picks_ties(spark: SparkSession, d: str) -> DataFrame:
    """Many rows, ties, symbols more than once, two ranks."""
    out = strategies.rank_picks(_buys(spark, d), top_k=2)
    return rounded(out.select("symbol", "strategy_name", "confidence", "dense_rank", "rank"))


# serving


@query(f"WITH {sql.META} SELECT symbol, marketcap, (row_number() OVER (ORDER BY marketcap DESC NULLS LAST, symbol))::INT AS place FROM meta ORDER BY place LIMIT 7 OFFSET 4")
def sorted_page(spark: SparkSession, d: str) -> DataFrame:
    """The fifth to eleventh symbol by market capitalisation, with its place."""
    out = serving.page(serving.order_by(t.symbol_metadata(spark, d), "marketcap:desc"), 7, 4).select("symbol", "marketcap")
    w = strategies.Window.orderBy(F.desc_nulls_last("marketcap"), "symbol")  # seven rows
    return out.withColumn("place", F.row_number().over(w) + 4)


@query(f"WITH {sql.META} SELECT symbol, (type = 'CS')::INT AS type_CS, (type = 'ETF')::INT AS type_ETF, (market = 'ASIA')::INT AS market_ASIA FROM meta")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return serving.one_hot(t.symbol_metadata(spark, d), {"type": ["CS", "ETF"], "market": ["ASIA"]}).select("symbol", "type_CS", "type_ETF", "market_ASIA")


@query(f"WITH {sql.bars('nation')} SELECT {OHLCV} FROM bars WHERE date >= DATE '1998-06-30' - 45")
def last_days(spark: SparkSession, d: str) -> DataFrame:
    return serving.last_days(t.bars(spark, d, "nation"), 45, "1998-06-30").select(*OHLCV.split(", "))


@query(f"WITH {sql.bars('nation')} SELECT date, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM bars WHERE close > open GROUP BY date")
def collected_symbols(spark: SparkSession, d: str) -> DataFrame:
    return serving.collect_symbols(t.bars(spark, d, "nation").where("close > open"), ["date"]).withColumn("symbols", F.concat_ws(",", "symbols"))


# alerts and candles


@query(f"""WITH {catalog._level_sql('15m')} SELECT symbol, epoch_ms(ws) // 1000 AS start, CASE WHEN v > 20 THEN 'high' WHEN v > 15 THEN 'above_avg'
WHEN v < 5 THEN 'low' ELSE 'normal' END AS volume_class, round(100 * (c - vw) / nullif(vw, 0) + 1e-9, 6) AS price_vs_vwap,
round(100 * abs(c - o) / nullif(o, 0) + 1e-9, 6) AS channel_width FROM c_15m""")
def signal_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of every quarter of an hour, with a tenth of the volume as the ratio and close and open as averages."""
    q = candles.cascade(t.stream_events(spark, d), "15m")
    q = q.withColumns({"avg_180m": F.col("close_price"), "avg_2160m": F.col("open_price"), "volume_ratio": F.col("volume") / 10})
    m = F.from_json("metadata", "channel_width double, price_vs_vwap double, volume_class string")
    out = candles.signal_metadata(q).select("symbol", F.unix_timestamp("window_start").alias("start"), m.alias("m")).select("symbol", "start", "m.*")
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("price_vs_vwap", "channel_width")}))


@query(f"""WITH RECURSIVE {catalog._level_sql('1h')}, p AS (SELECT symbol, epoch_ms(ws) // 1000 AS start, row_number() OVER (PARTITION BY symbol ORDER BY ws) AS rn FROM c_1h),
w AS (SELECT symbol, rn, start, start AS last, true AS shown FROM p WHERE rn = 1 UNION ALL SELECT p.symbol, p.rn, p.start,
CASE WHEN p.start > w.last + 5400 THEN p.start ELSE w.last END, p.start > w.last + 5400 FROM w JOIN p ON p.symbol = w.symbol AND p.rn = w.rn + 1)
SELECT symbol, start FROM w WHERE shown""")
def alerts_deduped(spark: SparkSession, d: str) -> DataFrame:
    q = candles.cascade(t.stream_events(spark, d), "1h")
    return candles.dedupe_alerts(q, "90 minutes", keys=("symbol",)).select("symbol", F.unix_timestamp("window_start").alias("start"))


@query(f"""WITH {sql.bars('nation')} SELECT {KEY}, {_r('close', digits=4)},
round(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS v FROM bars
QUALIFY count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5""")
def sma_of_volume(spark: SparkSession, d: str) -> DataFrame:
    """An average of another price has a name of its own."""
    out = indicators.sma(indicators.sma(t.bars(spark, d, "nation"), 5), 5, price="volume")
    return rounded(out.where("sma_5_volume IS NOT NULL").select("symbol", "date", "close", F.col("sma_5_volume").alias("v")), 4)


# tables on disk and streams that are read to their end


def _bronze(spark: SparkSession, d: str) -> str:
    """A gap of six weeks is recovered as bronze: a file for each symbol and day."""
    path, raw = versions.scratch(spark, "bronze"), t.raw_ohlcv(spark, d)
    sinks.write_bronze(sinks.recover_gap(raw.withColumn("date", F.to_date("timestamp")), *GAP), path)
    return path


#: Days of the gap, and the sessions that are read back of it.
GAP, SESSIONS = ("1997-03-01", "1997-04-15"), ("1997-03-07", "1997-03-21", "1997-04-04")
_IN_GAP = f"CAST(timestamp AS DATE) BETWEEN DATE '{GAP[0]}' AND DATE '{GAP[1]}'"


@query(f"WITH {sql.RAW} SELECT symbol, CAST(timestamp AS DATE) AS date, 1 AS files, count(*) AS bars FROM raw WHERE {_IN_GAP} GROUP BY 1, 2")
def bronze_files(spark: SparkSession, d: str) -> DataFrame:
    """The layout: every symbol and day is one file."""
    found = spark.read.schema(BRONZE).parquet(_bronze(spark, d))
    return found.groupBy("symbol", "date").agg(F.countDistinct("_metadata.file_path").alias("files"), F.count(F.lit(1)).alias("bars"))


#: Types of bronze bars and of their folders.
BRONZE = "symbol string, open double, high double, low double, close double, volume double, timestamp timestamp, interval string, date date"


@query(f"WITH {sql.RAW} SELECT symbol, CAST(timestamp AS DATE) AS date, hour(timestamp)::INT AS hour, close, volume FROM raw WHERE {_IN_GAP}")
def bronze_scan(spark: SparkSession, d: str) -> DataFrame:
    """All of bronze, two of its price columns."""
    out = readers.read_bronze(spark, _bronze(spark, d), columns=("symbol", "timestamp", "close", "volume"))
    return out.select("symbol", F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "close", "volume")


@query(f"""WITH {sql.RAW} SELECT symbol, CAST(timestamp AS DATE) AS date, hour(timestamp)::INT AS hour, open, high, low, close, volume, interval FROM raw
WHERE CAST(timestamp AS DATE) IN ({", ".join(f"DATE '{s}'" for s in SESSIONS)})""")
def bronze_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Three sessions of bronze, whose folders alone are listed in the scan."""
    out = readers.read_bronze(spark, _bronze(spark, d), dates=SESSIONS, schema=BRONZE)
    return out.select("symbol", F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "open", "high", "low", "close", "volume", "interval")


@query(f"WITH {sql.META} SELECT * FROM meta")
def metadata_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Metadata in parts that a manifest names."""
    meta, root = t.symbol_metadata(spark, d), versions.scratch(spark, "metadata")
    return readers.read_metadata_manifest(spark, sinks.write_metadata_manifest(meta, root, 40), root).select(*meta.columns)


@query(f"WITH {sql.bars('nation')} SELECT {OHLCV} FROM bars")
def published_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot over an older one; the reader follows the manifest."""
    root, b = versions.scratch(spark, "snapshot"), t.bars(spark, d, "nation")
    sinks.publish_snapshot(b.where("date < '1997-01-01'"), root, "1997-01-01")
    sinks.publish_snapshot(b, root, "1999-01-01")
    return sinks.read_snapshot(spark, root).select(*OHLCV.split(", "))


@query(f"WITH {sql.bars('nation')} SELECT {OHLCV} FROM bars")
def compacted_table(spark: SparkSession, d: str) -> DataFrame:
    """Compaction on disk, half of the days first; symbols of the second half alone are written again."""
    path, b = versions.scratch(spark, "consolidated"), t.bars(spark, d, "nation")
    for part in (b.where("date < '1997-01-01'"), b):
        sinks.compact_table(part, path, part.groupBy("symbol").agg(F.max("date").alias("latest_date")).withColumn("is_current", F.lit(True)))
    return spark.read.parquet(path).select(*OHLCV.split(", "))


@query(f"""WITH {sql.bars()}, r AS ({" UNION ALL ".join(f"SELECT '{n}d' AS interval, * FROM ({sql.resampled(n)})" for n in (3, 5))})
SELECT interval, {OHLCV}, year(date)::INT AS year, month(date)::INT AS month FROM r""")
def resampled_files(spark: SparkSession, d: str) -> DataFrame:
    path = versions.scratch(spark, "resampled")
    out = resample.resample_all(t.bars(spark, d), (3, 5)).withColumn("interval", F.concat(F.col("n").cast("string"), F.lit("d"))).drop("n")
    sinks.write_resampled(out, path)
    return sinks.read_resampled(spark, path).select("interval", *OHLCV.split(", "), "year", "month")


def _row_buckets(n: int) -> str:
    return f"""SELECT '{n}d' AS interval, symbol, min(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
sum(volume) AS volume, count(*) AS bars
FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) // {n} AS k FROM bars) GROUP BY symbol, k"""


_RUNS = f"WITH {sql.bars('nation')}, r AS ({_row_buckets(3)} UNION ALL {_row_buckets(5)})"


def _two_runs(spark: SparkSession, d: str) -> str:
    root, b = versions.scratch(spark, "resampling"), t.bars(spark, d, "nation")
    for part in (b.where("date < '1997-07-01'"), b):
        resampled.run(part, root, (3, 5))
    return root


@query(f"{_RUNS} SELECT interval, {OHLCV} FROM r")
def resumed_resampling(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, the second from where the first stopped, give what one run gives."""
    return resampled.read_buckets(spark, _two_runs(spark, d))


@query(f"{_RUNS} SELECT interval, (SELECT max(date) FROM bars) AS last_processed_date, count(*) FILTER (bars = CASE interval WHEN '3d' THEN 3 ELSE 5 END) AS record_count, 'completed' AS status FROM r GROUP BY interval")
def resampling_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return resampled.read_checkpoint(spark, _two_runs(spark, d))


def _finished(writer) -> None:
    writer.start().awaitTermination()


@query(f"WITH {catalog._level_sql('15m')} SELECT symbol, epoch_ms(ws) // 1000 AS start, epoch_ms(ws) // 1000 + 30 * 86400 AS expire_at, c AS close_price FROM c_15m")
def routed_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles through the router: every one has a table and an expiry."""
    root = versions.scratch(spark, "routed")
    candles.cascade(t.stream_events(spark, d), "15m").write.parquet(f"{root}/in")
    source = spark.read.parquet(f"{root}/in").schema
    _finished(candles.route_candles(spark.readStream.schema(source).parquet(f"{root}/in"), root, f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/candles").select("symbol", F.unix_timestamp("window_start").alias("start"), "expire_at", "close_price")


@query(f"WITH {catalog._level_sql('15m')} SELECT symbol, epoch_ms(max(ws)) // 1000 AS start, arg_max(c, ws) AS close_price, arg_max(n, ws) AS trade_count FROM c_15m GROUP BY symbol")
def upserted_candles(spark: SparkSession, d: str) -> DataFrame:
    """A streamed upsert keeps the last candle of each symbol."""
    root = versions.scratch(spark, "upserted")
    candles.cascade(t.stream_events(spark, d), "15m").write.parquet(f"{root}/in")
    source = spark.read.parquet(f"{root}/in").schema
    _finished(candles.stream_upsert(spark.readStream.schema(source).parquet(f"{root}/in"), f"{root}/table", ["symbol"], f"{root}/checkpoint", "window_start"))
    return spark.read.parquet(f"{root}/table").select("symbol", F.unix_timestamp("window_start").alias("start"), "close_price", "trade_count")


@query(f"WITH {catalog._level_sql('1m')} SELECT symbol, epoch_ms(ws) // 1000 AS start, o AS open_price, h AS high_price, l AS low_price, c AS close_price, v AS volume, n AS trade_count FROM c_1m")
def candles_of_messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON messages, with some that aren't JSON among them, through the stream source."""
    root = versions.scratch(spark, "messages")
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    events = t.stream_events(spark, d)
    lines = events.select(F.to_json(F.struct(*events.columns), exact).alias("value"))
    lines.unionByName(lines.select(F.concat(F.lit("{broken "), "value").alias("value")).where(F.xxhash64("value") % 50 == 0)).write.text(f"{root}/in")
    stream = readers.read_candle_stream(spark, f"{root}/in", "text", f"{CANDLE_EVENT}, event_id long")
    _finished(stream.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True))
    out = candles.candles_1m(spark.read.schema(stream.schema).parquet(f"{root}/events"))
    return out.select("symbol", F.unix_timestamp("window_start").alias("start"), *candles.PRICE, "volume", "trade_count")


#: A document over candles: the state of four hours, the event of one hour, on bars of a quarter.
HOURS = {
    "timeframe": "15m",
    "components": {
        "setup": {"type": "INDICATOR_THRESHOLD", "column": "close", "operator": ">", "value": 50, "timeframe": "4h"},
        "trigger": {"type": "CANDLE_PATTERN", "pattern": "GREEN_CANDLE", "timeframe": "1h"},
        "exit": {"type": "CONDITIONAL_OR_FIXED", "conditions": [{"type": "CONDITIONAL_OR_FIXED", "conditions": [{"type": "INDICATOR_CROSS", "column": "close", "direction": "DOWN", "value": 20}, {"type": "STOP_LOSS_ATR", "value": 2}]}]},
    },
}


@query(f"""WITH {catalog._level_sql('15m')}, q AS (SELECT *, time_bucket(INTERVAL '1 hour', ws) AS h1, time_bucket(INTERVAL '4 hours', ws, TIMESTAMP '1970-01-01') AS h4
FROM c_15m),
s AS (SELECT *, last_value(c) OVER four > 50 AS setup_valid, first_value(o) OVER one AS o1, last_value(c) OVER one AS c1, lag(c) OVER
(PARTITION BY symbol ORDER BY ws) AS before FROM q
  WINDOW one AS (PARTITION BY symbol, h1 ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), four AS (PARTITION BY symbol,
h4 ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT symbol, epoch_ms(ws) // 1000 AS start, setup_valid, CASE WHEN ws = h1 AND c1 > o1 AND setup_valid THEN 'BUY' ELSE 'HOLD' END AS signal, CASE WHEN c < 20
AND before >= 20 THEN 'SELL' END AS exit_signal FROM s""")
def document_over_hours(spark: SparkSession, d: str) -> DataFrame:
    q = candles.cascade(t.stream_events(spark, d), "15m")
    b = q.select("symbol", F.col("window_start").alias("date"), *[F.col(f"{p}_price").alias(p) for p in ("open", "high", "low", "close")], F.col("volume").cast("double").alias("volume"))
    return conditions.run_document(b, HOURS).select("symbol", F.unix_timestamp("date").alias("start"), "setup_valid", "signal", "exit_signal")
