"""Every registered market query and its SQL twin. A query reads the given tables through the operators; doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, backtest, bookkeeping, conditions, indicators, joins, patterns, resample, serving, strategies
from ..sources import driver_tables as t
from ..sources import readers, sinks, versions
from ..streaming import candles
from . import sql
from .registry import ORACLES, QUERIES, _r, query, rounded

KEY = "symbol, date"
OHLCV = "symbol, date, open, high, low, close, volume"

# snapshots, bookkeeping, cleaning


@query(f"""WITH {sql.RAW} SELECT CAST(timestamp AS DATE) AS date, symbol, open, high, low, close, volume FROM raw
QUALIFY row_number() OVER (PARTITION BY symbol,
CAST(timestamp AS DATE) ORDER BY timestamp DESC) = 1 AND CAST(timestamp AS DATE) >= (SELECT max(CAST(timestamp AS DATE)) FROM raw) - 1825""")
def snapshot_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return sinks.snapshot_bootstrap(t.raw_ohlcv(spark, d))


@query(ORACLES["snapshot_dedupe"])
def snapshot_incremental(spark: SparkSession, d: str) -> DataFrame:
    """A stale snapshot with one wrong day, mended from that day's bars, equals a fresh one."""
    raw = t.raw_ohlcv(spark, d)
    full = sinks.snapshot_bootstrap(raw)
    last = full.agg(F.max("date").alias("last"))
    stale = joins.with_day(full, last).withColumn("close", F.when(F.col("date") == F.col("_day"), -1.0).otherwise(F.col("close"))).drop("_day")
    return sinks.snapshot_incremental(stale, raw, last)


@query(f"WITH {sql.bars()} SELECT {OHLCV} FROM bars WHERE date >= (SELECT max(date) FROM bars) - 365")
def retention_trim(spark: SparkSession, d: str) -> DataFrame:
    return sinks.trim_retention(t.bars(spark, d), 365)


@query(f"WITH {sql.bars()} SELECT {OHLCV} FROM bars WHERE date >= DATE '2001-06-30' - 760")
def retain_years(spark: SparkSession, d: str) -> DataFrame:
    return sinks.retain_years(t.bars(spark, d), 2, "2001-06-30")


@query(f"""WITH {sql.RAW} SELECT symbol, CASE WHEN hour(timestamp) = 6 THEN 'late' ELSE 'day' END AS kind, CAST(timestamp AS DATE) AS date, CASE
WHEN day(timestamp) % 7 = 0 AND hour(timestamp) = 0 THEN round(close + 1, 6) ELSE round(close, 6) END AS close FROM raw""")
def upsert_bars(spark: SparkSession, d: str) -> DataFrame:
    old = t.raw_ohlcv(spark, d).select("symbol", "timestamp", "interval", "close")
    new = old.where((F.dayofmonth("timestamp") % 7 == 0) & (F.hour("timestamp") == 0)).withColumn("close", F.col("close") + 1)
    out = sinks.upsert(old, new, ["symbol", "timestamp", "interval"])
    return rounded(out.select("symbol", F.when(F.hour("timestamp") == 6, "late").otherwise("day").alias("kind"), F.to_date("timestamp").alias("date"), "close"))


@query(f"""WITH {sql.WM} SELECT DISTINCT {OHLCV} FROM sbars JOIN (SELECT symbol, latest_date FROM wm WHERE is_current) w USING (symbol) WHERE true UNION
SELECT {OHLCV} FROM sbars WHERE date <= DATE '2000-01-01'""")
def compact(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "supplier")
    old = b.where("date <= '2000-01-01'")
    manifest = old.groupBy("symbol").agg(F.max("date").alias("consolidated_to"))
    return sinks.compact(b, old, t.watermark(spark, d), manifest)


@query(f"WITH {sql.RAW}, o AS (SELECT *, CAST(timestamp AS DATE) AS date FROM raw) SELECT symbol, date, count(*) AS n FROM o WHERE date < DATE '2001-01-31' - INTERVAL 37 MONTHS GROUP BY ALL")
def archive_split(spark: SparkSession, d: str) -> DataFrame:
    raw = t.raw_ohlcv(spark, d).withColumn("date", F.to_date("timestamp"))
    return bookkeeping.counts(sinks.archive_split(raw, raw.where("date < '1996-01-01'"), "2001-01-31")[1].where("date < add_months(date'2001-01-31', -37)"), ["symbol", "date"])


@query(f"""WITH {sql.RAW} SELECT count(*) AS old_rows, count(*) FILTER (CAST(timestamp AS DATE) >= DATE '1996-01-01') AS archived, CASE
WHEN count(*) FILTER (CAST(timestamp AS DATE) >= DATE '1996-01-01') > 0 THEN count(*) ELSE 0 END AS deleted, CASE
WHEN count(*) FILTER (CAST(timestamp AS DATE) >= DATE '1996-01-01') = count(*) THEN 'success'
WHEN count(*) FILTER (CAST(timestamp AS DATE) >= DATE '1996-01-01') > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM raw
WHERE CAST(timestamp AS DATE) < DATE '2001-01-31' - INTERVAL 37 MONTHS""")
def archive_log(spark: SparkSession, d: str) -> DataFrame:
    raw = t.raw_ohlcv(spark, d).withColumn("date", F.to_date("timestamp"))
    return sinks.archive_split(raw, raw.where("date < '1996-01-01'"), "2001-01-31")[2]


@query(f"""WITH {sql.bars('supplier', 'sbars')}, f AS (SELECT symbol, date, CAST(volume AS BIGINT) AS size FROM sbars
WHERE date < DATE '2001-01-01' - 365 AND CAST(symbol AS BIGINT) % 3 = 0) SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM f""")
def vacuum_report(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "supplier")
    files = b.select("symbol", "date", F.col("volume").cast("long").alias("size"))
    return sinks.vacuum_report(sinks.vacuum_plan(files, b.where("cast(symbol as long) % 3 = 0"), 365, "2001-01-01"))


@query(f"""WITH {sql.WM} SELECT symbol, latest_date, records_count, is_current AND CAST(symbol AS BIGINT) % 5 <> 0 AS is_current FROM wm UNION ALL
SELECT DISTINCT symbol, DATE '2001-12-31', 1, true FROM sbars WHERE CAST(symbol AS BIGINT) % 5 = 0""")
def watermark_scd2(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.update_watermark(t.watermark(spark, d), t.bars(spark, d, "supplier").where("cast(symbol as long) % 5 = 0"), "2001-12-31")


@query(f"""WITH {sql.WM}, m AS (SELECT max(latest_date) AS x FROM wm WHERE is_current) SELECT CAST(g AS DATE) AS date FROM m, range(CAST(x + 1 AS TIMESTAMP),
CAST(x + 61 AS TIMESTAMP), INTERVAL 1 DAY) r(g) WHERE dayofweek(g) BETWEEN 1 AND 5 ORDER BY 1 DESC LIMIT 30""")
def missing_dates(spark: SparkSession, d: str) -> DataFrame:
    wm = t.watermark(spark, d)
    return bookkeeping.missing_dates(wm, wm.where("is_current").agg(F.date_add(F.max("latest_date"), 60).alias("today")), 17)


@query(f"""WITH {sql.META}, {sql.WM}, a AS (SELECT symbol FROM meta WHERE lower(active) = 'true') SELECT symbol, 'NO_WATERMARK' AS reason FROM a
WHERE symbol NOT IN (SELECT symbol FROM wm WHERE is_current) UNION SELECT symbol, 'LIMITED_HISTORY' FROM a WHERE symbol IN (SELECT symbol FROM wm
GROUP BY symbol HAVING count(*) = 1 AND max(records_count) <= 5)""")
def new_symbols(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.new_symbols(t.symbol_metadata(spark, d), t.watermark(spark, d))


@query(f"""WITH {sql.META}, {sql.bars('supplier', 'sbars')}, c AS (SELECT symbol, count(*) AS bars FROM sbars GROUP BY symbol) SELECT symbol, bars FROM meta
LEFT JOIN c USING (symbol) WHERE lower(active) = 'true' AND coalesce(bars, 0) < 520""")
def needs_backfill(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.needs_backfill(t.symbol_metadata(spark, d), t.bars(spark, d, "supplier"), 520)


@query(f"WITH {sql.META} SELECT * FROM meta WHERE lower(trim(active)) = 'true' AND type IN ('CS', 'ETF') AND marketcap >= 0 AND (industry ILIKE '%an%' OR industry ILIKE '%1%')")
def active_symbols(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.active_symbols(t.symbol_metadata(spark, d), ["CS", "ETF"], 0, None, ["an", "1"])


@query(f"""WITH {sql.META}, {sql.bars('supplier', 'sbars')} SELECT symbol FROM meta WHERE coalesce(lower(active), 'true') = 'true' AND symbol IN (SELECT symbol
FROM sbars WHERE date = (SELECT max(date) FROM sbars))""")
def scannable_symbols(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "supplier")
    return bookkeeping.scannable(t.symbol_metadata(spark, d), b, b.agg(F.max("date").alias("last")))


@query(f"""WITH {sql.bars()} SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS rows, count(DISTINCT symbol) AS symbols,
min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1""")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.distribution(t.bars(spark, d))


@query(f"WITH {sql.RAW} SELECT symbol, CAST(timestamp AS DATE) AS date, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.duplicates(t.raw_ohlcv(spark, d).withColumn("date", F.to_date("timestamp")), ["symbol", "date"])


@query(f"WITH {sql.bars('supplier')} SELECT symbol, count(*) AS n, round(avg(close), 6) AS mean, min(close) AS least, max(close) AS greatest FROM bars GROUP BY symbol")
def symbol_stats(spark: SparkSession, d: str) -> DataFrame:
    out = bookkeeping.stats(t.bars(spark, d, "supplier"))
    return out.withColumn("mean", F.round("mean", 6))


@query(f"WITH {sql.bars()} SELECT max(date) AS max_date, max(date) < DATE '2010-01-01' AS stale FROM bars")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.freshness(t.bars(spark, d), "2010-01-01")


@query(f"WITH {sql.EVENTS} SELECT symbol, event_id, p AS close_price, volume FROM ok")
def valid_bars(spark: SparkSession, d: str) -> DataFrame:
    return readers.valid_bars(t.stream_events(spark, d)).select("symbol", "event_id", "close_price", "volume")


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k, s = F.col("event_id") % 4, F.unix_timestamp("ts")
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, (s * 1000).cast("string")).when(k == 2, s.cast("string")).otherwise("soon")
    return e.select("event_id", F.unix_timestamp(readers.parse_ts(text)).alias("seconds"))


@query("SELECT upper(trim(event_type)) AS symbol, regexp_matches(upper(trim(event_type)), '^[A-Z]{1,10}$') AND value >= 0 AS fits, count(*) AS n FROM events GROUP BY ALL")
def conforming_events(spark: SparkSession, d: str) -> DataFrame:
    e = t.stream_events(spark, d).withColumn("symbol", readers.norm_symbol(F.col("symbol")))
    good, bad = readers.conforms(e)
    both = good.withColumn("fits", F.lit(True)).unionByName(bad.withColumn("fits", F.lit(False)))
    return bookkeeping.counts(both, ["symbol", "fits"])


# resampling


def _calendar(n: int) -> None:
    @query(f"WITH {sql.bars()} {sql.resampled(n)}", name=f"resample_calendar_{n}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return resample.resample_calendar(t.bars(spark, d), n)


for _n in (3, 5):
    _calendar(_n)


@query(f"WITH {sql.bars()} " + " UNION ALL ".join(f"SELECT {n} AS n, * FROM ({sql.resampled(n)})" for n in (3, 5, 8, 13, 21, 34)))
def resample_all(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample_all(t.bars(spark, d), (3, 5, 8, 13, 21, 34))


def _rows_sql(after: str = "") -> str:
    return f"""WITH {sql.bars('nation')}, p AS (SELECT *, CAST(floor((dense_rank() OVER (PARTITION BY symbol ORDER BY date) - 1) / 3) AS BIGINT) AS g FROM bars)
SELECT symbol, min(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
sum(volume) AS volume FROM p GROUP BY symbol, g {after}"""


@query(_rows_sql())
def resample_rows_3(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample_rows(t.bars(spark, d, "nation"), 3)


@query(_rows_sql())
def resample_incremental(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "nation")
    done = resample.resample_rows(b, 3, by="row").where("date < '2000-01-01'")
    return resample.resample_incremental(done, b, 3).select("symbol", "date", "open", "high", "low", "close", "volume")


# indicators


@query(f"""WITH {sql.bars('supplier')}, x AS (SELECT {KEY}, {sql.rolling('avg', 'close', 20)} AS sma_20, {sql.rolling('avg', 'close', 50)} AS sma_50,
{sql.rolling('avg', 'close', 200)} AS sma_200 FROM bars) SELECT {KEY}, {_r('sma_20', 'sma_50', 'sma_200')} FROM x""")
def sma(spark: SparkSession, d: str) -> DataFrame:
    out = t.bars(spark, d, "supplier")
    for p in (20, 50, 200):
        out = indicators.sma(out, p)
    return rounded(out.select("symbol", "date", "sma_20", "sma_50", "sma_200"))


@query(f"WITH RECURSIVE {sql.bars()}, {sql.ema('bars', (8, 13, 144, 169))} SELECT {KEY}, {_r('ema_8', 'ema_13', 'ema_144', 'ema_169', digits=4)} FROM e")
def ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.ema(t.bars(spark, d), (8, 13, 144, 169)).select("symbol", "date", "ema_8", "ema_13", "ema_144", "ema_169"), 4)


_ADJ = f"""WITH RECURSIVE {sql.bars()}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
e AS (SELECT symbol, date, rn, {", ".join(f"close AS n{p}, 1.0::DOUBLE AS w{p}" for p in (13, 21))} FROM o WHERE rn = 1 UNION ALL
SELECT o.symbol, o.date, o.rn, {", ".join(f"o.close + (1 - 2.0 / {p + 1}) * e.n{p}, 1 + (1 - 2.0 / {p + 1}) * e.w{p}" for p in (13, 21))} FROM e JOIN o ON o.symbol = e.symbol
AND o.rn = e.rn + 1)
SELECT symbol, date, round(n13 / w13, 4) AS ema_adj_13, round(n21 / w21, 4) AS ema_adj_21, round(n13 / w13 - n21 / w21, 4) AS macd_fast FROM e"""


@query(_ADJ)
def ema_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.ema_adjusted(t.bars(spark, d), (13, 21)).select("symbol", "date", "ema_adj_13", "ema_adj_21", "macd_fast"), 4)


_RSI = f"""y AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS dd FROM bars),
z AS (SELECT *, greatest(dd, 0) AS gg, greatest(-dd, 0) AS ll FROM y),
g AS (SELECT *, {sql.rolling('avg', 'gg', 14)} AS g, {sql.rolling('avg', 'll', 14)} AS l FROM z),
rsi AS (SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 WHEN g = 0 THEN 'NaN'::DOUBLE END AS rsi_14 FROM g)"""


@query(f"WITH {sql.bars()}, {_RSI} SELECT {KEY}, round(rsi_14, 6) AS rsi_14 FROM rsi")
def rsi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.rsi(t.bars(spark, d)).select("symbol", "date", "rsi_14"))


@query(f"""WITH RECURSIVE {sql.bars()}, {sql.ema('bars', (12, 26))}, m AS (SELECT symbol, date, ema_12 - ema_26 AS line FROM e),
{sql.ema('m', (9,), 's', 'line')} SELECT symbol, date, round(line, 4) AS macd_12_26, round(ema_9, 4) AS macd_signal_12_26_9, round(line - ema_9, 4) AS macd_hist_12_26_9 FROM s""")
def macd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.macd(t.bars(spark, d)).select("symbol", "date", "macd_12_26", "macd_signal_12_26_9", "macd_hist_12_26_9"), 4)


@query(f"""WITH {sql.bars()}, x AS (SELECT {KEY}, {sql.rolling('avg', 'close', 20)} AS m, {sql.rolling('stddev_samp', 'close', 20)} AS s FROM bars)
SELECT {KEY}, round(m, 4) AS bb_middle_20_2, round(m + 2 * s, 4) AS bb_upper_20_2, round(m - 2 * s, 4) AS bb_lower_20_2 FROM x""")
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.bollinger(t.bars(spark, d)).select("symbol", "date", "bb_middle_20_2", "bb_upper_20_2", "bb_lower_20_2"), 4)


@query(f"""WITH {sql.bars()}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars), x AS (SELECT *, greatest(high - low,
abs(high - pc), abs(low - pc)) AS tr FROM p), y AS (SELECT {KEY}, {sql.rolling('avg', 'tr', 14)} AS atr_14 FROM x) SELECT {KEY}, {_r('atr_14')} FROM y""")
def atr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.atr(t.bars(spark, d)).select("symbol", "date", "atr_14"))


@query(f"""WITH {sql.bars()}, x AS (SELECT *, {sql.rolling('min', 'low', 14)} AS lo, {sql.rolling('max', 'high', 14)} AS hi FROM bars), y AS (SELECT *, CASE
WHEN hi - lo > 0 THEN 100 * (close - lo) / (hi - lo) WHEN hi - lo = 0 THEN 'NaN'::DOUBLE END AS k FROM x), z AS (SELECT {KEY}, k AS stoch_k_14_3,
{sql.rolling('avg', 'k', 3)} AS stoch_d_14_3 FROM y) SELECT {KEY}, {_r('stoch_k_14_3', 'stoch_d_14_3')} FROM z""")
def stochastic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.stochastic(t.bars(spark, d)).select("symbol", "date", "stoch_k_14_3", "stoch_d_14_3"))


@query(f"""WITH {sql.bars()}, x AS (SELECT *, {sql.rolling('avg', 'volume', 20, shift=1)} AS m, {sql.rolling('max', 'close', 20)} AS close_max_20 FROM bars)
SELECT {KEY}, round(m, 6) AS volume_mean_20, close_max_20, coalesce(volume >= 1.5 * m, false) AS setup_valid FROM x""")
def volume_trend(spark: SparkSession, d: str) -> DataFrame:
    out = conditions.apply_setup(t.bars(spark, d), {"type": "VOLUME_TREND", "multiplier": 1.5})
    return rounded(indicators.rolling_high_close(out).select("symbol", "date", "volume_mean_20", "close_max_20", "setup_valid"))


_AREA = f"""WITH {sql.bars()}, c AS (SELECT {KEY}, list(close) OVER w AS cs, count(*) OVER w AS n FROM bars WINDOW w AS
(PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CASE WHEN list_max(cs) = list_min(cs) THEN list_min(cs) - 0.5 ELSE list_min(cs) END AS lo, CASE
WHEN list_max(cs) = list_min(cs) THEN list_max(cs) + 0.5 ELSE list_max(cs) END AS hi FROM c WHERE n = 30),
b AS (SELECT *, (hi - lo) / 20 AS w FROM l), u AS (SELECT symbol, date, lo, w, least(19, CAST(floor((x - lo) / w) AS INTEGER)) AS bin FROM (SELECT *, unnest(cs) AS x FROM b)),
k AS (SELECT symbol, date, lo, w, bin, count(*) AS n FROM u GROUP BY ALL),
m AS (SELECT symbol, date, any_value(lo) AS lo, any_value(w) AS w, min(bin) FILTER (n = mx) AS main FROM (SELECT *, max(n) OVER (PARTITION BY symbol, date) AS mx FROM k)
GROUP BY symbol, date),
f AS (SELECT m.symbol, m.date, i, coalesce(k.n, 0) AS n FROM m CROSS JOIN range(20) r(i) LEFT JOIN k ON k.symbol = m.symbol AND k.date = m.date AND k.bin = i WHERE i > main),
s AS (SELECT symbol, date, min(i) FILTER (n = mx) AS second FROM (SELECT *, max(n) OVER (PARTITION BY symbol, date) AS mx FROM f) GROUP BY symbol, date),
a AS (SELECT symbol, date, lo, w, main, coalesce(second, main) AS second FROM m LEFT JOIN s USING (symbol, date))
SELECT symbol, date, round(lo + w * main, 6) AS area_main_low, round(lo + w * (main + 1), 6) AS area_main_high, round(lo + w * second, 6) AS area_second_low, round(lo + w *
(second + 1), 6) AS area_second_high FROM bars LEFT JOIN a USING (symbol, date)"""


@query(_AREA)
def density_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.density_area(t.bars(spark, d)).select("symbol", "date", "area_main_low", "area_main_high", "area_second_low", "area_second_high"))


_FIB = [f"fib_{str(r).replace('.', '_')}" for r in indicators.FIB]


@query(f"WITH {sql.bars()}, x AS (SELECT {KEY}, {sql.rolling('min', 'low', 30, shift=1)} AS lo, {sql.rolling('max', 'high', 30, shift=1)} AS hi FROM bars) SELECT {KEY}, " + ", ".join(f"round(lo + {r} * (hi - lo), 4) AS {n}" for r, n in zip(indicators.FIB, _FIB, strict=True)) + " FROM x")
def fib_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.fib_levels(t.bars(spark, d)).select("symbol", "date", *_FIB), 4)


@query(f"""WITH {sql.bars('nation', full=True)} SELECT {KEY}, round(close / lag(close) OVER w - 1, 6) AS pct_change_1, round(10000 * (close / first_value(close) OVER w),
4) AS growth FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def pct_change(spark: SparkSession, d: str) -> DataFrame:
    out = indicators.growth_curve(indicators.pct_change(t.bars(spark, d, "nation", full=True)))
    return out.select("symbol", "date", F.round("pct_change_1", 6).alias("pct_change_1"), F.round("growth", 4).alias("growth"))


_BUNDLE = f"""WITH RECURSIVE {sql.bars("nation", full=True)}, {_RSI},
q AS (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc, high, low FROM bars),
w0 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, {sql.rolling("min", "low", 14)} AS lo, {sql.rolling("max", "high", 14)} AS hi FROM q),
w1 AS (SELECT *, CASE WHEN hi - lo > 0 THEN 100 * (close - lo) / (hi - lo) WHEN hi - lo = 0 THEN 'NaN'::DOUBLE END AS k FROM w0),
roll AS (SELECT symbol, date, {", ".join(f"{sql.rolling('avg', 'close', n)} AS sma_{n}" for n in (20, 50, 200))}, {sql.rolling("stddev_samp", "close", 20)} AS sd, {sql.rolling("avg", "tr", 14)} AS atr_14, k AS stoch_k_14_3, {sql.rolling("avg", "k", 3)} AS stoch_d_14_3 FROM w1),
{sql.ema("bars", (*indicators.EMAS, 12, 26))}, m AS (SELECT symbol, date, ema_12 - ema_26 AS line FROM e),
{sql.ema("m", (9,), "s", "line")}
SELECT symbol, date, {_r("open", "high", "low", "close", "volume", digits=4)}, {_r("sma_20", "sma_50", "rsi_14", digits=4)}, round(sma_200 + 1e-7, 4) AS sma_200, round(sma_20,
4) AS bb_middle_20_2, round(sma_20 + 2 * sd, 4) AS bb_upper_20_2,
round(sma_20 - 2 * sd, 4) AS bb_lower_20_2, {_r("atr_14", "stoch_k_14_3", "stoch_d_14_3", *[f"ema_{p}" for p in indicators.EMAS], digits=4)}, round(s.line, 4) AS macd_12_26,
round(s.ema_9, 4) AS macd_signal_12_26_9,
round(s.line - s.ema_9, 4) AS macd_hist_12_26_9 FROM e JOIN roll USING (symbol, date) JOIN (SELECT symbol, date, rsi_14 FROM rsi) USING (symbol, date) JOIN s USING (symbol,
date)"""


@query(_BUNDLE)
def all_indicators(spark: SparkSession, d: str) -> DataFrame:
    # A mean of 200 prices in cents may lie just between two roundings, so both sides are nudged.
    out = indicators.all_indicators(t.bars(spark, d, "nation", full=True))
    return rounded(out.withColumn("sma_200", F.col("sma_200") + 1e-7), 4)


# patterns and conditions

_PAT = f"""{sql.bars()}, l AS (SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2 FROM bars WINDOW w AS
(PARTITION BY symbol ORDER BY date)),
q AS (SELECT *, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS up, least(open, close) - low AS dn, abs(c1 - o1) AS b1, avg(abs(c1 - o1)) OVER
(PARTITION BY symbol) AS mb FROM l)"""


@query(f"""WITH {_PAT} SELECT {KEY}, c1 < o1 AND close > open AND open < c1 AND close > o1 AS engulfing_bullish, c1 > o1 AND close < open AND open > c1
AND close < o1 AS engulfing_bearish,
body <= 0.3 * span AND dn >= 2 * body AND up <= 0.5 * body AS hammer, body <= 0.3 * span AND up >= 2 * body AND dn <= 0.5 * body AS shooting_star, body <= 0.1 * span AS doji,
c2 < o2 AND o1 < c2 AND b1 <= 0.5 * mb AND close > open AND close > (o2 + c2) / 2 AS morning_star, c2 > o2 AND o1 > c2 AND b1 <= 0.5 * mb AND close < open AND close <
(o2 + c2) / 2 AS evening_star,
close > open AS green_candle, close < open AS red_candle, close > open AND open < c1 AND close > o1 AS engulfing_legacy_bullish FROM q""", name="patterns")
def all_patterns(spark: SparkSession, d: str) -> DataFrame:
    out = patterns.engulfing_legacy(patterns.all_patterns(t.bars(spark, d)), "bullish")
    return out.select("symbol", "date", *patterns.NAMES, "engulfing_legacy_bullish")


TREE = {"op": "AND", "children": [
    {"op": "OR", "children": [{"op": "GT", "left": {"type": "indicator", "name": "sma", "params": {"period": 20}}, "right": {"type": "indicator", "name": "sma", "params": {"period": 50}}}, {"op": "PATTERN", "name": "hammer"}]},
    {"op": "NOT", "children": [{"op": "LT", "left": {"type": "price", "field": "close"}, "right": {"type": "const", "value": 1000}}]},
    {"op": "CROSS_ABOVE", "left": {"type": "price", "field": "close"}, "right": {"type": "indicator", "name": "sma", "params": {"period": 20}}},
]}


@query(f"""WITH {_PAT}, s AS (SELECT *, {sql.rolling('avg', 'close', 20)} AS a, {sql.rolling('avg', 'close', 50)} AS b FROM q), x AS (SELECT *,
lag(a) OVER (PARTITION BY symbol ORDER BY date) AS a1 FROM s) SELECT {KEY},
(a > b OR (body <= 0.3 * span AND dn >= 2 * body AND up <= 0.5 * body)) AND NOT close < 1000 AND (close > a AND c1 <= a1) AS fits FROM x""")
def expr_tree(spark: SparkSession, d: str) -> DataFrame:
    return conditions.evaluate(t.bars(spark, d), TREE, "fits").select("symbol", "date", "fits")


@query(f"WITH {sql.bars()}, {_RSI} SELECT {KEY}, coalesce(rsi_14 > 60, false) AS setup_valid FROM rsi")
def indicator_threshold(spark: SparkSession, d: str) -> DataFrame:
    return conditions.apply_setup(t.bars(spark, d), {"type": "INDICATOR_THRESHOLD", "indicator": "rsi", "operator": ">", "value": 60}).select("symbol", "date", "setup_valid")


@query(f"""WITH {sql.bars()}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars) SELECT {KEY}, CASE
WHEN close > 1500 AND pc <= 1500 THEN 'BUY' ELSE 'HOLD' END AS signal FROM p""")
def price_crossover(spark: SparkSession, d: str) -> DataFrame:
    return conditions.apply_trigger(t.bars(spark, d), {"type": "PRICE_CROSSOVER", "level": 1500, "direction": "ABOVE"}).select("symbol", "date", "signal")


_GC = f"""s AS (SELECT *, {sql.rolling('avg', 'close', 50)} AS f, {sql.rolling('avg', 'close', 200)} AS g, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
x AS (SELECT *, lag(f) OVER w AS f1, lag(g) OVER w AS g1 FROM s WHERE n >= 200 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query(f"WITH {sql.bars()}, {_GC} SELECT {KEY}, CASE WHEN f < g AND f1 >= g1 THEN 'SELL' ELSE 'HOLD' END AS signal FROM x")
def indicator_crossover(spark: SparkSession, d: str) -> DataFrame:
    out = indicators.sma(indicators.sma(t.bars(spark, d), 50), 200)
    return conditions.apply_trigger(out, {"type": "INDICATOR_CROSSOVER", "fast": "sma_50", "slow": "sma_200", "direction": "DEATH_CROSS"}).select("symbol", "date", "signal")


@query(f"WITH {sql.bars()}, s AS (SELECT *, {sql.rolling('avg', 'close', 20)} + 2 * {sql.rolling('stddev_samp', 'close', 20).replace('CASE', '(CASE').replace('END', 'END)')} AS u FROM bars), x AS (SELECT *, lag(close) OVER w AS c1, lag(u) OVER w AS u1 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT {KEY}, CASE WHEN close > u AND c1 <= u1 THEN 'BUY' ELSE 'HOLD' END AS signal FROM x")
def breakout(spark: SparkSession, d: str) -> DataFrame:
    return conditions.apply_trigger(t.bars(spark, d), {"type": "BREAKOUT"}).select("symbol", "date", "signal")


@query(f"""WITH {sql.bars()}, {_RSI}, x AS (SELECT *, lag(rsi_14) OVER (PARTITION BY symbol ORDER BY date) AS r1 FROM rsi) SELECT {KEY}, CASE
WHEN rsi_14 > 30 AND r1 <= 30 AND close > open THEN 'BUY' ELSE 'HOLD' END AS signal FROM x""")
def reversal(spark: SparkSession, d: str) -> DataFrame:
    return conditions.apply_trigger(t.bars(spark, d), {"type": "REVERSAL", "reversal": "RSI_OVERSOLD"}).select("symbol", "date", "signal")


@query(f"""WITH {sql.bars()}, x AS (SELECT *, close > open AS buy, {sql.rolling('max', 'close', 20)} AS trailing_base FROM bars) SELECT {KEY}, round(CASE
WHEN buy THEN close * 0.95 END, 6) AS stop_loss_price, round(CASE WHEN buy THEN close * 1.1 END, 6) AS take_profit_price, trailing_base FROM x""")
def exit_prices(spark: SparkSession, d: str) -> DataFrame:
    out = conditions.apply_trigger(t.bars(spark, d), {"type": "CANDLE_PATTERN", "pattern": "green_candle"})
    return rounded(conditions.exit_prices(out).select("symbol", "date", "stop_loss_price", "take_profit_price", "trailing_base"))


CONFIG = {"strategy_name": "dip", "components": {
    "setup": {"type": "SMA_TREND", "fast": 20, "slow": 50, "direction": "ABOVE"},
    "trigger": {"type": "CANDLE_PATTERN", "pattern": "green_candle"},
    "exit": {"leaves": [{"type": "INDICATOR_CROSS", "indicator": "rsi", "value": 70, "direction": "DOWN"}, {"type": "STOP_LOSS", "pct": 0.05}, {"type": "TIME_BASED", "max_days": 30}]},
}}


ORACLES_JSON = f"""WITH {sql.bars()}, {_RSI}, s AS (SELECT *, {sql.rolling('avg', 'close', 20)} AS a, {sql.rolling('avg', 'close', 50)} AS b FROM rsi), x AS (SELECT *,
lag(rsi_14) OVER (PARTITION BY symbol ORDER BY date) AS r1 FROM s) SELECT {KEY}, coalesce(a > b, false) AS setup_valid, CASE WHEN coalesce(a > b,
false) AND close > open THEN 'BUY' ELSE 'HOLD' END AS signal, CASE WHEN rsi_14 < 70 AND r1 >= 70 THEN 'SELL' END AS exit_signal FROM x"""


@query(ORACLES_JSON)
def json_strategy(spark: SparkSession, d: str) -> DataFrame:
    return conditions.compile_strategy(CONFIG)(t.bars(spark, d)).select("symbol", "date", "setup_valid", "signal", "exit_signal")


# strategies and the scan


@query(f"""WITH {sql.bars('supplier')}, {_GC} SELECT {KEY}, coalesce(f > g, false) AS setup_valid, CASE
WHEN f > g AND f1 <= g1 THEN 'BUY' ELSE 'HOLD' END AS signal, CASE WHEN f < g AND f1 >= g1 THEN 'SELL' END AS exit_signal FROM x""")
def golden_cross(spark: SparkSession, d: str) -> DataFrame:
    return strategies.golden_cross(t.bars(spark, d, "supplier")).select("symbol", "date", "setup_valid", "signal", "exit_signal")


_VEL = f"""{sql.bars()}, {sql.ema('bars', (8, 13, 144, 169))}, v AS (SELECT *, least(ema_8, ema_13) AS smin, greatest(ema_8, ema_13) AS smax, least(ema_144, ema_169) AS lmin,
greatest(ema_144, ema_169) AS lmax FROM e),
vel AS (SELECT *, CASE WHEN close > open AND close > smax AND close > lmax AND smin > lmax THEN 'velocity_maintained' WHEN close < ema_13
AND close > ema_169 THEN 'velocity_weak' WHEN close < ema_13 AND close < ema_169 THEN 'velocity_loss' ELSE 'velocity_negotiating' END AS velocity FROM v)"""


@query(f"WITH RECURSIVE {_VEL} SELECT {KEY}, velocity FROM vel")
def velocity_status(spark: SparkSession, d: str) -> DataFrame:
    return strategies.velocity_status(t.bars(spark, d)).select("symbol", "date", "velocity")


def _mom(kind: str, n: int) -> str:
    return f"coalesce(max(CASE WHEN raw = '{kind}' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)"


_MOM = f"""{_VEL}, cnt AS (SELECT *, {sql.rolling('sum', "(velocity <> 'velocity_maintained')::INT", 28)} AS nb, {sql.rolling('sum', "(velocity = 'velocity_maintained')::INT", 28)} AS ng FROM vel),
rawm AS (SELECT *, CASE WHEN nb > ng AND lmax <= smax AND smax < open AND open < close THEN 'accelerated' WHEN nb > ng AND close < smin AND smin <= lmin THEN 'decelerated'
END AS raw FROM cnt),
mom AS (SELECT *, CASE WHEN raw = 'accelerated' AND {_mom('accelerated', 30)} = 0 THEN raw WHEN raw = 'decelerated' AND {_mom('decelerated', 30)} = 0 THEN raw END AS momentum
FROM rawm)"""


@query(f"WITH RECURSIVE {_MOM} SELECT {KEY}, raw AS raw_momentum, momentum FROM mom")
def momentum_signal(spark: SparkSession, d: str) -> DataFrame:
    return strategies.momentum_signal(t.bars(spark, d)).select("symbol", "date", "raw_momentum", "momentum")


@query(f"""WITH RECURSIVE {_MOM}, s AS (SELECT *, count(*) OVER (PARTITION BY symbol) >= 169 AND (coalesce(momentum = 'accelerated',
false) OR velocity = 'velocity_maintained') AS setup_valid FROM mom) SELECT {KEY}, setup_valid, CASE
WHEN setup_valid AND coalesce(momentum = 'accelerated', false) AND open < close THEN 'BUY' ELSE 'HOLD' END AS signal, CASE
WHEN velocity = 'velocity_loss' THEN 'SELL' END AS exit_signal FROM s""")
def channel_strategy(spark: SparkSession, d: str) -> DataFrame:
    return strategies.channel_strategy(t.bars(spark, d)).select("symbol", "date", "setup_valid", "signal", "exit_signal")


def _score_sql(by: str) -> str:
    part = lambda n, src: f"""g{n}_s AS (SELECT symbol, date, close, {sql.rolling('avg', 'close', 50)} AS f, {sql.rolling('avg', 'close', 200)} AS g, count(*) OVER
(PARTITION BY symbol) AS n FROM {src}),
g{n}_x AS (SELECT *, lag(f) OVER w AS f1, lag(g) OVER w AS g1 FROM g{n}_s WHERE n >= 200 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g{n} AS (SELECT symbol, date, close FROM g{n}_x WHERE f > g AND f1 <= g1)"""  # noqa: E731
    return f"""WITH {sql.bars(by)}, {part(1, "bars")}, b3 AS ({sql.resampled(3)}), {part(3, "b3")}, b5 AS ({sql.resampled(5)}), {part(5, "b5")},
f3 AS (SELECT symbol, min(date) AS d3 FROM g3 GROUP BY symbol), f5 AS (SELECT symbol, min(date) AS d5 FROM g5 GROUP BY symbol),
sc AS (SELECT symbol, date, 'BUY' AS signal, close AS price, (1 + 2 * coalesce(d3 <= date, false)::INT + 3 * coalesce(d5 <= date, false)::INT) / 6.0 AS confidence,
true AS setup_valid, true AS trigger_met,
'golden_cross' AS strategy_name FROM g1 LEFT JOIN f3 USING (symbol) LEFT JOIN f5 USING (symbol))"""


_SCORED = "symbol, date, signal, price, round(confidence::DOUBLE, 6) AS confidence, setup_valid, trigger_met, strategy_name"


@query(f"{_score_sql('nation')} SELECT {_SCORED} FROM sc")
def score_all_dates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strategies.score_all_dates(t.bars(spark, d, "nation"), strategies.golden_cross))


def _scan_sql(by: str) -> str:
    """A scan on the last date with a BUY: bars are cut there before they are made wider, and five signals are looked back on."""
    part = lambda n, src: f"""g{n}_s AS (SELECT symbol, date, close, {sql.rolling('avg', 'close', 50)} AS f, {sql.rolling('avg', 'close', 200)} AS g, count(*) OVER
(PARTITION BY symbol) AS n FROM {src}),
g{n}_x AS (SELECT *, lag(f) OVER w AS f1, lag(g) OVER w AS g1 FROM g{n}_s WHERE n >= 200 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g{n} AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM g{n}_x WHERE f > g AND f1 <= g1)"""  # noqa: E731
    return f"""WITH {sql.bars(by, full=True)}, {part(0, "bars")}, sd AS (SELECT max(date) AS d FROM g0), cut AS (SELECT * FROM bars WHERE date <= (SELECT d FROM sd)),
{part(1, "cut")}, b3 AS ({sql.resampled(3, "cut")}), {part(3, "b3")}, b5 AS ({sql.resampled(5, "cut")}), {part(5, "b5")},
sc AS (SELECT a.symbol, (SELECT d FROM sd) AS date, 'BUY' AS signal, a.close AS price, (1 + 2 * (a.symbol IN (SELECT symbol FROM g3 WHERE k <= 5))::INT
+ 3 * (a.symbol IN (SELECT symbol FROM g5 WHERE k <= 5))::INT) / 6.0 AS confidence, true AS setup_valid, true AS trigger_met,
'golden_cross' AS strategy_name FROM g1 a WHERE a.date = (SELECT d FROM sd) AND k <= 5)"""


@query(f"{_scan_sql('supplier')} SELECT {_SCORED} FROM sc")
def score_multi_tf(spark: SparkSession, d: str) -> DataFrame:
    bars = t.bars(spark, d, "supplier", full=True).repartition(t.tasks(spark, d), "symbol")
    return rounded(strategies.score_multi_timeframe(bars, strategies.golden_cross, strategies.last_signal_date(bars, strategies.golden_cross)))


@query(f"""{_score_sql('nation')}, r AS (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY confidence DESC) AS dense_rank FROM sc) SELECT {_SCORED},
dense_rank::INT AS dense_rank,
(row_number() OVER (PARTITION BY date ORDER BY confidence DESC, symbol))::INT AS rank FROM r WHERE dense_rank <= 10""")
def rank_picks(spark: SparkSession, d: str) -> DataFrame:
    """The picks of every scan date."""
    scored = strategies.score_all_dates(t.bars(spark, d, "nation"), strategies.golden_cross)
    return rounded(strategies.rank_picks(scored, also=("date",)).drop("ranking_score"))


# joins along time


@query(f"WITH {sql.bars()}, h AS ({sql.resampled(5)}) SELECT b.symbol, b.date, b.close, h.close AS high_close FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.date >= h.date")
def asof_state(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d)
    h = resample.resample_calendar(b, 5).select("symbol", "date", F.col("close").alias("high_close"))
    return joins.asof_state(b.select("symbol", "date", "close"), h, ["high_close"])


@query(f"""WITH {sql.bars()}, h AS ({sql.resampled(5)}) SELECT b.symbol, b.date, coalesce(CASE WHEN h.close > h.open THEN 'BUY' ELSE 'SELL' END,
'HOLD') AS signal FROM (SELECT symbol, date FROM bars) b LEFT JOIN h USING (symbol, date) WHERE h.symbol IS NOT NULL UNION ALL SELECT b.symbol,
b.date, 'HOLD' FROM bars b ANTI JOIN h USING (symbol, date)""")
def asof_event(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d)
    h = resample.resample_calendar(b, 5).withColumn("signal", F.when(F.col("close") > F.col("open"), "BUY").otherwise("SELL"))
    return joins.asof_event(b.select("symbol", "date"), h, "signal", "HOLD")


# serving


def _picks(spark: SparkSession, d: str) -> DataFrame:
    """Picks of every month's first bar of each supplier, ranked by close."""
    b = t.bars(spark, d, "supplier").withColumn("m", F.trunc("date", "month"))
    first = b.groupBy("symbol", "m").agg(F.min("date").alias("scan_date"), F.min_by("close", "date").alias("price"))
    return first.select("symbol", "scan_date", "price", F.lit("golden_cross").alias("strategy_name"), F.dense_rank().over(strategies.Window.partitionBy("m").orderBy(F.desc("price"))).alias("rank"), F.to_json(F.struct("symbol")).alias("metadata"))


_PICKS = f"""{sql.bars('supplier', 'sbars')}, {sql.META},
picks AS (SELECT symbol, scan_date, price, 'golden_cross' AS strategy_name, dense_rank() OVER (PARTITION BY m ORDER BY price DESC) AS rank,
'{{"symbol":"' || symbol || '"}}' AS metadata FROM (SELECT symbol, date_trunc('month', date) AS m, min(date) AS scan_date, arg_min(close, date) AS price FROM sbars
GROUP BY ALL))"""


@query(f"""WITH {sql.META}, {sql.WM} SELECT b.*, name, market, industry, type, active, marketcap FROM sbars b JOIN meta USING (symbol)
WHERE lower(active) = 'true' AND date = (SELECT max(latest_date) FROM wm WHERE is_current) AND marketcap >= 0""")
def screener(spark: SparkSession, d: str) -> DataFrame:
    return serving.screener(t.symbol_metadata(spark, d), t.bars(spark, d, "supplier"), t.watermark(spark, d), min_mc=0, limit=None)


@query(f"""WITH {_PICKS} SELECT symbol, scan_date, price, strategy_name, rank, metadata, name, market, industry, type, active, marketcap FROM picks LEFT
JOIN meta USING (symbol) WHERE scan_date = (SELECT max(scan_date) FROM picks)""")
def picks_today(spark: SparkSession, d: str) -> DataFrame:
    return serving.picks_today(_picks(spark, d), t.symbol_metadata(spark, d))


@query(f"WITH {_PICKS} SELECT symbol, rank, metadata FROM picks WHERE scan_date = (SELECT max(scan_date) FROM picks)")
def picks_today_metadata(spark: SparkSession, d: str) -> DataFrame:
    return serving.picks_today_metadata(_picks(spark, d), t.symbol_metadata(spark, d))


@query(f"""WITH {_PICKS} SELECT symbol, scan_date, price, strategy_name, rank, metadata, name, market, industry, type, active, marketcap FROM picks LEFT
JOIN meta USING (symbol) WHERE symbol = '1' AND scan_date = (SELECT max(scan_date) FROM picks WHERE symbol = '1')""")
def pick_detail(spark: SparkSession, d: str) -> DataFrame:
    p = _picks(spark, d)
    return serving.pick_detail(p, t.symbol_metadata(spark, d), " 1 ", p.where("symbol = '1'").agg(F.max("scan_date").alias("last")))


@query(f"""WITH {_PICKS}, k AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM sbars),
u AS (SELECT symbol, date, 0 AS side, close, NULL AS price FROM k UNION ALL SELECT symbol, scan_date, 1, NULL, price FROM picks),
p AS (SELECT symbol, date AS scan_date, price, pos FROM (SELECT *, count(close) OVER (PARTITION BY symbol ORDER BY date, side ROWS UNBOUNDED PRECEDING) AS pos FROM u)
WHERE side = 1),
lc AS (SELECT symbol, arg_max(close, date) AS c FROM k GROUP BY symbol)
SELECT p.symbol, scan_date, round((a.close - price) / price, 6) AS return_1, round((b.close - price) / price, 6) AS return_5,
round((c.close - price) / price, 6) AS return_21, round((lc.c - price) / price, 6) AS return_to_date, name, industry FROM p LEFT
JOIN k a ON a.symbol = p.symbol AND a.k = pos + 1 LEFT JOIN k b ON b.symbol = p.symbol AND b.k = pos + 5 LEFT
JOIN k c ON c.symbol = p.symbol AND c.k = pos + 21 LEFT JOIN lc ON lc.symbol = p.symbol LEFT JOIN meta ON meta.symbol = p.symbol""")
def pick_forward_returns(spark: SparkSession, d: str) -> DataFrame:
    out = serving.pick_forward_returns(_picks(spark, d).select("symbol", "scan_date", "price"), t.symbol_metadata(spark, d), t.bars(spark, d, "supplier"))
    return rounded(out.drop("price"))


@query(f"""WITH {sql.META}, {sql.bars('supplier', 'sbars')} SELECT meta.*, date, open, high, low, close, volume FROM meta JOIN sbars USING (symbol)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""")
def latest_quote(spark: SparkSession, d: str) -> DataFrame:
    return serving.latest_quote(t.symbol_metadata(spark, d), t.bars(spark, d, "supplier"))


@query(f"WITH {sql.bars('supplier')} SELECT {OHLCV} FROM bars WHERE date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 50")
def history(spark: SparkSession, d: str) -> DataFrame:
    return serving.history(t.bars(spark, d, "supplier"), None, "1998-01-01", "2000-12-31", 50)


@query(f"""WITH {sql.bars('supplier')}, r AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars),
p AS (SELECT symbol, max(close) FILTER (k = 1) AS c, max(close) FILTER (k = 2) AS a, max(close) FILTER (k = 6) AS b, max(close) FILTER (k = 22) AS e
FROM r GROUP BY symbol) SELECT symbol, c AS close, round((c - a) / a, 6) AS return_1, round((c - b) / b, 6) AS return_5, round((c - e) / e,
6) AS return_21 FROM p""")
def trailing_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(serving.trailing_returns(t.bars(spark, d, "supplier")))


@query(f"""WITH {sql.bars('supplier')}, p AS (SELECT symbol, arg_max(close, date) AS now, arg_max(close, date) FILTER (date <= DATE '2001-06-30' - 90) AS past
FROM bars WHERE date <= DATE '2001-06-30' GROUP BY symbol) SELECT symbol, now, past, round(100 * (now - past) / past, 6) AS growth_pct FROM p""")
def growth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(serving.growth(t.bars(spark, d, "supplier"), 90, "2001-06-30"))


@query(f"""WITH {sql.bars('nation')} SELECT 'YTD' AS period, {OHLCV} FROM bars WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-05-17' UNION ALL
SELECT 'MTD', {OHLCV} FROM bars WHERE date BETWEEN DATE '2000-05-01' AND DATE '2000-05-17'""")
def period_range(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "nation")
    parts = [serving.period_range(b, p, "2000-05-17").select(F.lit(p).alias("period"), "symbol", "date", "open", "high", "low", "close", "volume") for p in ("YTD", "MTD")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {sql.bars('nation')}, r AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars
WHERE date BETWEEN DATE '2000-03-31' - 90 AND DATE '2000-03-31') SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(CASE
WHEN stddev_pop(x.r) > 0 AND stddev_pop(y.r) > 0 THEN corr(x.r, y.r) END, 6) AS corr FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol
WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY ALL""")
def return_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(serving.return_correlation(t.bars(spark, d, "nation"), "2000-03-31", 90))


# back-test

GRID = [("tight", 0.03, 0.06, None, None, None, None), ("trail", None, None, 0.05, None, None, None), ("time", None, None, None, 20, None, None), ("anchor", None, 0.2, None, None, "ENTRY_LOW", 0.02)]


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return conditions.compile_strategy(CONFIG)(t.bars(spark, d, "nation"))


def _trades_once(spark: SparkSession, d: str) -> DataFrame:
    """The trades as a written table, for queries that read them more than once."""
    path = versions.scratch(spark, "ledger")
    _ledger(spark, d)[0].write.parquet(path)
    return spark.read.parquet(path)


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return backtest.backtest(_signals(spark, d), spark.createDataFrame(GRID, backtest.PARAMETERS))


def _value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_GRID = ", ".join("(" + ", ".join(_value(x) for x in row) + ")" for row in GRID)
def _led(grid: str = _GRID, fee: float = 0, slip: float = 0) -> str:
    """The ledger as a recursion over the bars: led has the state after each bar and the trade that it closed."""
    return f"""{sql.bars("nation")}, {_RSI}, sg AS (SELECT *, {sql.rolling("avg", "close", 20)} AS a, {sql.rolling("avg", "close", 50)} AS b FROM rsi),
sx AS (SELECT *, lag(rsi_14) OVER (PARTITION BY symbol ORDER BY date) AS r1 FROM sg),
bar AS (SELECT symbol, date, open, high, low, close, coalesce(a > b, false) AND close > open AS buy, coalesce(rsi_14 < 70 AND r1 >= 70, false) AS leave, row_number() OVER
(PARTITION BY symbol ORDER BY date) AS rn,
count(*) OVER (PARTITION BY symbol) AS n FROM sx),
grid(run_id, sl, tp, ts, md, anchor, off) AS (VALUES {grid}),
led AS (SELECT grid.*, symbol, 0::BIGINT AS rn, 0::BIGINT AS n, NULL::DATE AS date, NULL::DOUBLE AS close, 10000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, false AS held,
NULL::DOUBLE AS ep, NULL::DATE AS ed, NULL::DOUBLE AS peak, NULL::DOUBLE AS anc,
NULL::VARCHAR AS reason, NULL::DOUBLE AS x_ep, NULL::DATE AS x_ed, NULL::DOUBLE AS x_shares FROM grid, (SELECT DISTINCT symbol FROM bar)
UNION ALL SELECT run_id, sl, tp, ts, md, anchor, off, symbol, rn, n, date, close, CASE WHEN enter THEN 0.0 ELSE cash1 END, CASE WHEN enter THEN (cash1 - {fee}) / (close *
(1 + {slip})) WHEN held1 THEN shares ELSE 0.0 END, enter OR held1,
CASE WHEN enter THEN close * (1 + {slip}) ELSE ep END, CASE WHEN enter THEN date ELSE ed END, CASE WHEN enter THEN close ELSE top END,
CASE WHEN enter THEN CASE anchor WHEN 'ENTRY_LOW' THEN low * (1 - off) WHEN 'ENTRY_HIGH' THEN high * (1 - off) WHEN 'ENTRY_OPEN' THEN open * (1 - off)
WHEN 'ENTRY_CLOSE' THEN close * (1 - off) END ELSE anc END, why, ep, ed, shares FROM (
SELECT *, held AND why IS NULL AS held1, NOT (held AND why IS NULL) AND buy AS enter, CASE WHEN why IS NULL THEN cash ELSE cash + shares * (close *
(1 - {slip})) - {fee} END AS cash1 FROM (
SELECT r.run_id, r.sl, r.tp, r.ts, r.md, r.anchor, r.off, bar.*, r.cash, r.shares, r.held, r.ep, r.ed, r.anc, greatest(r.peak, bar.close) AS top,
CASE WHEN NOT r.held THEN NULL WHEN bar.close <= r.ep * (1 - r.sl) THEN 'stop_loss' WHEN bar.close <= r.anc THEN 'stop_loss_anchor' WHEN bar.close >= r.ep *
(1 + r.tp) THEN 'take_profit'
WHEN bar.close <= greatest(r.peak, bar.close) * (1 - r.ts) THEN 'trailing_stop' WHEN bar.date - r.ed >= r.md THEN 'time_based' WHEN bar.leave THEN 'signal' END AS why
FROM led r JOIN bar ON bar.symbol = r.symbol AND bar.rn = r.rn + 1))),
shut AS (SELECT run_id, symbol, x_ed AS entry_date, x_ep AS entry_price, date AS exit_date, close * (1 - {slip}) AS exit_price, x_shares AS shares, reason FROM led
WHERE reason IS NOT NULL
UNION ALL SELECT run_id, symbol, ed, ep, date, close * (1 - {slip}), shares, 'end_of_data' FROM led WHERE held AND rn = n),
ledger AS (SELECT run_id, symbol, row_number() OVER (PARTITION BY run_id, symbol ORDER BY exit_date, entry_date) AS trade_no, entry_date, entry_price, exit_date, exit_price,
shares, reason, exit_price - entry_price AS pnl,
(exit_price - entry_price) / entry_price AS pnl_pct, exit_date - entry_date AS holding_days FROM shut),
eq AS (SELECT run_id, symbol, date, CASE WHEN held AND rn = n THEN cash + shares * (close * (1 - {slip})) - {fee} ELSE cash + shares * close END AS equity FROM led WHERE rn > 0)"""


_LED = _led()


@query(f"""WITH RECURSIVE {_LED} SELECT run_id, symbol, trade_no, entry_date, round(entry_price, 4) AS entry_price, exit_date, round(exit_price,
4) AS exit_price, round(shares, 4) AS shares, reason, round(pnl, 4) AS pnl, round(pnl_pct, 4) AS pnl_pct, holding_days FROM ledger""")
def backtest_ledger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ledger(spark, d)[0], 4)


@query(f"WITH RECURSIVE {_LED} SELECT run_id, symbol, date, round(equity, 4) AS equity FROM eq")
def backtest_equity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ledger(spark, d)[1], 4)


_METRICS = """a AS (SELECT run_id, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, avg(pnl) FILTER (pnl > 0) AS w, avg(pnl) FILTER (pnl < 0) AS l,
coalesce(sum(pnl) FILTER (pnl > 0), 0) AS sw, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS sl FROM ledger GROUP BY run_id),
fin AS (SELECT run_id, sum(e - 10000) AS total FROM (SELECT run_id, symbol, arg_max(equity, date) AS e FROM eq GROUP BY ALL) GROUP BY run_id)
SELECT run_id, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, round(coalesce(w, 0), 4) AS avg_win, round(coalesce(l, 0), 4) AS avg_loss, round(total, 4) AS total_return,
round(coalesce(wins / trades, 0), 4) AS win_rate, round(CASE WHEN sl > 0 THEN sw / sl WHEN sw > 0 THEN 'Infinity'::DOUBLE ELSE 0 END, 4) AS profit_factor FROM fin LEFT JOIN a USING (run_id)"""


@query(f"WITH RECURSIVE {_LED}, {_METRICS}")
def trade_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.trade_metrics(backtest.walk(_signals(spark, d), spark.createDataFrame(GRID, backtest.PARAMETERS))), 4)


@query(f"WITH RECURSIVE {_led(fee=50, slip=0.002)}, {_METRICS}")
def trade_metrics_with_costs(spark: SparkSession, d: str) -> DataFrame:
    walked = backtest.walk(_signals(spark, d), spark.createDataFrame(GRID, backtest.PARAMETERS), commission=50.0, slippage=0.002)
    return rounded(backtest.trade_metrics(walked), 4)


@query(f"""WITH RECURSIVE {_led(fee=50, slip=0.002)} SELECT run_id, symbol, trade_no, entry_date, round(entry_price, 4) AS entry_price, exit_date,
round(exit_price, 4) AS exit_price, round(shares, 4) AS shares, reason, round(pnl, 4) AS pnl FROM ledger""")
def backtest_ledger_with_costs(spark: SparkSession, d: str) -> DataFrame:
    trades, _ = backtest.backtest(_signals(spark, d), spark.createDataFrame(GRID, backtest.PARAMETERS), commission=50.0, slippage=0.002)
    return rounded(trades.select("run_id", "symbol", "trade_no", "entry_date", "entry_price", "exit_date", "exit_price", "shares", "reason", "pnl"), 4)


@query(f"""WITH {sql.bars('nation')}, p AS (SELECT symbol, date, close AS equity, max(close) OVER w - close AS f, close / lag(close) OVER w - 1 AS r
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, round(max(f), 4) AS max_drawdown, round(max(f) / 10000,
4) AS max_drawdown_pct, round(CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(252) ELSE 0 END, 4) AS sharpe, round(arg_max(equity,
date), 4) AS final_equity, round(arg_max(equity, date) - 10000, 4) AS total_return FROM p GROUP BY symbol""")
def drawdown_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.drawdown_sharpe(t.bars(spark, d, "nation").select("symbol", "date", F.col("close").alias("equity")), by=("symbol",)), 4)


@query(f"""WITH RECURSIVE {_LED}, tot AS (SELECT run_id, date, sum(equity) AS equity FROM eq GROUP BY ALL), p AS (SELECT run_id, date, equity, max(equity)
OVER w - equity AS f, equity / lag(equity) OVER w - 1 AS r FROM tot WINDOW w AS (PARTITION BY run_id ORDER BY date)),
m AS (SELECT run_id, max(f) AS dd, CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) ELSE 0 END AS sharpe, arg_max(equity, date) AS fin FROM p GROUP BY run_id)
SELECT (SELECT run_id FROM m ORDER BY sharpe DESC, run_id DESC LIMIT 1) AS best_sharpe, (SELECT run_id FROM m ORDER BY fin DESC, run_id DESC LIMIT 1) AS best_return,
(SELECT run_id FROM m ORDER BY dd, run_id LIMIT 1) AS least_drawdown""")
def grid_best(spark: SparkSession, d: str) -> DataFrame:
    equity = backtest.portfolio(_ledger(spark, d)[1])
    return backtest.grid_best(backtest.drawdown_sharpe(equity, by=("run_id",)))


@query(f"""WITH RECURSIVE {_LED}, c AS (SELECT *, 10000 * exp(sum(ln(1 + greatest(pnl_pct, -0.999999))) OVER w) AS c FROM ledger WINDOW w AS
(PARTITION BY run_id ORDER BY exit_date, symbol, trade_no)),
f AS (SELECT *, 1 - c / greatest(10000, max(c) OVER (PARTITION BY run_id ORDER BY exit_date, symbol, trade_no)) AS fall FROM c),
rm AS (SELECT run_id, count(*) FILTER (pnl > 0) / nullif(count(*) FILTER (pnl <> 0), 0) AS win_rate, max(fall) AS dd, avg(pnl_pct) AS m, stddev_samp(pnl_pct) AS s,
exp(sum(ln(1 + greatest(pnl_pct, -0.999999)))) AS x, max(exit_date) - min(entry_date) AS span FROM f GROUP BY run_id)
SELECT run_id, round(win_rate, 4) AS win_rate, round(dd, 4) AS max_drawdown_pct, round(10000 * x, 2) AS final, round(CASE WHEN span > 0 THEN pow(x, 252.0 / span) - 1 END,
4) AS yearly_return, round(CASE WHEN s > 0 THEN (m - 0.03 / 365) / s * sqrt(365) ELSE 0 END, 4) AS sharpe FROM rm""")
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.report_metrics(_trades_once(spark, d)), 4).withColumn("final", F.round("final", 2))


@query(f"WITH RECURSIVE {_LED} SELECT run_id, year(exit_date)::INT AS year, round(exp(sum(ln(1 + greatest(pnl_pct, -0.999999)))) - 1, 4) AS compounded, count(*) AS trades FROM ledger GROUP BY ALL")
def yearly_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.yearly_returns(_ledger(spark, d)[0]), 4)


@query(f"""WITH RECURSIVE {_LED} SELECT run_id, reason, count(*) AS n, round(avg(pnl_pct), 6) AS mean, round(median(pnl_pct), 6) AS median,
round(stddev_samp(pnl_pct), 6) AS std, round(min(pnl_pct), 6) AS least, round(max(pnl_pct), 6) AS greatest, round(quantile_cont(pnl_pct, 0.05),
6) AS p5, round(quantile_cont(pnl_pct, 0.95), 6) AS p95 FROM ledger GROUP BY ALL""")
def return_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(serving.describe_returns(backtest.trade_facts(_ledger(spark, d)[0]), by=("run_id", "reason")))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.bootstrap_ci(_trades_once(spark, d)), 6)


@query(f"""WITH {sql.bars('supplier')}, p AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS f FROM bars) SELECT symbol,
round(arg_max(close, date) / arg_min(close, date), 6) AS ratio, round(min(f), 6) AS max_fall FROM p GROUP BY symbol""")
def buy_hold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest.buy_hold(t.bars(spark, d, "supplier")))


_TRADES = "tr AS (SELECT symbol, date AS entry_date, close AS entry_price, date + 14 AS exit_date, 100 / close AS shares FROM bars WHERE day(date) = 1)"


@query(f"""WITH {sql.bars('nation')}, {_TRADES} SELECT tr.symbol, entry_date, exit_date, date, round((close - entry_price) * shares, 6) AS unrealised,
round((close - entry_price) / entry_price, 6) AS unrealised_pct, round(shares * close, 6) AS value, (date - entry_date)::INT AS days_held FROM tr
JOIN bars b ON b.symbol = tr.symbol AND date > entry_date AND date <= exit_date""")
def position_history(spark: SparkSession, d: str) -> DataFrame:
    b = t.bars(spark, d, "nation")
    trades = b.where("day(date) = 1").select("symbol", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), F.date_add("date", 14).alias("exit_date"), (100 / F.col("close")).alias("shares"))
    return rounded(backtest.position_history(trades, b).select("symbol", "entry_date", "exit_date", "date", "unrealised", "unrealised_pct", "value", "days_held"))


@query(f"""WITH {sql.bars('supplier')}, g AS (SELECT symbol, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS g FROM bars), m AS (SELECT symbol,
median(g) AS m FROM g GROUP BY symbol) SELECT symbol, CASE WHEN m > 0 THEN greatest(1, CAST(round(252 / m) AS INTEGER)) ELSE 252 END AS periods FROM m""")
def periods_per_year(spark: SparkSession, d: str) -> DataFrame:
    return backtest.periods_per_year(t.bars(spark, d, "supplier"))


# alerts

INTERVALS = (1, 3, 5, 8, 13, 21, 34)


def _silver(spark: SparkSession, d: str, by: str = "region") -> DataFrame:
    return resample.resample_all(t.bars(spark, d, by), INTERVALS).withColumnRenamed("n", "interval")


def _supplier_alerts(spark: SparkSession, d: str, days: int = 5 * 365) -> DataFrame:
    """Alerts of suppliers with the weights of their intervals; the bars of a supplier stay in one task, whatever their width."""
    bars = t.bars(spark, d, "supplier").repartition(t.tasks(spark, d), "symbol")
    silver = resample.resample_all(bars, INTERVALS).withColumnRenamed("n", "interval")
    ends = resample.last_buckets(t.ticks(spark, d, "supplier").agg(F.max("date").alias("date")), INTERVALS)
    return alerts.weighed_alerts(silver, days, ends.withColumnRenamed("n", "interval"))


def _sil(by: str) -> str:
    return f"""{sql.bars(by)}, sil AS ({" UNION ALL ".join(f"SELECT {n} AS interval, * FROM ({sql.resampled(n)})" for n in INTERVALS)}),
{sql.ema('sil', (8, 13, 144, 169), part='symbol, interval')}, v AS (SELECT *, least(ema_8, ema_13) AS smin, greatest(ema_8, ema_13) AS smax, least(ema_144, ema_169) AS lmin,
greatest(ema_144, ema_169) AS lmax FROM e),
vel AS (SELECT *, CASE WHEN close > open AND close > smax AND close > lmax AND smin > lmax THEN 'velocity_maintained' WHEN close < ema_13
AND close > ema_169 THEN 'velocity_weak' WHEN close < ema_13 AND close < ema_169 THEN 'velocity_loss' ELSE 'velocity_negotiating' END AS velocity FROM v),
a1 AS (SELECT symbol, interval, date, 'velocity_alert' AS alert_type, velocity AS signal FROM vel)"""


_SIL = _sil("region")


def _cnt(test: str) -> str:
    arms = {1: 28, 3: 20, 5: 20, 8: 14, 13: 14}
    count = lambda n: sql.rolling("sum", f"({test})::INT", n, "symbol, interval")
    return "CASE interval " + " ".join(f"WHEN {k} THEN {count(n)}" for k, n in arms.items()) + f" ELSE {count(7)} END"


_MA = f"""cn AS (SELECT *, {_cnt("velocity <> 'velocity_maintained'")} AS nb, {_cnt("velocity = 'velocity_maintained'")} AS ng FROM vel),
a2 AS (SELECT symbol, interval, date, 'momentum_alert' AS alert_type, CASE WHEN lmax <= smax AND open < close AND nb > ng THEN 'accelerated' WHEN close < smin
AND ng < nb THEN 'decelerated' END AS signal FROM cn)"""
_TA = """tl AS (SELECT *, lmin * (1 - tol) AS b0, lmax * (1 + tol) AS b1 FROM (SELECT *, CASE interval WHEN 1 THEN 0.002::DOUBLE WHEN 3 THEN 0.02::DOUBLE WHEN 5 THEN 0.05::DOUBLE WHEN 8 THEN 0.07::DOUBLE WHEN 13 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END AS tol FROM vel)),
a3 AS (SELECT symbol, interval, date, 'ema_touch' AS alert_type, CASE WHEN smin > lmax AND least(close, open) > lmin THEN 'support' WHEN smax < lmax AND close < lmax THEN 'resistance' ELSE 'neutral' END AS signal FROM tl WHERE low BETWEEN b0 AND b1 OR ema_13 BETWEEN b0 AND b1 OR ema_8 BETWEEN b0 AND b1)"""


@query(f"WITH RECURSIVE {_SIL} SELECT * FROM a1")
def velocity_alert(spark: SparkSession, d: str) -> DataFrame:
    return alerts.velocity_alert(_silver(spark, d))


@query(f"WITH RECURSIVE {_SIL}, {_MA} SELECT * FROM a2 WHERE signal IS NOT NULL")
def momentum_alert(spark: SparkSession, d: str) -> DataFrame:
    return alerts.momentum_alert(_silver(spark, d))


@query(f"WITH RECURSIVE {_SIL}, {_TA} SELECT * FROM a3")
def ema_touch_alert(spark: SparkSession, d: str) -> DataFrame:
    return alerts.ema_touch_alert(_silver(spark, d))


def _all(by: str) -> str:
    return f"""{_sil(by)}, {_MA}, {_TA}, al AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 WHERE signal IS NOT NULL UNION ALL SELECT * FROM a3), la AS (SELECT *
FROM al QUALIFY date >= max(date) OVER (PARTITION BY interval) - 1825)"""


_ALL = _all("region")


@query(f"WITH RECURSIVE {_ALL} SELECT * FROM la")
def all_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.all_alerts(_silver(spark, d))


_NAMED = {"acc": "accelerated", "dec": "decelerated", "sup": "support", "res": "resistance", "mai": "velocity_maintained", "wea": "velocity_weak", "los": "velocity_loss"}


def _weighed(source: str, by: str = "symbol, interval") -> str:
    """Counts of signals and touches, and the interval's place among all of the source."""
    counts = ", ".join(f"count(*) FILTER (signal = '{name}') AS {short}" for short, name in _NAMED.items())
    return f"""cw AS (SELECT cc.*, w FROM (SELECT {by}, {counts}, count(*) FILTER (alert_type = 'ema_touch') AS tou FROM {source} GROUP BY {by}) cc
JOIN (SELECT interval, row_number() OVER (ORDER BY interval) AS w FROM (SELECT DISTINCT interval FROM {source})) USING (interval))"""


def _lasts(days: int) -> str:
    return f"""WITH RECURSIVE {_all("supplier")}, last AS (SELECT * FROM la QUALIFY date >= max(date) OVER (PARTITION BY interval) - {days}), {_weighed("last")}"""


def _last_alerts(spark: SparkSession, d: str, days: int = 14) -> DataFrame:
    return _supplier_alerts(spark, d, days)


def _a_row_each(found: DataFrame) -> DataFrame:
    return found.select("category", F.explode("symbols").alias("symbol"))


@query(f"""{_lasts(14)} SELECT DISTINCT 'accelerating' AS category, symbol FROM cw WHERE w * acc > 1 AND w * dec < 1 AND interval <= 3
UNION ALL SELECT 'long_accelerating', symbol FROM cw WHERE w * acc > 1 AND w * dec < 1 AND interval = 5
UNION ALL SELECT 'long_accumulating', symbol FROM cw WHERE w * sup > 1 AND w * res < 1 AND tou >= 1 AND interval = 5""")
def candidates_micro(spark: SparkSession, d: str) -> DataFrame:
    return _a_row_each(alerts.candidates_micro(_last_alerts(spark, d)))


@query(f"{_lasts(14)} SELECT DISTINCT 'velocity_maintained' AS category, symbol FROM cw WHERE interval >= 8 AND w * mai > 0 AND wea = 0 AND los = 0")
def candidates_macro(spark: SparkSession, d: str) -> DataFrame:
    return _a_row_each(alerts.candidates_macro(_last_alerts(spark, d)))


@query(f"{_lasts(180)} SELECT DISTINCT 'accumulating' AS category, symbol FROM cw WHERE w * sup > 1 AND w * res < 1 AND tou >= 2 AND interval <= 3")
def candidates_accumulating(spark: SparkSession, d: str) -> DataFrame:
    return _a_row_each(alerts.candidates_accumulating(_last_alerts(spark, d, 180)))


def _symbols_where(test: str, name: str) -> str:
    return f"coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER ({test}), '') AS {name}"


_BY_DATE = f"""WITH RECURSIVE {_all("supplier")}, {_weighed("la", "date, symbol, interval")}, ca AS (SELECT date,
{_symbols_where("w * acc > 1 AND w * dec < 1 AND interval <= 3", "accelerating")}, {_symbols_where("w * acc > 1 AND w * dec < 1 AND interval = 5", "long_accelerating")},
{_symbols_where("w * sup > 1 AND w * res < 1 AND tou >= 1 AND interval = 5", "long_accumulating")},
{_symbols_where("interval >= 8 AND w * mai > 0 AND wea = 0 AND los = 0", "velocity_maintained")} FROM cw GROUP BY date)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return alerts.candidates_by_date(_supplier_alerts(spark, d))


@query(f"{_BY_DATE} SELECT * FROM ca")
def candidates_by_date(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).withColumns({k: F.concat_ws(",", k) for k in alerts.CATEGORIES})


@query(f"{_BY_DATE} SELECT date, category, symbols FROM (UNPIVOT ca ON accelerating, long_accelerating, long_accumulating, velocity_maintained INTO NAME category VALUE symbols) WHERE date = (SELECT max(date) FROM ca)")
def latest_candidates(spark: SparkSession, d: str) -> DataFrame:
    return alerts.latest_candidates(_candidates(spark, d)).withColumn("symbols", F.concat_ws(",", "symbols"))


_SUP = f"""{_SIL}, {_TA}, tb AS (SELECT sil.symbol, sil.interval, sil.date, a3.signal AS touch, row_number() OVER (PARTITION BY sil.symbol,
sil.interval ORDER BY sil.date) AS rn FROM sil LEFT JOIN a3 ON a3.symbol = sil.symbol AND a3.interval = sil.interval AND a3.date = sil.date),
sup AS (SELECT symbol, interval, NULL::DATE AS date, NULL::VARCHAR AS touch, 0::BIGINT AS rn, false AS shown, -9::BIGINT AS s, -9::BIGINT AS r, -9::BIGINT AS n FROM
(SELECT DISTINCT symbol, interval FROM tb)
UNION ALL SELECT symbol, interval, date, touch, rn, shown, CASE WHEN shown AND touch = 'support' THEN rn ELSE s END, CASE WHEN shown
AND touch = 'resistance' THEN rn ELSE r END, CASE WHEN shown AND touch = 'neutral' THEN rn ELSE n END FROM (
SELECT tb.*, coalesce(tb.rn - CASE tb.touch WHEN 'support' THEN x.s WHEN 'resistance' THEN x.r WHEN 'neutral' THEN x.n END > 3, false) AS shown, x.s, x.r, x.n FROM sup x
JOIN tb ON tb.symbol = x.symbol AND tb.interval = x.interval AND tb.rn = x.rn + 1)),
cnt3 AS (SELECT *, count(*) FILTER (shown) OVER (PARTITION BY symbol, interval ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS touch_count FROM sup WHERE rn > 0)"""


@query(f"WITH RECURSIVE {_SUP} SELECT symbol, interval, date, touch, touch_count FROM cnt3 WHERE shown")
def touch_alert_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return alerts.touch_alert_suppressed(_silver(spark, d))


# candles (the batch form of the streaming cascade)


def _level_sql(name: str) -> str:
    width, below, _ = candles.LEVELS[name]
    if below is None:
        return f"""{sql.EVENTS}, c_1m AS (SELECT symbol, time_bucket(INTERVAL '1 minute', event_time) AS ws, arg_min(p, (event_time, event_id)) AS o, max(p) AS h, min(p) AS l,
arg_max(p, (event_time, event_id)) AS c, sum(volume)::BIGINT AS v, count(*) AS n, CASE WHEN sum(volume) > 0 THEN sum(p * volume) / sum(volume) ELSE avg(p) END AS vw FROM ok
GROUP BY 1, 2)"""
    return f"""{_level_sql(below)}, c_{name} AS (SELECT symbol, time_bucket(INTERVAL '{width}', ws, TIMESTAMP '1970-01-01') AS ws, arg_min(o, ws) AS o, max(h) AS h,
min(l) AS l, arg_max(c, ws) AS c, sum(v)::BIGINT AS v, sum(n)::BIGINT AS n, CASE WHEN sum(v) > 0 THEN sum(vw * v) / sum(v) ELSE avg(vw) END AS vw FROM c_{below} GROUP BY 1,
time_bucket(INTERVAL '{width}', ws, TIMESTAMP '1970-01-01'))"""


def _level(name: str) -> None:
    @query(f"""WITH {_level_sql(name)} SELECT symbol, epoch_ms(ws) // 1000 AS start, o AS open_price, h AS high_price, l AS low_price, c AS close_price,
v AS volume, n AS trade_count, round(vw + 1e-9, 6) AS vwap FROM c_{name}""", name=f"candles_{name}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = candles.cascade(t.stream_events(spark, d), name)
        # A whole ratio may lie just between two roundings, so both sides are nudged.
        return rounded(out.select("symbol", F.unix_timestamp("window_start").alias("start"), *candles.PRICE, "volume", "trade_count", (F.col("vwap") + 1e-9).alias("vwap")))


for _name in candles.LEVELS:
    _level(_name)


def _avg(c: str, minutes: int) -> str:
    return f"round(avg({c}) OVER (PARTITION BY symbol ORDER BY s RANGE BETWEEN {60 * minutes} PRECEDING AND CURRENT ROW), 8)"


@query(f"""WITH {_level_sql("15m")}, q AS (SELECT *, epoch_ms(ws) // 1000 AS s FROM c_15m), m AS
(SELECT *, {_avg("c", 180)} AS e12, {_avg("c", 2160)} AS e144, {_avg("v", 300)} AS av FROM q),
x AS (SELECT *, v / nullif(av, 0) AS ratio, lag(c) OVER w AS c1, lag(e12) OVER w AS p12 FROM m WINDOW w AS (PARTITION BY symbol ORDER BY s)),
y AS (SELECT *, CASE WHEN c > e12 AND e12 > e144 AND c1 <= p12 THEN 'breakout_long' WHEN c < e12 AND e12 < e144 AND c1 >= p12 THEN 'breakout_short'
WHEN abs(c - e144) <= 0.001 * e144 AND e12 > e144 THEN 'support' WHEN abs(c - e12) <= 0.001 * e12 AND e12 < e144 THEN 'resistance' END AS signal,
least(1, greatest(0, 200 * abs(c - e12) / nullif(e12, 0) + least(0.3, 0.1 * coalesce(ratio, 0)) + least(0.2, 10 * abs(e12 - e144) / nullif(e144, 0)))) AS strength FROM x)
SELECT symbol, s AS start, signal, round(strength + 1e-9, 6) AS strength, round(e12 + 1e-9, 6) AS avg_180m, round(e144 + 1e-9, 6) AS avg_2160m FROM y WHERE signal IS NOT NULL
AND strength > 0.3""")
def channel_signals_range(spark: SparkSession, d: str) -> DataFrame:
    out = candles.channel_signals(candles.cascade(t.stream_events(spark, d), "15m"))
    nudged = [(F.col(c) + 1e-9).alias(c) for c in ("strength", "avg_180m", "avg_2160m")]
    return rounded(out.select("symbol", F.unix_timestamp("window_start").alias("start"), "signal", *nudged))


@query(f"""WITH {_level_sql('1h')}, k AS (SELECT event_type AS symbol, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type
FROM events)), cfg AS (SELECT symbol, i, CASE i % 2 WHEN 0 THEN '>' ELSE '<=' END AS op, 50.0 AS threshold FROM k WHERE i <> 3)
SELECT 'a' || cfg.i AS alert_id, symbol, epoch_ms(ws) // 1000 AS start, c AS price FROM c_1h JOIN cfg USING (symbol) WHERE CASE op
WHEN '>' THEN c > threshold ELSE c <= threshold END""")
def price_alerts(spark: SparkSession, d: str) -> DataFrame:
    names = t.table(spark, d, "events").select("event_type").distinct()
    i = F.row_number().over(strategies.Window.orderBy("event_type"))
    config = names.withColumn("i", i).select(F.concat(F.lit("a"), F.col("i")).alias("alert_id"), F.lit("u").alias("user_id"), F.col("event_type").alias("symbol"), F.when(F.col("i") % 2 == 0, ">").otherwise("<=").alias("operator"), F.lit(50.0).alias("threshold"), F.lit("close").alias("price_type"), (F.col("i") != 3).alias("enabled"))
    out = candles.price_alerts(candles.cascade(t.stream_events(spark, d), "1h"), config)
    return out.select("alert_id", "symbol", F.unix_timestamp("window_start").alias("start"), "price")


@query(f"""WITH {_level_sql('1h')}, p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ws) AS c1 FROM c_1h) SELECT symbol, epoch_ms(ws) // 1000 AS start,
round(100 * (c - c1) / c1, 6) AS change_pct FROM p WHERE c1 <> 0 AND abs(100 * (c - c1) / c1) >= 5""")
def price_change_alerts(spark: SparkSession, d: str) -> DataFrame:
    out = candles.price_change_alerts(candles.cascade(t.stream_events(spark, d), "1h"))
    return rounded(out.select("symbol", F.unix_timestamp("window_start").alias("start"), "change_pct"))
