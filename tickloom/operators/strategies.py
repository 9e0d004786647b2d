"""Strategies over a whole universe, and the scan that scores and ranks them (Y operators, W2)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conditions import crosses
from .indicators import ema, fresh, over, running, series_of, smas
from .resample import resample_all

Strategy = Callable[[DataFrame], DataFrame]
SCORED = "symbol string, date date, signal string, price double, confidence double, setup_valid boolean, trigger_met boolean, strategy_name string"


def run_strategy(df: DataFrame, strategy: Strategy) -> DataFrame:
    """A strategy adds ``setup_valid``, ``signal`` and ``exit_signal``; a missing one is an error."""
    out = strategy(df)
    missing = {"setup_valid", "signal", "exit_signal"} - set(out.columns)
    if missing:
        raise ValueError(f"the strategy lacks {sorted(missing)}")
    return out


def run_universe(strategy: Strategy, df: DataFrame, timeframe: str = "1d") -> DataFrame:
    """All symbols in one pass."""
    return run_strategy(df if "timeframe" in df.columns else df.withColumn("timeframe", F.lit(timeframe)), strategy)


def golden_cross(df: DataFrame, fast: int = 50, slow: int = 200, min_dates: int = 200) -> DataFrame:
    """Y2: symbols with too few dates go after the averages are made."""
    by = series_of(df)
    out = smas(df, (fast, slow), by=by)
    dates, up, down = fresh(out, "_dates", "_up", "_down")
    f, s = F.col(f"sma_{fast}"), F.col(f"sma_{slow}")
    out = out.withColumn(dates, F.count("date").over(Window.partitionBy(*by))).where(F.col(dates) >= min_dates).drop(dates)
    setup = F.coalesce(f > s, F.lit(False))
    out = out.withColumns({"setup_valid": setup, up: F.coalesce(crosses(f, s, True, by), F.lit(False)), down: F.coalesce(crosses(f, s, False, by), F.lit(False))})
    buy = F.col("setup_valid") & F.col(up)
    return out.withColumns({"signal": F.when(buy, "BUY").otherwise("HOLD"), "exit_signal": F.when(F.col(down), "SELL"), "stop_loss_price": F.col("close") * 0.95}).drop(up, down)


def _ema4() -> tuple[Column, Column, Column, Column]:
    e8, e13, e144, e169 = (F.col(f"ema_{p}") for p in (8, 13, 144, 169))
    return F.least(e8, e13), F.greatest(e8, e13), F.least(e144, e169), F.greatest(e144, e169)


def velocity_status(df: DataFrame, into: str = "velocity") -> DataFrame:
    """The first status that fits."""
    out = ema(df, (8, 13, 144, 169), by=series_of(df))
    short_min, short_max, _, long_max = _ema4()
    c, o, e13, e169 = F.col("close"), F.col("open"), F.col("ema_13"), F.col("ema_169")
    kept = (c > o) & (c > short_max) & (c > long_max) & (short_min > long_max)
    return out.withColumn(into, F.when(kept, "velocity_maintained").when((c < e13) & (c > e169), "velocity_weak").when((c < e13) & (c < e169), "velocity_loss").otherwise("velocity_negotiating"))


#: Bars of observation by timeframe in days; other day frames, and frames that aren't days.
OBSERVE, OTHER_DAYS, NOT_DAYS = {1: 28, 3: 20, 5: 20, 8: 14, 13: 14}, 7, 30


def obs_window(timeframe: str | None, override: int | None = None) -> int:
    """Y4"""
    if override is not None:
        return max(2, override)
    if timeframe and timeframe.endswith("d") and timeframe[:-1].isdigit():
        return OBSERVE.get(int(timeframe[:-1]), OTHER_DAYS)
    return NOT_DAYS


def by_timeframe(df: DataFrame, value: Callable[[int], Column], windows: dict[str, int] | None = None) -> Column:
    """A column whose window length depends on the timeframe: one column for each length, chosen by CASE."""
    out = value(NOT_DAYS)
    if "timeframe" not in df.columns:
        return value(obs_window("1d"))
    days = F.regexp_extract("timeframe", r"^(\d+)d$", 1)
    out = F.when(days == "", value(NOT_DAYS)).otherwise(value(OTHER_DAYS))
    for length in sorted(set(OBSERVE.values())):
        out = F.when(days.isin([str(k) for k, v in OBSERVE.items() if v == length]), value(length)).otherwise(out)
    return out


def momentum_signal(df: DataFrame, obs: int | None = None, cooldown: int = 30, mode: str = "documented") -> DataFrame:
    """``momentum`` is accelerated, decelerated or null; ``raw_momentum`` is it before the cooldown.

    ``documented``: null if the same raw signal occurred in the ``cooldown`` bars before. ``observed``: only if each
    of those bars carries a raw signal, as null arithmetic has it.
    """
    by = series_of(df)
    out = df if "velocity" in df.columns else velocity_status(df)
    short_min, short_max, long_min, long_max = _ema4()
    bad, good, n_bad, n_good, fast, slow = fresh(out, "_bad", "_good", "_nb", "_ng", "_a", "_d")
    flags = {bad: F.col("velocity").isin("velocity_loss", "velocity_weak", "velocity_negotiating"), good: F.col("velocity") == "velocity_maintained"}
    out, last, helpers = running(out, flags, by)
    count = lambda c: (lambda n: last(c, n))
    counts = [count(c)(obs) if obs else by_timeframe(out, count(c)) for c in (bad, good)]
    out = out.withColumns(dict(zip((n_bad, n_good), counts, strict=True))).drop(*helpers)
    o, c = F.col("open"), F.col("close")
    more = F.col(n_bad) > F.col(n_good)
    raw = F.when(more & (long_max <= short_max) & (short_max < o) & (o < c), "accelerated").when(more & (c < short_min) & (short_min <= long_min), "decelerated")
    out = out.withColumn("raw_momentum", raw)
    w = over(by).rowsBetween(-cooldown, -1)
    if mode == "observed":
        same = lambda kind: (F.count("raw_momentum").over(w) == cooldown) & (F.sum((F.col("raw_momentum") == kind).cast("int")).over(w) > 0)
    else:
        same = lambda kind: F.coalesce(F.max((F.col("raw_momentum") == kind).cast("int")).over(w), F.lit(0)) > 0
    out = out.withColumns({fast: F.coalesce(same("accelerated"), F.lit(False)), slow: F.coalesce(same("decelerated"), F.lit(False))})
    kept = F.when((F.col("raw_momentum") == "accelerated") & ~F.col(fast), "accelerated").when((F.col("raw_momentum") == "decelerated") & ~F.col(slow), "decelerated")
    return out.withColumn("momentum", kept).drop(n_bad, n_good, fast, slow)


def channel_strategy(df: DataFrame, stop_loss_pct: float | None = None, take_profit_pct: float | None = None) -> DataFrame:
    """Y6"""
    by = series_of(df)
    out = momentum_signal(df)
    (n,) = fresh(out, "_n")
    out = out.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    fast = F.coalesce(F.col("momentum") == "accelerated", F.lit(False))
    out = out.withColumn("setup_valid", (F.col(n) >= 169) & (fast | (F.col("velocity") == "velocity_maintained")))
    buy = F.col("setup_valid") & fast & (F.col("open") < F.col("close"))
    out = out.withColumns({"signal": F.when(buy, "BUY").otherwise("HOLD"), "exit_signal": F.when(F.col("velocity") == "velocity_loss", "SELL")}).drop(n)
    if stop_loss_pct:
        out = out.withColumn("stop_loss_price", F.when(buy, F.col("close") * (1 - stop_loss_pct)))
    if take_profit_pct:
        out = out.withColumn("take_profit_price", F.when(buy, F.col("close") * (1 + take_profit_pct)))
    return out


#: Strategies by name, with their timeframes in days.
STRATEGIES: dict[str, tuple[Strategy, tuple[int, ...]]] = {"golden_cross": (golden_cross, (1, 3, 5)), "vegas_channel_short_term": (channel_strategy, (1, 3, 5))}


def scan_window(df: DataFrame, scan_date: str | Column | None = None, days: int = 1095) -> DataFrame:
    """The last ``days`` before the scan date, which is the last date of the data by default."""
    if scan_date is None:
        last = F.broadcast(df.agg(F.max("date").alias("_last")))
        return df.crossJoin(last).where(F.col("date").between(F.date_sub("_last", days), F.col("_last"))).drop("_last")
    d = F.lit(scan_date).cast("date")
    return df.where(F.col("date").between(F.date_sub(d, days), d))


def score_multi_timeframe(bars: DataFrame, strategy: Strategy, scan_date: str | Column | DataFrame, timeframes: Iterable[int] = (1, 3, 5), name: str = "golden_cross") -> DataFrame:
    """Symbols with a BUY of the first timeframe on the scan date, scored by the BUYs of the others.

    All timeframes are stacked, so bars are shuffled once by symbol; the k-th timeframe weighs k and counts if a
    BUY is among its five latest signals. The scan date may be a table of one row, which is sent to the tasks.
    """
    ns = list(timeframes)
    d = F.col("scan_date")
    if isinstance(scan_date, DataFrame):
        dated = bars.crossJoin(F.broadcast(scan_date.select("scan_date")))
    else:
        dated = bars.withColumn("scan_date", F.lit(scan_date).cast("date"))
    stacked = resample_all(dated.where(F.col("date") <= d), ns, ("scan_date",)).withColumn("timeframe", F.concat(F.col("n").cast("string"), F.lit("d")))
    signals = run_universe(strategy, stacked).where(F.col("signal").isin("BUY", "SELL"))
    place = F.row_number().over(Window.partitionBy("symbol", "n").orderBy(F.desc("date")))
    latest = signals.withColumn("_k", place).where(F.col("_k") <= 5)
    weight = F.element_at(F.create_map(*[x for i, n in enumerate(ns) for x in (F.lit(n), F.lit(i + 1))]), F.col("n"))
    first = (F.col("n") == ns[0]) & (F.col("date") == d)
    buys = latest.where((F.col("signal") == "BUY") & ((F.col("n") != ns[0]) | first))
    best = buys.groupBy("symbol", "n").agg(F.max("date").alias("date"), F.max("scan_date").alias("scan_date"), F.max_by("setup_valid", "date").alias("setup_valid"), F.max_by("close", "date").alias("close"))
    scored = best.groupBy("symbol").agg(
        F.max("scan_date").alias("scan_date"), F.max(F.when(F.col("n") == ns[0], F.col("close"))).alias("price"), F.sum(weight).alias("score"), F.sum(weight * F.col("setup_valid").cast("int")).alias("setup")
    )
    most = sum(range(1, len(ns) + 1))
    confidence = F.least(F.greatest(F.col("score") / most, F.lit(0.0)), F.lit(1.0))
    return scored.where(F.col("price").isNotNull()).select(
        "symbol", d.alias("date"), F.lit("BUY").alias("signal"), "price", confidence.alias("confidence"), (F.col("setup") > 0).alias("setup_valid"), F.lit(True).alias("trigger_met"), F.lit(name).alias("strategy_name")
    )


def score_all_dates(bars: DataFrame, strategy: Strategy, timeframes: Iterable[int] = (1, 3, 5), name: str = "golden_cross", memory: int = 5) -> DataFrame:
    """Y10 for every scan date at once: each BUY of the first timeframe, scored by what the others said by then.

    A walk forward. Each signal of a longer timeframe carries whether a BUY is among the last ``memory`` signals up to
    it, and the setup of the latest such BUY. These states and the BUYs to be scored are put in one order by date, and
    each BUY takes the last state of each timeframe. A bar of several days counts from its first day on, which is its
    date, as in a scan of one date over the same bars. Bars cross the network once, by symbol; only signals come after.
    """
    ns = list(timeframes)
    stacked = resample_all(bars.repartition("symbol"), ns).withColumn("timeframe", F.concat(F.col("n").cast("string"), F.lit("d")))
    signals = run_universe(strategy, stacked).where(F.col("signal").isin("BUY", "SELL")).select("symbol", "n", "date", "signal", F.coalesce("setup_valid", F.lit(False)).alias("setup_valid"), "close")
    latest = Window.partitionBy("symbol", "n").orderBy("date").rowsBetween(1 - memory, 0)
    setup = F.last(F.when(F.col("signal") == "BUY", F.col("setup_valid")), ignorenulls=True).over(latest)
    # Null where no BUY is among the last signals: kept in a struct, so that a later state replaces an earlier one.
    states = signals.withColumn("state", F.struct(setup.alias("setup")))
    by_then = Window.partitionBy("symbol").orderBy("date", F.col("n") == ns[0]).rowsBetween(Window.unboundedPreceding, 0)
    carried = {f"s{n}": F.last(F.when(F.col("n") == n, F.col("state")), ignorenulls=True).over(by_then).setup for n in ns[1:]}
    buys = states.withColumns(carried).where((F.col("n") == ns[0]) & (F.col("signal") == "BUY"))
    setups = [F.col("setup_valid"), *[F.col(f"s{n}") for n in ns[1:]]]
    score = sum((F.when(x.isNotNull(), i + 1).otherwise(0) for i, x in enumerate(setups)), F.lit(0))
    confidence = F.least(F.greatest(score / sum(range(1, len(ns) + 1)), F.lit(0.0)), F.lit(1.0))
    return buys.select(
        "symbol", "date", "signal", F.col("close").alias("price"), confidence.alias("confidence"), F.array_contains(F.array_compact(F.array(*setups)), True).alias("setup_valid"), F.lit(True).alias("trigger_met"), F.lit(name).alias("strategy_name")
    )


def on_last_date(scored: DataFrame) -> DataFrame:
    """The rows of the last date. Every task passes on those of its own last date, so few rows meet."""
    (k,) = fresh(scored, "_k")
    return scored.withColumn(k, F.rank().over(Window.orderBy(F.desc("date")))).where(F.col(k) == 1).drop(k)


def last_signal_date(bars: DataFrame, strategy: Strategy) -> DataFrame:
    """The last date with a BUY on daily bars, as one row ``scan_date``."""
    return run_universe(strategy, bars).where("signal = 'BUY'").agg(F.max("date").alias("scan_date"))


def latest_buys(df: DataFrame, scan_date: str | None = None) -> DataFrame:
    """BUYs of the scan date, or of the last date there is."""
    out = df.where("signal = 'BUY'")
    if scan_date:
        return out.where(F.col("date") == F.lit(scan_date).cast("date"))
    return out.crossJoin(F.broadcast(df.agg(F.max("date").alias("_last")))).where(F.col("date") == F.col("_last")).drop("_last")


def latest_signal(df: DataFrame) -> DataFrame:
    return df.where(F.col("signal").isin("BUY", "SELL")).groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("signal", "date").alias("signal"))


def to_staging(scored: DataFrame, scan_date: str | None = None) -> DataFrame:
    """Y12"""
    d = F.lit(scan_date).cast("date") if scan_date else F.col("date")
    meta = F.to_json(F.struct("setup_valid", "strategy_name"))
    return scored.select(d.alias("scan_date"), "symbol", "strategy_name", "signal", F.col("price").cast("decimal(12,4)").alias("price"), F.col("confidence").cast("decimal(5,4)").alias("confidence"), meta.alias("metadata"))


def rank_picks(signals: DataFrame, top_k: int = 10, by_strategy: bool = True, unique_symbol: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Dense rank by confidence, the first ``top_k`` ranks, each symbol once, then places 1..n; ties by symbol.

    A group is a strategy (and ``also``: the scan date, where there are several), so it holds the picks of one day's
    scan, one row a symbol or few; it is sorted in one task. One exchange serves all windows.
    """
    (group,) = fresh(signals, "_group")
    by = [group, *also]
    out = signals.withColumn(group, F.col("strategy_name") if by_strategy else F.lit("")).repartition(*by)
    out = out.withColumn("dense_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("confidence")))).where(F.col("dense_rank") <= top_k)
    if unique_symbol:
        (k,) = fresh(out, "_k")
        again = Window.partitionBy(*by, "symbol").orderBy(F.desc("confidence"), "strategy_name")
        out = out.withColumn(k, F.row_number().over(again)).where(F.col(k) == 1).drop(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("confidence"), "symbol", "strategy_name"))
    return out.withColumn("rank", place).withColumn("ranking_score", F.col("confidence")).drop(group)
