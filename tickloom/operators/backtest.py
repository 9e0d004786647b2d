"""Back-tests of all symbols over a parameter grid (B operators)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .joins import bars_in_trade

TRADE = "run_id string, symbol string, trade_no long, entry_date date, entry_price double, exit_date date, exit_price double, shares double, reason string, pnl double, pnl_pct double, holding_days long"
EQUITY = "run_id string, symbol string, date date, equity double"
PARAMETERS = "run_id string, stop_loss double, take_profit double, trailing_stop double, max_days long, anchor string, anchor_offset double"


def anchor_price(bars: dict[str, np.ndarray], at: np.ndarray, anchor: str | None, offset: float | None) -> np.ndarray | None:
    """B2: the stops below a price of the entries' bars."""
    if not anchor:
        return None
    return bars[anchor.rsplit("_", 1)[-1].lower()][at] * (1 - (offset or 0.0))


class Search:
    """First bar from a start on whose price is at most, or at least, a threshold: a pyramid of least prices over aligned
    blocks of 1, 2, 4, ... bars. A search climbs until a block holds such a price and comes down to it: time grows with
    the logarithm of the bars passed. All starts are searched at once."""

    def __init__(self, price: np.ndarray) -> None:
        self.n = len(price)
        level = np.append(price, np.inf) if self.n % 2 else price.copy()
        self.levels = [np.where(np.isnan(level), np.inf, level)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1].reshape(-1, 2).min(axis=1)
            self.levels.append(np.append(low, np.inf) if len(low) > 1 and len(low) % 2 else low)

    def first_at_most(self, start: np.ndarray, threshold: np.ndarray, strict: bool = False) -> np.ndarray:
        """The place, or n where there is none."""
        fits = np.less if strict else np.less_equal
        place, found = start.astype(np.int64), np.full(len(start), -1)
        for k, level in enumerate(self.levels):
            # An odd block isn't the beginning of its parent, so it is looked at itself; the root stands for all.
            look = np.flatnonzero((found < 0) & (place < len(level)) & ((place & 1 == 1) | (len(level) == 1)))
            hit = fits(level[place[look]], threshold[look])
            found[look[hit]] = k
            miss = look[~hit]
            place[miss] += 1
            open_ = found < 0
            place[open_] = (place[open_] + 1) >> 1 if len(level) == 1 else place[open_] >> 1
        for k in range(len(self.levels) - 1, 0, -1):
            at = np.flatnonzero(found >= k)
            left = place[at] * 2
            place[at] = np.where(fits(self.levels[k - 1][left], threshold[at]), left, left + 1)
        return np.where(found < 0, self.n, place)


def next_in(flags: np.ndarray) -> np.ndarray:
    """For each place and one past the end: the first place from there on whose flag is set, or the length."""
    n = len(flags)
    at = np.where(flags, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n) if n else np.array([0])


def trailing_exits(close: np.ndarray, below: Search, above: Search, share: float) -> np.ndarray:
    """For each entry bar the first later bar that has fallen by ``share`` from the highest close since.

    Up to the next higher close the entry's own is the highest, so either the fall comes before that, or the exit is
    that of the higher bar: pointers, which are followed by doubling.
    """
    n = len(close)
    after = np.arange(1, n + 1)
    fall = below.first_at_most(after, close * (1 - share))
    higher = above.first_at_most(after, -close, strict=True)
    out = np.append(np.where(fall < higher, fall, n), n)
    to = np.append(np.where(fall < higher, np.arange(n), higher), n)
    while True:
        further = to[to]
        if (further == to).all():
            return out[to][:n]
        to = further


#: Reasons in the order in which they are tested on a bar.
REASONS = ("stop_loss", "stop_loss_anchor", "take_profit", "trailing_stop", "time_based", "signal")


def _exits(bars: dict[str, np.ndarray], entries: np.ndarray, p: dict, price: np.ndarray, below: Search, above: Search) -> tuple[np.ndarray, np.ndarray]:
    """Of each possible entry the bar of its exit (n: none) and the reason's number. A position's exit depends on its entry alone."""
    n, close, days = len(bars["close"]), bars["close"], bars["days"]
    none = np.full(len(entries), n)
    anchor = anchor_price(bars, entries, p["anchor"], p["anchor_offset"])
    firsts = [
        below.first_at_most(entries + 1, price * (1 - p["stop_loss"])) if p["stop_loss"] else none,
        below.first_at_most(entries + 1, anchor) if anchor is not None else none,
        above.first_at_most(entries + 1, -(price * (1 + p["take_profit"]))) if p["take_profit"] else none,
        trailing_exits(close, below, above, p["trailing_stop"])[entries] if p["trailing_stop"] else none,
        np.maximum(np.searchsorted(days, days[entries] + p["max_days"], side="left"), entries + 1) if p["max_days"] else none,
        next_in(bars["leave"])[entries + 1],
    ]
    table = np.stack(firsts)
    return table.min(axis=0), table.argmin(axis=0)


def _walk(bars: dict[str, np.ndarray], p: dict, capital: float, commission: float, slippage: float, below: Search, above: Search) -> tuple[list[tuple], np.ndarray]:
    """B1: one symbol under one parameter row, from trade to trade: exit first, then entry, then the equity."""
    close = bars["close"]
    n, entries = len(close), np.flatnonzero(bars["buy"])
    prices = close[entries] * (1 + slippage)
    exits, why = _exits(bars, entries, p, prices, below, above)
    cash, equity, trades, at, k = capital, np.empty(n), [], 0, 0
    while k < len(entries):
        entry, leave = int(entries[k]), int(exits[k])
        equity[at:entry] = cash
        price = float(prices[k])
        shares = (cash - commission) / price
        cash -= shares * price + commission
        last = min(leave, n - 1)
        equity[entry:leave] = cash + shares * close[entry:leave]
        out = float(close[last]) * (1 - slippage)
        cash += shares * out - commission
        pnl = out - price
        trades.append((entry, price, last, out, shares, REASONS[why[k]] if leave < n else "end_of_data", pnl, pnl / price if price else 0.0))
        at = leave
        if leave >= n:
            equity[n - 1] = cash
            return trades, equity
        k = int(np.searchsorted(entries, leave, side="left"))
    equity[at:] = cash
    return trades, equity


#: Bars as the ledger reads them.
_BARS = ("symbol", "date", "open", "high", "low", "close", "signal", "exit_signal")


def walk(signals: DataFrame, params: DataFrame, capital: float = 10000.0, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """B1: trades (``kind`` trade) and equity (``kind`` equity) of every symbol under every parameter row, in one pass.

    The path of a position depends on itself, so each symbol is walked in one group, once for each parameter row; a
    group holds the bars of one symbol, which cross the network once whatever the grid. The exit of every possible entry
    is searched over all bars at once (``Search``), so a trade costs the same however long it is held. ``params`` is the
    grid that the user lists, so it travels with the code. Bars without a close are passed over. Dates may be times.
    """
    grid = [r.asDict() for r in params.collect()]  # listed by the user: a row a run
    date = signals.schema["date"].dataType
    fields = [*T.StructType.fromDDL(TRADE).fields, *T.StructType.fromDDL(EQUITY).fields[2:]]
    schema = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(f.name, date if isinstance(f.dataType, T.DateType) else f.dataType) for f in fields]])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pc.is_valid(table["close"]))
        if not table.num_rows:
            return arrow.empty_table()
        table = table.take(pc.sort_indices(table, sort_keys=[("date", "ascending")]))
        symbol, dates = table["symbol"][0], table["date"].combine_chunks().cast(arrow.field("date").type)
        bars = {c: table[c].to_numpy().astype(float) for c in ("open", "high", "low", "close")}
        # A day is the unit of holding, also where dates are times.
        bars["days"] = dates.cast(pa.timestamp("us", getattr(dates.type, "tz", None))).cast(pa.int64()).to_numpy() / 86_400_000_000
        for name, column, value in (("buy", "signal", "BUY"), ("leave", "exit_signal", "SELL")):
            bars[name] = pc.fill_null(pc.equal(table[column].cast(pa.string()), value), False).to_numpy()
        below, above = Search(bars["close"]), Search(-bars["close"])
        parts = []

        def part(kind: str, run_id: str, n: int, columns: dict) -> None:
            columns |= {"kind": pa.array([kind] * n, pa.string()), "run_id": pa.array([run_id] * n, pa.string()), "symbol": pa.array([symbol.as_py()] * n, pa.string())}
            parts.append(pa.table({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in arrow}, schema=arrow))

        for p in grid:
            trades, equity = _walk(bars, p, capital, commission, slippage, below, above)
            part("equity", p["run_id"], len(equity), {"date": dates, "equity": pa.array(equity)})
            entry, price, leave, out, shares, reason, pnl, pct = (list(x) for x in zip(*trades, strict=True)) if trades else [[] for _ in range(8)]
            first, last = (dates.take(pa.array(x, pa.int64())) for x in (entry, leave))
            days = np.floor(bars["days"])
            columns = {"trade_no": pa.array(range(1, len(trades) + 1), pa.int64()), "entry_date": first, "exit_date": last, "entry_price": pa.array(price, pa.float64()), "exit_price": pa.array(out, pa.float64())}
            columns |= {"shares": pa.array(shares, pa.float64()), "reason": pa.array(reason, pa.string()), "pnl": pa.array(pnl, pa.float64()), "pnl_pct": pa.array(pct, pa.float64())}
            columns |= {"holding_days": pa.array((days[leave] - days[entry]).astype(np.int64) if trades else [], pa.int64())}
            part("trade", p["run_id"], len(trades), columns)
        return pa.concat_tables(parts) if parts else arrow.empty_table()

    return signals.select(*_BARS).groupBy("symbol").applyInArrow(run, schema)


def backtest(signals: DataFrame, params: DataFrame, capital: float = 10000.0, commission: float = 0.0, slippage: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """B1: (trades, equity); who needs both writes ``walk`` once."""
    both = walk(signals, params, capital, commission, slippage)
    trades, equity = ([c.split()[0] for c in ddl.split(", ")] for ddl in (TRADE, EQUITY))
    return both.where("kind = 'trade'").select(*trades), both.where("kind = 'equity'").select(*equity)


def trade_facts(ledger: DataFrame) -> DataFrame:
    """Pnl per share, in percent, and days."""
    pnl = F.col("exit_price") - F.col("entry_price")
    return ledger.withColumns({"pnl": pnl, "pnl_pct": F.try_divide(pnl, "entry_price"), "holding_days": F.datediff("exit_date", "entry_date").cast("long")})


def periods_per_year(bars: DataFrame) -> DataFrame:
    """From the median spacing of each symbol's bars."""
    gap = F.unix_timestamp(F.col("date").cast("timestamp")) - F.unix_timestamp(F.lag("date").over(Window.partitionBy("symbol").orderBy("date")).cast("timestamp"))
    mid = bars.withColumn("_g", gap).groupBy("symbol").agg(F.percentile("_g", F.lit(0.5)).alias("_s"))
    per = F.when(F.col("_s") < 86400, F.round(252 * 23400 / F.col("_s"))).otherwise(F.round(252 / (F.col("_s") / 86400)))
    return mid.select("symbol", F.when(F.col("_s") > 0, F.greatest(F.lit(1), per.cast("int"))).otherwise(252).alias("periods"))


def trade_metrics(walked: DataFrame, capital: float = 10000.0, by=("run_id",)) -> DataFrame:
    """Counts, means and factor of trades by profit a share, and ``total_return``: what all accounts end with beyond
    their capital, so with all costs. walked: both kinds of rows of ``walk``, read once; a run without trades has zeros."""
    trade = F.col("kind") == "trade"
    gain = lambda x: F.when(trade & (F.sign("pnl") == x), F.col("pnl"))
    sums = {"wins": F.count(gain(1)), "losses": F.count(gain(-1)), "trades": F.count_if(trade), "_w": F.sum(gain(1)), "_l": -F.sum(gain(-1))}
    last = F.max_by(F.col("equity"), F.when(F.col("kind") == "equity", F.col("date")))
    account = walked.groupBy(*by, *[c for c in ("symbol",) if c not in by]).agg(*[v.alias(k) for k, v in sums.items()], last.alias("_last"))
    out = account.groupBy(*by).agg(
        *[F.coalesce(F.sum(k), F.lit(0 if k in ("wins", "losses", "trades") else 0.0)).alias(k) for k in sums], F.sum(F.col("_last") - capital).alias("total_return")
    )
    mean = lambda total, n: F.coalesce(F.try_divide(total, n), F.lit(0.0))
    factor = F.when(F.col("_l") > 0, F.col("_w") / F.when(F.col("_l") > 0, F.col("_l"))).when(F.col("_w") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumns({"win_rate": mean("wins", "trades"), "avg_win": mean("_w", "wins"), "avg_loss": mean(-F.col("_l"), "losses"), "profit_factor": factor}).drop("_w", "_l")


def drawdown_sharpe(equity: DataFrame, periods: int | Column = 252, capital: float = 10000.0, by=("run_id", "symbol")) -> DataFrame:
    """Greatest fall from the running peak, its share of the initial capital, and the Sharpe ratio of bar returns."""
    w = Window.partitionBy(*by).orderBy("date")
    out = equity.withColumn("_peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_r", F.try_divide("equity", F.lag("equity").over(w)) - 1)
    out = out.groupBy(*by).agg(F.max(F.col("_peak") - F.col("equity")).alias("max_drawdown"), F.count("_r").alias("_n"), F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"), F.max_by("equity", "date").alias("final_equity"))
    per = F.lit(periods) if isinstance(periods, int) else periods
    ok = (F.col("_n") >= 2) & (F.col("_s") > 0)
    sharpe = F.when(ok, F.col("_m") / F.when(ok, F.col("_s")) * F.sqrt(per)).otherwise(0.0)
    return out.withColumns({"max_drawdown_pct": F.col("max_drawdown") / capital, "sharpe": sharpe, "total_return": F.col("final_equity") - capital}).drop("_n", "_m", "_s")


def position_history(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Each trade on each day that it was open."""
    days = bars_in_trade(trades, bars.select("symbol", "date", "close"))
    gain = F.col("close") - F.col("entry_price")
    return days.withColumns({"unrealised": gain * F.col("shares"), "unrealised_pct": F.try_divide(gain, "entry_price"), "value": F.col("shares") * F.col("close"), "days_held": F.datediff("date", "entry_date")})


def _log(pnl_pct: str) -> Column:
    return F.log1p(F.greatest(F.col(pnl_pct), F.lit(-0.999999)))


def running_log(trades: DataFrame, into: str = "log_sum") -> DataFrame:
    """The sum of log returns up to each trade of its run, in order of exit, symbol and number.

    No task sorts a whole run: sums by exit date are few, a window over these gives each date its offset, and inside a
    date another window runs.
    """
    x, before, r2, d2 = "_x", "_before", "_run", "_day"
    day = trades.groupBy("run_id", "exit_date").agg(F.sum(_log("pnl_pct")).alias(x))
    w = Window.partitionBy("run_id").orderBy("exit_date").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select(F.col("run_id").alias(r2), F.col("exit_date").alias(d2), F.coalesce(F.sum(x).over(w), F.lit(0.0)).alias(before))
    inside = Window.partitionBy("run_id", "exit_date").orderBy("symbol", "trade_no")
    out = trades.withColumn(x, F.sum(_log("pnl_pct")).over(inside))
    out = out.join(day, out["run_id"].eqNullSafe(day[r2]) & out["exit_date"].eqNullSafe(day[d2]))
    return out.withColumn(into, F.col(x) + F.col(before)).drop(x, before, r2, d2)


def report_metrics(trades: DataFrame, capital: float = 10000.0, instrument: str = "stock", risk_free: float = 0.03) -> DataFrame:
    """Win rate without zero trades, fall in percent of the running peak, Sharpe over the risk-free rate with 365 days, yearly return."""
    days = 365 if instrument == "crypto" else 252
    curve = running_log(trades, "_s")
    # The peak before each trade: of the days before (a row a day), and inside the day.
    day = curve.groupBy("run_id", "exit_date").agg(F.max("_s").alias("_m"))
    w = Window.partitionBy("run_id").orderBy("exit_date").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select(F.col("run_id").alias("_run"), F.col("exit_date").alias("_day"), F.max("_m").over(w).alias("_before"))
    inside = Window.partitionBy("run_id", "exit_date").orderBy("symbol", "trade_no")
    curve = curve.withColumn("_in", F.max("_s").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    curve = curve.join(day, curve["run_id"].eqNullSafe(day["_run"]) & curve["exit_date"].eqNullSafe(day["_day"]))
    fall = 1 - F.exp(F.col("_s") - F.greatest(F.lit(0.0), F.col("_in"), F.col("_before")))
    out = curve.withColumn("_d", fall).groupBy("run_id").agg(
        F.try_divide(F.count_if(F.col("pnl") > 0), F.count_if(F.col("pnl") != 0)).alias("win_rate"), F.max("_d").alias("max_drawdown_pct"), F.avg("pnl_pct").alias("_m"), F.stddev_samp("pnl_pct").alias("_sd"),
        F.sum(_log("pnl_pct")).alias("_total"), F.datediff(F.max("exit_date"), F.min("entry_date")).alias("_span"),
    )
    final = capital * F.exp(F.col("_total"))
    yearly = F.when(F.col("_span") > 0, F.pow(final / capital, F.lit(float(days)) / F.when(F.col("_span") > 0, F.col("_span"))) - 1)
    sharpe = F.when(F.col("_sd") > 0, (F.col("_m") - risk_free / 365) / F.when(F.col("_sd") > 0, F.col("_sd")) * F.sqrt(F.lit(365.0))).otherwise(0.0)
    return out.withColumns({"final": final, "yearly_return": yearly, "sharpe": sharpe}).drop("_m", "_sd", "_total", "_span")


def yearly_returns(trades: DataFrame) -> DataFrame:
    """Compounded return of the trades of each year."""
    return trades.groupBy("run_id", F.year("exit_date").alias("year")).agg((F.exp(F.sum(F.log1p(F.greatest("pnl_pct", F.lit(-0.999999))))) - 1).alias("compounded"), F.count(F.lit(1)).alias("trades"))


def buy_hold(bars: DataFrame) -> DataFrame:
    """B9"""
    peak = F.max("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = bars.withColumn("_f", F.try_divide("close", peak) - 1)
    return out.groupBy("symbol").agg(F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")).alias("ratio"), F.min("_f").alias("max_fall"))


def numbered(trades: DataFrame, by: str = "run_id", into: str = "k") -> DataFrame:
    """Trades numbered 1..n in each run by symbol and number; offsets come from counts by symbol, so no task sorts a whole run."""
    counts = trades.groupBy(by, "symbol").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(by).alias("_run"), F.col("symbol").alias("_symbol"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "symbol").orderBy("trade_no"))
    out = trades.withColumn(into, own)
    out = out.join(counts, out[by].eqNullSafe(counts["_run"]) & out["symbol"].eqNullSafe(counts["_symbol"]))
    return out.withColumn(into, F.col(into) + F.col("_before")).drop("_run", "_symbol", "_before")


#: Places of a draw that one window walks.
CHUNK = 4096


def bootstrap_draws(trades: DataFrame, draws: int = 200, seed: int = 7, by: str = "run_id") -> DataFrame:
    """(run, draw b, place, r): a draw picks a trade's number by a seeded hash, so any executor draws the same."""
    listed = numbered(trades, by).select(by, F.col("pnl_pct").alias("r"), "k")
    sizes = listed.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    spots = listed.select(by, "k").join(sizes, by).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    spots = spots.withColumn("pick", F.pmod(F.xxhash64("b", "k", F.lit(seed)), F.col("n")) + 1)
    return spots.select(by, "b", F.col("k").alias("place"), F.col("pick").alias("k")).join(listed, [by, "k"]).select(by, "b", "place", "r")


def bootstrap_ci(trades: DataFrame, draws: int = 200, seed: int = 7, by: str = "run_id") -> DataFrame:
    """Trades drawn with replacement, ``draws`` times: mean final sum, worst fall and the 5 and 95 percent points.

    Each draw is as long as the run's list of trades; it is walked in chunks of ``CHUNK`` places. A chunk is told by its
    sum, its highest and lowest point and its worst fall, and chunks are put together in order: no window holds a whole draw.
    """
    drawn = bootstrap_draws(trades, draws, seed, by).withColumn("chunk", F.floor((F.col("place") - 1) / CHUNK))
    path = Window.partitionBy(by, "b", "chunk").orderBy("place")
    walk = drawn.withColumn("s", F.sum("r").over(path)).withColumn("peak", F.max("s").over(path)).withColumn("fall", F.col("s") - F.col("peak"))
    parts = walk.groupBy(by, "b", "chunk").agg(F.sum("r").alias("sum"), F.max("s").alias("high"), F.min("s").alias("low"), F.min("fall").alias("fall"))
    order = Window.partitionBy(by, "b").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    parts = parts.withColumn("top", F.greatest(F.lit(0.0), F.max(F.col("base") + F.col("high")).over(before)))
    parts = parts.withColumn("worst", F.least(F.col("fall"), F.col("base") + F.col("low") - F.col("top")))
    ends = parts.groupBy(by, "b").agg(F.sum("sum").alias("final"), F.min("worst").alias("fall"))
    return ends.groupBy(by).agg(F.avg("final").alias("mean_final"), F.least(F.lit(0.0), F.min("fall")).alias("worst_fall"), F.percentile("final", F.lit(0.05)).alias("p5"), F.percentile("final", F.lit(0.95)).alias("p95"))


def portfolio(equity: DataFrame) -> DataFrame:
    """Each run's equity over all symbols, by date. A date's symbols are added in their order, so runs with equal accounts have equal sums."""
    accounts = F.array_sort(F.collect_list(F.struct("symbol", "equity")))
    return equity.groupBy("run_id", "date").agg(F.aggregate(accounts, F.lit(0.0), lambda total, x: total + x["equity"]).alias("equity"))


def grid_best(metrics: DataFrame) -> DataFrame:
    """The best run by Sharpe ratio, by total return and by fall; ties by name.

    Returns are compared as final equities where there are such: what is left of an account may be so little that the
    return, which lies a whole capital below it, is the same number for several runs.
    """
    most = "final_equity" if "final_equity" in metrics.columns else "total_return"
    return metrics.agg(
        F.max(F.struct("sharpe", "run_id")).run_id.alias("best_sharpe"), F.max(F.struct(most, "run_id")).run_id.alias("best_return"), F.min(F.struct("max_drawdown", "run_id")).run_id.alias("least_drawdown")
    )
