"""Hand-made cases: rules that no SQL twin states, edge cases and invariants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, bookkeeping, conditions, indicators, joins, patterns, resample, serving, strategies
from tickloom.sources import readers, sinks

DAY = dt.date(2026, 1, 1)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def linear(spark, *series, days=4):
    rows = [(s, DAY + dt.timedelta(i), base + i, base + i + 1.0, base + i - 1.0, base + i + 0.0, 1000.0) for s, base in series for i in range(days)]
    return spark.createDataFrame([(s, d, float(o), h, low, c, v) for s, d, o, h, low, c, v in rows], BARS)


def test_resample_two_days(spark):
    out = {(r.symbol, r.date): r for r in resample.resample_calendar(linear(spark, ("AAA", 10), ("BBB", 20)), 2).collect()}
    first = out["AAA", min(d for s, d in out if s == "AAA")]
    assert (first.open, first.close, first.high, first.low, first.volume) in {(10, 11, 12, 9, 2000), (10, 10, 11, 9, 1000)}
    assert sum(r.volume for r in out.values()) == 8000


def test_resample_one_day_passes_through(spark):
    b = linear(spark, ("AAA", 10), days=3)
    assert sorted(resample.resample_calendar(b, 1).collect()) == sorted(b.collect())


def test_no_signal_gives_empty_score(spark):
    b = linear(spark, ("AAA", 50), ("BBB", 60), days=120)
    out = strategies.score_multi_timeframe(b, strategies.golden_cross, str(DAY + dt.timedelta(119)))
    assert out.count() == 0 and len(out.columns) == 8


SIGNALS = "symbol string, date string, signal string, price double, confidence double, strategy_name string"


def test_dense_rank_keeps_ties_and_symbols_once(spark):
    rows = [(s, "d", "BUY", 1.0, c, n) for s, c, n in (("AAA", 0.9, "x"), ("BBB", 0.9, "x"), ("CCC", 0.5, "x"), ("DDD", 0.5, "x"), ("EEE", 0.1, "x"), ("AAA", 0.5, "x"))]
    out = strategies.rank_picks(spark.createDataFrame(rows, SIGNALS), top_k=2).orderBy("rank").collect()
    assert [r.symbol for r in out] == ["AAA", "BBB", "CCC", "DDD"] and [r["rank"] for r in out] == [1, 2, 3, 4]
    rows = [("AAA", "d", "BUY", 1.0, 0.9, "golden_cross"), ("BBB", "d", "BUY", 1.0, 0.8, "vegas_channel_short_term")]
    assert strategies.rank_picks(spark.createDataFrame(rows, SIGNALS), top_k=1).count() == 2


def test_ema_and_rsi(spark):
    b = spark.createDataFrame([("A", DAY + dt.timedelta(i), c, c, c, c, 1.0) for i, c in enumerate((1.0, 2.0, 3.0))], BARS)
    assert [r.ema_3 for r in indicators.ema(b, [3]).orderBy("date").collect()] == [1, 1.5, 2.25]
    flat = spark.createDataFrame([("A", DAY + dt.timedelta(i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(15)], BARS)
    values = [r.rsi_14 for r in indicators.rsi(flat).orderBy("date").collect()]
    assert values[:13] == [None] * 13 and math.isnan(values[-1])
    assert indicators.rsi(linear(spark, ("A", 1), days=15)).orderBy(F.desc("date")).first().rsi_14 == 100


def test_symbols_do_not_mix(spark):
    both, alone = linear(spark, ("A", 10), ("B", 99), days=40), linear(spark, ("A", 10), days=40)
    for f in (lambda d: indicators.sma(d, 5), indicators.atr, indicators.stochastic, patterns.all_patterns, lambda d: indicators.ema(d, [8])):
        out = f(both).where("symbol = 'A'")
        assert sorted(map(str, out.collect())) == sorted(map(str, f(alone).select(*out.columns).collect()))


def test_existing_column_is_kept(spark):
    b = linear(spark, ("A", 10)).withColumn("sma_2", F.lit(7.0))
    assert {r.sma_2 for r in indicators.sma(b, 2).collect()} == {7.0}


CANDLES = {
    "engulfing_bullish": [(10, 11, 8, 9), (8.5, 11, 8, 10.5)], "engulfing_bearish": [(9, 11, 8, 10), (10.5, 11, 8, 8.5)],
    "hammer": [(10, 10.1, 8, 10.1)], "shooting_star": [(10, 12, 9.99, 10.05)], "doji": [(10, 11, 9, 10.05)],
    "green_candle": [(9, 11, 8, 10)], "red_candle": [(10, 11, 8, 9)],
    "morning_star": [(20, 21, 10, 11), (10, 11, 9, 10.5), (10.6, 19, 10, 18)], "evening_star": [(10, 21, 9, 20), (21, 22, 20, 20.5), (20, 20, 11, 12)],
}


@pytest.mark.parametrize("name", CANDLES)
def test_pattern_positive_and_flat(spark, name):
    rows = [("A", DAY + dt.timedelta(i), *map(float, c), 1.0) for i, c in enumerate(CANDLES[name])]
    # longer bodies before, so that the mean body is large
    rows = [("A", DAY - dt.timedelta(3 - i), 10.0, 30.0, 9.0, 25.0, 1.0) for i in range(3)] + rows
    assert patterns.pattern(spark.createDataFrame(rows, BARS), name).orderBy(F.desc("date")).first()[name] is True
    flat = [("A", DAY + dt.timedelta(i), 10.0, 14.0, 6.0, 12.0, 1.0) for i in range(4)]
    expected = name == "green_candle"
    assert patterns.pattern(spark.createDataFrame(flat, BARS), name).orderBy(F.desc("date")).first()[name] is expected


def test_condition_trees_are_checked():
    for bad in ({"op": "GT", "left": {"type": "const", "value": 1}}, {"op": "AND", "children": []}, {"op": "XOR", "left": {"type": "const", "value": 1}, "right": {"type": "const", "value": 1}}, {"op": "PATTERN", "name": "moon"}, {"op": "GT", "left": {"type": "indicator", "name": "magic"}, "right": {"type": "const", "value": 1}}):
        with pytest.raises(ValueError):
            conditions._Compiler().tree(bad)


def test_doji_trigger_gives_no_signal(spark):
    out = conditions.apply_trigger(linear(spark, ("A", 10)), {"type": "CANDLE_PATTERN", "pattern": "doji"})
    assert {r.signal for r in out.collect()} == {"HOLD"}


def ledger(spark, closes, params, signals=None, exits=None, **kw):
    n = len(closes)
    rows = [("A", DAY + dt.timedelta(i), c, c, c, c, (signals or {0: "BUY"}).get(i, "HOLD"), (exits or {}).get(i)) for i, c in enumerate(map(float, closes))]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, signal string, exit_signal string")
    base = {"run_id": "r", "stop_loss": None, "take_profit": None, "trailing_stop": None, "max_days": None, "anchor": None, "anchor_offset": None} | params
    trades, equity = backtest.backtest(df, spark.createDataFrame([tuple(base.values())], backtest.PARAMETERS), **kw)
    assert equity.count() == n
    return trades.collect(), equity.orderBy("date").collect()


@pytest.mark.parametrize(
    ("closes", "params", "exits", "reason", "price"),
    [
        ([100, 94, 90], {"stop_loss": 0.05}, None, "stop_loss", 94),
        ([100, 97, 90], {"anchor": "ENTRY_LOW", "anchor_offset": 0.02}, None, "stop_loss_anchor", 97),
        ([100, 111, 90], {"take_profit": 0.1}, None, "take_profit", 111),
        ([100, 120, 110], {"trailing_stop": 0.05}, None, "trailing_stop", 110),
        ([100, 101, 102], {"max_days": 2}, None, "time_based", 102),
        ([100, 101, 102], {}, {1: "SELL"}, "signal", 101),
        ([100, 101, 102], {}, None, "end_of_data", 102),
    ],
)
def test_exit_reasons(spark, closes, params, exits, reason, price):
    (trade,), equity = ledger(spark, closes, params, exits=exits)
    assert (trade.reason, trade.exit_price, trade.pnl) == (reason, price, price - 100)
    assert equity[-1].equity == pytest.approx(100 * price)


def test_costs_and_reentry(spark):
    trades, equity = ledger(spark, [100, 90, 90], {"stop_loss": 0.05}, signals={0: "BUY", 1: "BUY"}, commission=10.0, slippage=0.01)
    assert [t.reason for t in trades] == ["stop_loss", "end_of_data"] and trades[1].entry_date == DAY + dt.timedelta(1)
    cash = (10000 - 10) / 101 * 90 * 0.99 - 10
    assert equity[-1].equity == pytest.approx((cash - 10) / (90 * 1.01) * 90 * 0.99 - 10)


def test_metrics_of_a_ledger(spark):
    rows = [("trade", "r", "A", None, p, None) for p in (2.0, -1.0, 0.0, 4.0)] + [("equity", "r", "A", DAY + dt.timedelta(i), None, e) for i, e in enumerate((10000.0, 9000.0, 10050.0))]
    rows += [("equity", "idle", "A", DAY, None, 10000.0), ("equity", "won", "A", DAY, None, 10001.0), ("trade", "won", "A", None, 1.0, None)]
    found = {m.run_id: m for m in backtest.trade_metrics(spark.createDataFrame(rows, "kind string, run_id string, symbol string, date date, pnl double, equity double")).collect()}
    m = found["r"]
    assert (m.trades, m.wins, m.losses, m.win_rate, m.avg_win, m.avg_loss, m.profit_factor, m.total_return) == (4, 2, 1, 0.5, 3.0, -1.0, 6.0, 50.0)
    assert found["won"].profit_factor == math.inf
    m = found["idle"]
    assert (m.trades, m.wins, m.losses, m.win_rate, m.avg_win, m.avg_loss, m.profit_factor, m.total_return) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_commission_is_part_of_the_return(spark):
    rows = [("A", DAY + dt.timedelta(i), *[float(c)] * 4, "BUY" if i == 0 else "HOLD", None) for i, c in enumerate((100, 105, 110))]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, signal string, exit_signal string")
    grid = spark.createDataFrame([("r", None, None, None, None, None, None)], backtest.PARAMETERS)
    m = backtest.trade_metrics(backtest.walk(df, grid, commission=50.0)).first()
    assert m.total_return == pytest.approx((10000 - 50) / 100 * 110 - 50 - 10000) and m.trades == 1


def walk_bar_by_bar(bars, p, capital, commission, slippage):
    """The ledger by its rules, one bar after the other."""
    cash, shares, held, trades, equity = capital, 0.0, None, [], []
    for date, close, low, buy, sell in bars:
        if held:
            held["peak"] = max(held["peak"], close)
            tests = {
                "stop_loss": p["stop_loss"] and close <= held["price"] * (1 - p["stop_loss"]), "stop_loss_anchor": p["anchor"] and close <= held["low"] * (1 - p["anchor_offset"]),
                "take_profit": p["take_profit"] and close >= held["price"] * (1 + p["take_profit"]), "trailing_stop": p["trailing_stop"] and close <= held["peak"] * (1 - p["trailing_stop"]),
                "time_based": p["max_days"] and (date - held["date"]).days >= p["max_days"], "signal": sell,
            }
            why = next((k for k, v in tests.items() if v), None)
            if why:
                cash += shares * close * (1 - slippage) - commission
                trades.append((held["date"], date, why))
                shares, held = 0.0, None
        if not held and buy:
            price = close * (1 + slippage)
            shares = (cash - commission) / price
            cash -= shares * price + commission
            held = {"date": date, "price": price, "peak": close, "low": low}
        equity.append(cash + shares * close)
    if held:
        cash += shares * bars[-1][1] * (1 - slippage) - commission
        trades.append((held["date"], bars[-1][0], "end_of_data"))
        equity[-1] = cash
    return trades, equity


def test_ledger_by_search_is_the_ledger_bar_by_bar(spark):
    import random

    rng, close, rows = random.Random(8), 100.0, []
    for i in range(700):
        close = round(max(5.0, close * (1 + rng.gauss(0, 0.02))), 1)
        rows.append(("A", DAY + dt.timedelta(i + i // 5 * 2), close, close, close - rng.choice((0.0, 1.0)), close, "BUY" if rng.random() < 0.2 else "HOLD", "SELL" if rng.random() < 0.01 else None))
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, signal string, exit_signal string")
    names = [c.split()[0] for c in backtest.PARAMETERS.split(", ")]
    grid = [("stop", 0.05, 0.1, None, None, None, 0.0), ("trail", None, None, 0.07, None, None, 0.0), ("all", 0.04, 0.3, 0.06, 30, "ENTRY_LOW", 0.02), ("time", None, None, None, 3, None, 0.0), ("none", None, None, None, None, None, 0.0)]
    trades, equity = backtest.backtest(df, spark.createDataFrame(grid, backtest.PARAMETERS), commission=3.0, slippage=0.001)
    trades, equity = trades.orderBy("trade_no").collect(), equity.orderBy("date").collect()
    for row in grid:
        expected = walk_bar_by_bar([(r[1], r[5], r[4], r[6] == "BUY", r[7] == "SELL") for r in rows], dict(zip(names, row, strict=True)), 10000.0, 3.0, 0.001)
        assert [(r.entry_date, r.exit_date, r.reason) for r in trades if r.run_id == row[0]] == expected[0]
        assert [r.equity for r in equity if r.run_id == row[0]] == pytest.approx(expected[1], rel=1e-9)


def test_search_looks_at_few_bars():
    """Every first place is right, and the way there is a logarithm: 2**16 bars have 17 levels."""
    import numpy as np

    rng = np.random.default_rng(2)
    price = rng.integers(0, 1000, 3000).astype(float)
    start, threshold = rng.integers(0, 3001, 800), rng.integers(-5, 60, 800).astype(float)
    expected = [next((j for j in range(s, 3000) if price[j] <= t), 3000) for s, t in zip(start.tolist(), threshold.tolist(), strict=True)]
    assert backtest.Search(price).first_at_most(start, threshold).tolist() == expected
    for n in range(1, 20):
        s = backtest.Search(price[:n])
        for a in range(n + 1):
            assert s.first_at_most(np.array([a]), np.array([400.0]))[0] == next((j for j in range(a, n) if price[j] <= 400), n)
    assert len(backtest.Search(np.zeros(1 << 16)).levels) == 17


def test_ledger_over_times(spark):
    """Bars of hours: dates are times, and days of holding are whole days."""
    at = dt.datetime(2026, 1, 5, 10)
    rows = [("A", at + dt.timedelta(hours=h), 100.0 + h, 100.0 + h, 100.0 + h, 100.0 + h, "BUY" if h == 0 else "HOLD", None) for h in range(60)]
    df = spark.createDataFrame(rows, "symbol string, date timestamp, open double, high double, low double, close double, signal string, exit_signal string")
    (trade,) = backtest.backtest(df, spark.createDataFrame([("r", None, None, None, 2, None, None)], backtest.PARAMETERS))[0].collect()
    assert (trade.entry_date, trade.exit_date, trade.reason, trade.holding_days) == (at, at + dt.timedelta(hours=48), "time_based", 2)


def test_nested_exits_and_kinds_without_effect(spark):
    leaf = lambda kind, value: {"type": kind, "value": value}
    nested = {"type": "CONDITIONAL_OR_FIXED", "conditions": [leaf("TAKE_PROFIT_PCT", 0.2), {"type": "CONDITIONAL_OR_FIXED", "conditions": [leaf("STOP_LOSS_PCT", 0.05), leaf("STOP_LOSS_ATR", 2), {"type": "CONDITIONAL_OR_FIXED", "conditions": [leaf("TRAILING_STOP_PCT", 0.1)]}]}]}
    found = conditions.exit_parameters(nested)
    assert (found["take_profit"], found["stop_loss"], found["trailing_stop"]) == (0.2, 0.05, 0.1)
    b = linear(spark, ("A", 10), days=5)
    for kind in ("INDICATOR_SIGNAL", "COMBINED", "STOP_LOSS_ATR", "TAKE_PROFIT_ATR"):
        assert {r.exit_signal for r in conditions.apply_exit(b, {"type": kind, "value": 2}).collect()} == {None}
        assert set(conditions.exit_parameters({"type": kind, "value": 2}).values()) == {None, 0.0}
    with pytest.raises(ValueError, match="unknown exit"):
        conditions.exit_parameters({"type": "CONDITIONAL_OR_FIXED", "conditions": [{"type": "CONDITIONAL_OR_FIXED", "conditions": [leaf("STOP_LOS", 1)]}]})


def test_documents_over_hours(spark):
    """A setup of four hours, a trigger of one hour, on bars of 15 minutes."""
    at = dt.datetime(2026, 1, 5)
    rows = [("A", at + dt.timedelta(minutes=15 * i), c, c + 1, c - 1, c + (0.5 if i % 3 else -0.5), 10.0) for i, c in enumerate(50.0 + (i * 7) % 11 for i in range(160))]
    b = spark.createDataFrame(rows, BARS.replace("date date", "date timestamp"))
    green = lambda t: {"type": "CANDLE_PATTERN", "pattern": "GREEN_CANDLE", "timeframe": t}
    config = {"timeframe": "15m", "components": {"setup": {"type": "INDICATOR_THRESHOLD", "indicator": "SMA", "params": {"period": 3}, "operator": ">", "value": 0, "timeframe": "4h"}, "trigger": green("1h"), "exit": {}}}
    out = conditions.run_document(b, config)
    hours = {r.date: r for r in resample.resample_time(b, 3600).collect()}
    assert len(hours) == 40 and out.count() == 160
    for r in out.collect():
        setup = r.date >= at + dt.timedelta(hours=8)  # from the third bar of four hours on
        assert r.setup_valid == setup
        assert r.signal == ("BUY" if setup and r.date in hours and hours[r.date].close > hours[r.date].open else "HOLD")
    with pytest.raises(ValueError, match="needs bars with times"):
        conditions.run_document(linear(spark, ("A", 10)), {"timeframe": "1d", "components": {"trigger": green("1h")}})
    with pytest.raises(ValueError, match="unknown timeframe"):
        conditions.run_document(b, {"timeframe": "15m", "components": {"trigger": green("0h")}})


def test_walk_forward_is_a_scan_of_each_date(spark):
    """Scores of all dates against the rule, date by date, for a strategy that sells too."""
    import random

    rng = random.Random(3)
    rows = [(s, DAY + dt.timedelta(i), 1.0, 1.0, 1.0, float(rng.randrange(6)), 1.0) for s in ("A", "B") for i in range(120) if rng.random() < 0.9]

    def strategy(df):
        kind = F.when(F.col("close") >= 4, "BUY").when(F.col("close") <= 2, "SELL").otherwise("HOLD")
        return df.withColumns({"signal": kind, "setup_valid": F.col("close") == 5, "exit_signal": F.lit(None).cast("string")})

    b = spark.createDataFrame(rows, BARS)
    frames = {n: sorted((r.symbol, r.date, r.close) for r in resample.resample_calendar(b, n).collect()) for n in (1, 3, 5)}
    expected = {}
    for s, d, c in frames[1]:
        if c < 4:
            continue
        score, setup = 1, c == 5
        for weight, n in ((2, 3), (3, 5)):
            last = [x for x in frames[n] if x[0] == s and x[1] <= d and (x[2] >= 4 or x[2] <= 2)][-5:]
            buys = [x for x in last if x[2] >= 4]
            score += weight * bool(buys)
            setup |= bool(buys) and buys[-1][2] == 5
        expected[s, d] = (c, pytest.approx(score / 6), setup, True)
    got = strategies.score_all_dates(b, strategy)
    assert {(r.symbol, r.date): (r.price, r.confidence, r.setup_valid, r.trigger_met) for r in got.collect()} == expected and len(expected) > 40
    last = max(d for _, d in expected)
    assert {r.symbol for r in strategies.on_last_date(got).collect()} == {s for s, d in expected if d == last}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_candidates_of_hand_made_alerts(spark):
    """Weights are places among all intervals of the alerts; touches of all kinds count."""
    from tickloom.operators import alerts

    day = lambda k: DAY + dt.timedelta(k)
    rows = [("A", 3, day(0), "ema_touch", "support"), ("A", 3, day(1), "ema_touch", "neutral"), ("B", 3, day(0), "ema_touch", "support"), ("C", 1, day(0), "momentum_alert", "accelerated"),
            ("D", 3, day(0), "momentum_alert", "accelerated"), ("E", 5, day(0), "momentum_alert", "accelerated"), ("E", 5, day(0), "ema_touch", "support"), ("F", 8, day(0), "velocity_alert", "velocity_maintained"),
            ("F", 13, day(0), "velocity_alert", "velocity_maintained"), ("G", 8, day(1), "velocity_alert", "velocity_weak"), ("H", 3, day(1), "momentum_alert", "decelerated"), ("H", 3, day(1), "momentum_alert", "accelerated")]
    table = spark.createDataFrame(rows, "symbol string, interval int, date date, alert_type string, signal string")
    lists = lambda df: {r.category: r.symbols for r in df.collect()}
    assert lists(alerts.candidates_accumulating(table)) == {"accumulating": ["A"]}
    assert lists(alerts.candidates_micro(table)) == {"accelerating": ["D"], "long_accelerating": ["E"], "long_accumulating": ["E"]}
    assert lists(alerts.candidates_macro(table)) == {"velocity_maintained": ["F"]}
    by_date = alerts.candidates_by_date(table).collect()
    assert [(r.date, r.accelerating, r.long_accelerating, r.long_accumulating, r.velocity_maintained) for r in by_date] == [(day(1), [], [], [], []), (day(0), ["D"], ["E"], ["E"], ["F"])]
    assert lists(alerts.latest_candidates(alerts.candidates_by_date(table))) == {k: [] for k in alerts.CATEGORIES}
    assert alerts.latest_candidates(alerts.candidates_by_date(table.limit(0))).count() == 0


def test_asof_before_first_is_null(spark):
    b = linear(spark, ("A", 10), days=5).select("symbol", "date", "close")
    h = spark.createDataFrame([("A", DAY + dt.timedelta(2), 7.0)], "symbol string, date date, s double")
    assert [r.s for r in joins.asof_state(b, h, ["s"]).orderBy("date").collect()] == [None, None, 7.0, 7.0, 7.0]
    e = h.withColumn("signal", F.lit("BUY"))
    assert [r.signal for r in joins.asof_event(b, e, "signal", "HOLD").orderBy("date").collect()] == ["HOLD", "HOLD", "BUY", "HOLD", "HOLD"]


def test_cooldown_modes(spark):
    b = linear(spark, ("A", 10), days=200)
    a, o = (strategies.momentum_signal(b, mode=m).where("momentum IS NOT NULL").count() for m in ("documented", "observed"))
    assert a <= o


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    new = spark.createDataFrame([("B", 3), ("C", 4)], "k string, v int")
    once = sinks.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("A", 1), ("B", 3), ("C", 4)]
    assert sorted(map(tuple, sinks.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_bronze_round_trip(spark, tmp_path):
    b = linear(spark, ("AAA", 10), ("BBB", 5)).withColumn("timestamp", F.col("date").cast("timestamp")).withColumn("interval", F.lit("1d"))
    sinks.write_bronze(b.drop("date"), str(tmp_path / "b"))
    assert readers.read_bronze(spark, str(tmp_path / "b"), columns=["symbol", "close", "timestamp"]).count() == 8
    day = readers.read_bronze(spark, str(tmp_path / "b"), dates=[str(DAY)], columns=["symbol", "close", "timestamp"])
    assert sorted(r.close for r in day.collect()) == [5, 10]
    with pytest.raises(ValueError):
        readers.read_bronze(spark, str(tmp_path / "b"), columns=["nothing"])


def test_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"symbol": "A"}, {"symbol": "B"}]')
    (tmp_path / "m.json").write_text('{"part_keys": ["a.json"]}')
    (tmp_path / "n.json").write_text('{"metadata": [{"symbol": "C"}]}')
    (tmp_path / "x.json").write_text('{"other": 1}')
    assert readers.read_metadata_manifest(spark, str(tmp_path / "m.json")).count() == 2
    assert readers.read_metadata_manifest(spark, str(tmp_path / "n.json")).first().symbol == "C"
    with pytest.raises(ValueError):
        readers.read_metadata_manifest(spark, str(tmp_path / "x.json"))


def test_parse_ts(spark):
    rows = [("2024-01-02T03:04:05Z",), ("1704164645000",), ("1704164645",), ("soon",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.unix_timestamp(readers.parse_ts(F.col("t")))).collect()]
    assert out == [1704164645] * 3 + [None, None]


def test_horizons():
    assert readers.parse_horizons(None) == [1, 5, 21] and readers.parse_horizons("5,1,5") == [1, 5]
    with pytest.raises(ValueError):
        readers.parse_horizons("0")


def test_trading_days_and_session(spark):
    holidays = spark.createDataFrame([(dt.date(2026, 1, 1),)], "date date")
    days = bookkeeping.trading_days(spark, "2025-12-31", "2026-01-05", holidays).orderBy("date").collect()
    assert [r.date.day for r in days] == [31, 2, 5] and days[0].next == dt.date(2026, 1, 2)
    rows = [("2026-01-05 14:29:00",), ("2026-01-05 14:30:00",), ("2026-01-05 21:00:00",), ("2026-01-04 15:00:00",)]
    out = spark.createDataFrame(rows, "t string").select(bookkeeping.in_session(F.col("t").cast("timestamp"))).collect()
    assert [r[0] for r in out] == [False, True, False, False]


def test_screener_sort_is_checked(spark):
    with pytest.raises(ValueError):
        serving.order_by(linear(spark, ("A", 1)), "password:desc")


def test_all_indicators_exchange_once(spark):
    plan = indicators.all_indicators(linear(spark, ("A", 10), days=30))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_nan_and_null_stay_apart_in_the_bundle(spark):
    flat = spark.createDataFrame([("A", DAY + dt.timedelta(i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(20)], BARS)
    out = indicators.all_indicators(flat).orderBy("date").collect()
    assert out[0].rsi_14 is None and math.isnan(out[-1].rsi_14) and math.isnan(out[-1].stoch_k_14_3) and out[-1].ema_8 == 5


def test_series_are_told_apart_where_timeframes_are_stacked(spark):
    """A strategy over stacked timeframes gives what it gives on each alone."""
    rows = []
    for s in "AB":
        for i in range(130):
            c = 100 + 10 * math.sin(i / (7 if s == "A" else 11)) + i / 9
            rows.append((s, DAY + dt.timedelta(i), c - 0.5 + i % 2, c + 2, c - 2, c, 100.0 + i % 13))
    daily = spark.createDataFrame(rows, BARS)
    parts = {"1d": daily, "5d": resample.resample_calendar(daily, 5).select(*daily.columns)}
    stacked = parts["1d"].withColumn("timeframe", F.lit("1d")).unionByName(parts["5d"].withColumn("timeframe", F.lit("5d")))
    sma = lambda n: {"indicator": "SMA", "params": {"period": n}}
    leave = {"type": "CONDITIONAL_OR_FIXED", "conditions": [{"type": "INDICATOR_CROSS", "indicator": "rsi_14", "direction": "DOWN", "value": 60}]}
    for setup in ({"type": "RSI_MOMENTUM", "min": 40}, {"type": "SMA_TREND", "fast": 5, "slow": 15}, {"type": "MACD_TREND"}, {"type": "INDICATOR_THRESHOLD", "indicator": "SMA", "params": {"period": 5}, "operator": ">", "indicator2": "sma_15"}):
        for trigger in ({"type": "BREAKOUT"}, {"type": "REVERSAL", "reversal": "RSI_OVERSOLD"}, {"type": "EXPRESSION", "expression": {"op": "CROSS_ABOVE", "left": sma(3), "right": sma(8)}}):
            run = conditions.compile_strategy({"components": {"setup": setup, "trigger": trigger, "exit": leave}})
            names = ("symbol", "date", "setup_valid", "signal", "exit_signal")
            both = run(stacked)
            for name, alone in parts.items():
                assert sorted(map(str, both.where(F.col("timeframe") == name).select(*names).collect())) == sorted(map(str, run(alone).select(*names).collect())), (setup, trigger, name)


def test_strategy_documents_are_read_and_checked(spark):
    document = {"strategy_name": "x", "components": {"trigger": {"type": "CANDLE_PATTERN", "pattern": "BULLISH_ENGULFING"}, "exit": {"type": "STOP_LOSS_PCT", "value": 0.04}}}
    assert {r.signal for r in conditions.run_document(linear(spark, ("A", 10)), document).collect()} == {"HOLD"}
    bad = [
        lambda: conditions.apply_exit(linear(spark, ("A", 1)), {"type": "STOP_SOMETIMES"}), lambda: conditions.exit_parameters({"type": "CONDITIONAL_OR_FIXED", "conditions": [{"type": "STOP"}]}),
        lambda: conditions.apply_trigger(linear(spark, ("A", 1)), {"type": "CANDLE_PATTERN", "pattern": "moon"}), lambda: conditions.apply_trigger(linear(spark, ("A", 1)), {"type": "PRICE_CROSSOVER"}),
        lambda: conditions.apply_setup(linear(spark, ("A", 1)), {"type": "INDICATOR_THRESHOLD", "indicator": "RSI", "operator": "~", "value": 1}), lambda: conditions.apply_setup(linear(spark, ("A", 1)), {"type": "WEATHER"}),
        lambda: conditions.run_document(linear(spark, ("A", 1)), {"components": {"setup": {"type": "NONE", "timeframe": "1w"}, "trigger": {"type": "BREAKOUT"}}}), lambda: indicators.indicator("RSI", {"length": 3}), lambda: indicators.indicator("RSI", None, "upper"),
        lambda: conditions.exit_parameters({"type": "STOP_LOSS_PCT", "value": 5}), lambda: conditions.exit_parameters({"type": "STOP_LOSS_ANCHOR", "anchor": "ENTRY_LOW", "offset_pct": 1}),
        lambda: conditions.apply_setup(linear(spark, ("A", 1)), {"type": "SMA_TREND", "fast": 50, "slow": 20}), lambda: conditions.apply_setup(linear(spark, ("A", 1)), {"type": "RSI_MOMENTUM", "max": 101}),
    ]
    for f in bad:
        with pytest.raises(ValueError):
            f()
    green = conditions.apply_trigger(linear(spark, ("A", 10)).withColumn("close", F.col("open") + 1), {"type": "CANDLE_PATTERN", "pattern": "green"})
    assert {r.signal for r in green.collect()} == {"BUY"}


@pytest.mark.parametrize(
    ("rule", "closes", "reason"),
    [
        ({"type": "STOP_LOSS_PCT", "value": 0.05}, [100, 94, 90], "stop_loss"), ({"type": "TAKE_PROFIT_PCT", "value": 0.1}, [100, 111, 90], "take_profit"), ({"type": "TRAILING_STOP_PCT", "value": 0.05}, [100, 120, 110], "trailing_stop"),
        ({"type": "TIME_BASED", "max_holding_days": 2}, [100, 101, 102], "time_based"), ({"type": "STOP_LOSS_ANCHOR", "anchor": "ENTRY_LOW", "offset_pct": 0.02}, [100, 97, 90], "stop_loss_anchor"),
    ],
)
def test_rules_of_a_document_reach_the_ledger(spark, rule, closes, reason):
    for component in (rule, {"type": "CONDITIONAL_OR_FIXED", "conditions": [rule, {"type": "INDICATOR_CROSS", "indicator": "RSI", "direction": "DOWN", "value": 70}]}):
        (trade,), _ = ledger(spark, closes, conditions.exit_parameters(component))
        assert trade.reason == reason


def test_states_hold_on_and_events_do_not(spark):
    """A 2-day setup holds until its next bar; a 2-day trigger fires on its own date only."""
    b = linear(spark, ("A", 10), days=12)
    document = {"timeframe": "1d", "components": {
        "setup": {"type": "EXPRESSION", "timeframe": "4d", "expression": {"op": "GT", "left": {"price": "close"}, "right": {"const": 14}}},
        "trigger": {"type": "EXPRESSION", "timeframe": "2d", "expression": {"op": "GT", "left": {"price": "close"}, "right": {"const": 0}}},
    }}
    out = conditions.run_document(b, document).orderBy("date").collect()
    starts = {d: {r.date for r in resample.resample_calendar(b, d).collect()} for d in (2, 4)}
    four = {r.date: r.close > 14 for r in resample.resample_calendar(b, 4).collect()}
    for r in out:
        seen = [d for d in four if d <= r.date]
        assert r.setup_valid == (four[max(seen)] if seen else False)
        assert r.signal == ("BUY" if r.date in starts[2] and r.setup_valid else "HOLD")


def test_columns_of_the_user_survive(spark):
    names = ("_gain", "_loss", "_g", "_l", "_tr", "_lo", "_hi", "_c", "_w", "_b", "_n", "_k", "_e0", "_t", "_a", "_level", "_body1", "_dates", "_up", "_row", "_total_bad", "_nb", "_ng", "_group")
    b = linear(spark, ("A", 10), days=6).withColumns({c: F.lit(7) for c in names})
    for f in (indicators.rsi, indicators.atr, indicators.stochastic, indicators.density_area, patterns.all_patterns, strategies.momentum_signal, lambda d: strategies.golden_cross(d, 2, 3, 1),
              lambda d: conditions.compile_strategy({"components": {"trigger": {"type": "PRICE_CROSSOVER", "level": 12}, "exit": {"type": "EXPRESSION", "expression": {"op": "CROSS_ABOVE", "left": {"price": "close"}, "right": {"const": 12}}}}})(d)):
        assert {tuple(r[c] for c in names) for r in f(b).collect()} == {(7,) * len(names)}
    two = indicators.sma(indicators.sma(b, 2), 2, price="volume")
    assert {"sma_2", "sma_2_volume"} <= set(two.columns)


def test_bootstrap_against_its_own_draws(spark, monkeypatch):
    """Chunks put together give what walking each draw from end to end gives."""
    rows = [("r", s, k, round(0.1 * math.sin(37 * k + ord(s)), 6)) for s in "ABC" for k in range(1, 15)]
    trades = spark.createDataFrame(rows, "run_id string, symbol string, trade_no long, pnl_pct double")
    monkeypatch.setattr(backtest, "CHUNK", 5)
    draws = {}
    for r in backtest.bootstrap_draws(trades, 9).collect():
        draws.setdefault(r.b, {})[r.place] = r.r
    finals, worst = [], 0.0
    for d in draws.values():
        total = peak = 0.0
        assert sorted(d) == list(range(1, 43))
        for place in sorted(d):
            total += d[place]
            peak = max(peak, total)
            worst = min(worst, total - peak)
        finals.append(total)
    out = backtest.bootstrap_ci(trades, 9).first()
    assert len(draws) == 9 and out.mean_final == pytest.approx(sum(finals) / 9) and out.worst_fall == pytest.approx(worst)
    assert [r.k for r in backtest.numbered(trades).orderBy("symbol", "trade_no").collect()] == list(range(1, 43))


def test_correlation_in_tiles_is_the_same(spark):
    rows = [(s, DAY + dt.timedelta(i), *[10 + math.sin(i * (k + 1)) + k] * 4, 1.0) for k, s in enumerate("ABCDEF") for i in range(25) if (i + k) % 5]
    b = spark.createDataFrame(rows, BARS)
    one, many = ({(r.a, r.b): (r.n, round(r.corr, 9)) for r in serving.return_correlation(b, str(DAY + dt.timedelta(24)), tile=n).collect()} for n in (99, 2))
    assert one == many and len(one) == 15


def test_all_alerts_is_one_pass(spark):
    from tickloom.operators import alerts

    b = linear(spark, ("A", 10), days=30).withColumn("interval", F.lit(1))
    plan = alerts.all_alerts(b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_upsert_on_disk_writes_only_what_it_touches(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    sinks.upsert_table(spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1)], "k string, p int, v int"), path, ["k"], ["p"])
    before = {f for f in os.listdir(f"{path}/p=2")}
    for _ in range(2):
        sinks.upsert_table(spark.createDataFrame([("b", 1, 5), ("d", 1, 6)], "k string, p int, v int"), path, ["k"], ["p"])
        assert sorted((r.k, r.p, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1, 1), ("b", 1, 5), ("c", 2, 1), ("d", 1, 6)]
    assert {f for f in os.listdir(f"{path}/p=2")} == before


def test_staged_upsert_statement():
    sql = sinks.merge_statement("t", "s", ["k"], ["k", "v"])
    assert sql == "MERGE INTO t t USING s s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)"


def test_staged_upsert_in_a_database(spark, tmp_path):
    """Derby comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    frame = lambda *rows: spark.createDataFrame(list(rows), "K int, V int")
    sinks.write_jdbc(frame((1, 1), (2, 1)), url, "BARS")
    for _ in range(2):
        sinks.upsert_jdbc(frame((2, 5), (3, 6)), url, "BARS", ["K"])
        assert sorted(map(tuple, readers.read_jdbc(spark, url, "BARS").collect())) == [(1, 1), (2, 5), (3, 6)]


def test_holidays_have_no_session(spark):
    rows = [("2026-01-05 15:00:00",), ("2026-01-06 15:00:00",), (None,)]
    holidays = spark.createDataFrame([(dt.date(2026, 1, 5),)], "date date")
    out = bookkeeping.with_session(spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("t")), "t", holidays).collect()
    assert sorted((str(r.t), r.in_session) for r in out) == [("2026-01-05 15:00:00", False), ("2026-01-06 15:00:00", True), ("None", False)]


@pytest.mark.parametrize("days", [1, 3, 17, 1000])
def test_averages_in_spans_are_the_averages(spark, days):
    """Whatever the spans, with gaps in the prices: at the start, over whole spans, and where spans meet."""
    import random

    rng = random.Random(days)
    price = lambda s, i: None if (s == "B" and (i < 9 or 40 < i < 80 or i % 7 == 3)) or s == "C" else 50 + rng.random() * 9
    rows = [(s, DAY + dt.timedelta(i), 1.0, 1.0, 1.0, price(s, i), 1.0) for s in ("A", "B", "C", None) for i in range(150) if rng.random() < 0.9]
    b = spark.createDataFrame(rows, BARS)
    one, many = indicators.ema(b, (3, 20, 169)), indicators.ema(b, (3, 20, 169), days=days)
    assert one.schema == many.schema
    of = lambda df: {(r.symbol, r.date): (r.close, r.ema_3, r.ema_20, r.ema_169) for r in df.collect()}
    left, right = of(one), of(many)
    assert left.keys() == right.keys() and len(left) == len(rows)
    for k, values in left.items():
        for x, y in zip(values, right[k], strict=True):
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-11), k
    assert indicators.ema(many, (3,), days=days).columns == many.columns


def test_forward_returns_read_the_bars_once(spark):
    b = linear(spark, ("A", 10), ("B", 20), days=8)
    picks = spark.createDataFrame([("A", DAY - dt.timedelta(3), 1.0), ("A", DAY + dt.timedelta(2), 12.0), ("B", DAY + dt.timedelta(7), 5.0), ("Z", DAY, 5.0), ("A", DAY + dt.timedelta(2), 12.0)], "symbol string, scan_date date, price double")
    out = joins.nth_bar_after(picks, b, (1, 3), last="last")
    got = sorted((r.symbol, r.scan_date, r.close_1, r.close_3, r["last"]) for r in out.collect())
    assert got == [("A", DAY - dt.timedelta(3), 10.0, 12.0, 17.0), ("A", DAY + dt.timedelta(2), 13.0, 15.0, 17.0), ("A", DAY + dt.timedelta(2), 13.0, 15.0, 17.0), ("B", DAY + dt.timedelta(7), None, None, 27.0), ("Z", DAY, None, None, None)]
    assert out.columns == ["symbol", "scan_date", "price", "close_1", "close_3", "last"]


def test_means_by_running_totals_are_the_means(spark):
    """Nulls, strange values, tiny and large prices; equal windows have equal means."""
    import random

    rng = random.Random(6)
    value = {"A": lambda i: round(rng.random() * 100, 2), "B": lambda i: None if i % 11 == 0 else rng.random() * 1e-7, "C": lambda i: float("nan") if i == 30 else 1e12 * rng.random(), "D": lambda i: 0.1}
    b = spark.createDataFrame([(s, DAY + dt.timedelta(i), 1.0, 1.0, 1.0, f(i), 1.0) for s, f in value.items() for i in range(120)], BARS)
    out = indicators.smas(b, (1, 5, 40)).withColumns({f"d_{p}": indicators.full(F.avg, "close", p) for p in (1, 5, 40)}).collect()
    for r in out:
        for p in (1, 5, 40):
            x, y = r[f"sma_{p}"], r[f"d_{p}"]
            assert (x is None) == (y is None) and (x is None or (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, rel=1e-9)), (r, p)
    assert {r.sma_5 for r in out if r.symbol == "D" and r.sma_5 is not None} == {0.1}
    plan = indicators.smas(b, (50, 200))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_grid_best_tells_accounts_apart_that_are_nearly_empty(spark):
    """A return of -10,000 and next to nothing left: the final equities differ, the returns don't."""
    left = {"a": 1e-37, "b": 1e-183, "c": 1e-205}
    rows = [(run, s, DAY + dt.timedelta(i), x) for run, end in left.items() for s in ("A", "B", "C") for i, x in enumerate((10000.0, 9000.0, 11000.0, end))]
    equity = backtest.portfolio(spark.createDataFrame(rows, backtest.EQUITY))
    metrics = backtest.drawdown_sharpe(equity, by=("run_id",))
    assert {r.total_return for r in metrics.collect()} == {-10000.0}
    best = backtest.grid_best(metrics).collect()[0]
    assert (best.best_return, best.least_drawdown) == ("a", "a")


def test_portfolio_adds_symbols_in_their_order(spark):
    values = {"A": 0.1, "B": 0.2, "C": 0.3, "D": 1e16, "E": -1e16}
    rows = [("x", s, DAY, v) for s, v in values.items()] + [("y", s, DAY, v) for s, v in reversed(values.items())]
    got = {r.run_id: r.equity for r in backtest.portfolio(spark.createDataFrame(rows, backtest.EQUITY).repartition(3)).collect()}
    assert got["x"] == got["y"] == 0.1 + 0.2 + 0.3 + 1e16 - 1e16


def test_candidates_read_the_alerts_once(spark):
    from tickloom.operators import alerts

    rows = [(s, DAY + dt.timedelta(i), *[50 + 20 * math.sin(i / (7 + 3 * k)) + j for j in (0, 1, -1, 0.5)], 1.0) for k, s in enumerate("ABCDE") for i in range(300)]
    widths = resample.resample_all(spark.createDataFrame(rows, BARS), (1, 3, 5, 8)).withColumnRenamed("n", "interval")
    weighed = alerts.weighed_alerts(widths, 40)
    for find in (alerts.candidates_micro, alerts.candidates_macro, alerts.candidates_accumulating):
        plan = find(weighed)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 1 and "SortMergeJoin" not in plan
        # Over a plain table of alerts the places are found anew.
        assert sorted(find(weighed).collect()) == sorted(find(alerts.on_last_days(alerts.all_alerts(widths), 40)).collect())
    assert alerts.candidates_by_date(weighed).collect() == alerts.candidates_by_date(weighed.drop("w")).collect()
    ends = resample.last_buckets(spark.createDataFrame(rows, BARS).agg(F.max("date").alias("date")), (1, 3, 5, 8))
    assert sorted(ends.collect()) == sorted(widths.groupBy("interval").agg(F.max("date")).collect())


def test_averages_of_series_in_one_group_are_those_of_each_alone(spark):
    rows = [(s, DAY + dt.timedelta(i), 1.0, 1.0, 1.0, None if i % (k + 4) == k else math.cos(i * (k + 1)), 1.0, f"{k}d") for s in "AB" for k in range(3) for i in range(30 + k)]
    b = spark.createDataFrame(rows, BARS + ", timeframe string")
    for step in (lambda x: indicators.ema(x, (3, 8)), lambda x: indicators.macd(x)):
        alone = [r for k in range(3) for r in step(b.where(F.col("timeframe") == f"{k}d").drop("timeframe")).withColumn("timeframe", F.lit(f"{k}d")).select(step(b).columns).collect()]
        assert sorted(map(str, step(b).collect())) == sorted(map(str, alone))
