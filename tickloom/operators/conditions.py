"""Condition trees and strategy components compiled to columns (X, U, T, V operators).

A tree is compiled in steps, because window functions don't nest: first the indicators and patterns it names
are added, then the previous values of what crosses, then one boolean column. Helper columns have names of their
own and are dropped.

A strategy document is JSON: ``strategy_name``, ``timeframe`` and ``components`` (setup, trigger, exit). Operands are
``{"indicator": name, "params": .., "output": ..}``, ``{"price": field}`` or ``{"const": number}``; AND and OR take
``conditions``, NOT a ``condition``, PATTERN a ``pattern``. The typed spelling (``{"type": "price", "field": ..}``,
``children``, ``name``) is read as well. What isn't known is an error, never left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import fresh, full, indicator, over, prior_volume_mean, rolling_high_close, series_of
from .joins import asof_event, asof_state
from .patterns import ALIASES as PATTERN_ALIASES
from .patterns import DIRECTION, NAMES, pattern
from .resample import resample_calendar, resample_time

Step = Callable[[DataFrame], DataFrame]
COMPARE = {
    "GT": lambda a, b: a > b, "LT": lambda a, b: a < b, "GTE": lambda a, b: a >= b, "LTE": lambda a, b: a <= b, "EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b,
}
SIGNS = {">": "GT", "<": "LT", ">=": "GTE", "<=": "LTE", "==": "EQ", "!=": "NEQ"}
PRICE = {"open", "high", "low", "close", "volume"}
#: Columns of indicators by name, with the parameters in it: pattern, indicator, parameter names, output.
_NAMED = [
    (re.compile(r"(rsi|sma|ema|atr)_(\d+)"), None, ("period",), None),
    (re.compile(r"macd_(\d+)_(\d+)"), "macd", ("fast", "slow"), "macd"),
    (re.compile(r"macd_(signal|hist)_(\d+)_(\d+)_(\d+)"), "macd", ("fast", "slow", "signal"), None),
    (re.compile(r"bb_(middle|upper|lower)_(\d+)_([\d.]+)"), "bollinger", ("period", "std_dev"), None),
    (re.compile(r"stoch_([kd])_(\d+)_(\d+)"), "stochastic", ("k", "d"), None),
]


def named_column(df: DataFrame, name: str, params: dict | None = None, output: str | None = None, by=None) -> tuple[Column, DataFrame]:
    """A column of ``df``, or an indicator by its name or by the name of its column, added if it isn't there."""
    if name in df.columns and not params and not output:
        return F.col(name), df
    for shape, key, keys, role in _NAMED:
        if (found := shape.fullmatch(name)) and not params and not output:
            values = list(found.groups())
            if len(values) > len(keys):
                first = values.pop(0)
                key, role = (first, None) if key is None else (key, first)
            column, step = indicator(key, {k: float(v) if k == "std_dev" else int(v) for k, v in zip(keys, values, strict=True)}, role, by)
            return F.col(column), step(df)
    column, step = indicator(name, params, output, by)
    return F.col(column), step(df)


class _Compiler:
    """Compiles a tree against a table; indicators and patterns are added to ``df`` on the way."""

    def __init__(self, df: DataFrame | None = None, by=None) -> None:
        self.df, self.names, self.cross = df, count(), {}
        self.by = by or (series_of(df) if df is not None else ("symbol",))

    def operand(self, node: dict) -> Column:
        """X1"""
        kind = node.get("type") or next((k for k in ("indicator", "price", "const") if k in node), None)
        if kind == "const":
            return F.lit(float(node["const"] if "const" in node else node["value"]))
        if kind == "price":
            field = node["price"] if "price" in node else node["field"]
            if field not in PRICE:
                raise ValueError(f"unknown price {field}")
            return F.col(field)
        if kind == "column":
            return F.col(node["name"])
        if kind == "indicator":
            name = node["indicator"] if "indicator" in node else node["name"]
            column, step = indicator(name, node.get("params"), node.get("output"), self.by)
            self.add(step)
            return F.col(column)
        raise ValueError(f"an operand is an indicator, a price or a const, not {sorted(node)}")

    def add(self, step: Step) -> None:
        if self.df is not None:
            self.df = step(self.df)

    def held(self, value: Column) -> str:
        name = f"_x{next(self.names)}"
        if self.df is not None:
            (name,) = fresh(self.df, name)
        self.cross[name] = value
        return name

    def tree(self, node: dict) -> Column:
        """X2-X6"""
        op = str(node.get("op") or "").upper()
        if op in ("AND", "OR"):
            parts = [self.tree(c) for c in node.get("conditions") or node.get("children") or ()]
            if not parts:
                raise ValueError(f"{op} needs conditions")
            return reduce(Column.__and__ if op == "AND" else Column.__or__, parts)
        if op == "NOT":
            inner = [node["condition"]] if "condition" in node else node.get("children") or ()
            if len(inner) != 1:
                raise ValueError("NOT needs one condition")
            return ~self.tree(inner[0])
        if op == "PATTERN":
            name = _pattern_name(node.get("pattern") or node.get("name"))
            self.add(lambda df: pattern(df, name, by=self.by))
            return F.col(name)
        if op not in COMPARE and op not in ("CROSS_ABOVE", "CROSS_BELOW"):
            raise ValueError(f"unknown operator {op or node}")
        if "left" not in node or "right" not in node:
            raise ValueError(f"{op} needs left and right")
        left, right = self.operand(node["left"]), self.operand(node["right"])
        if op in COMPARE:
            return COMPARE[op](left, right)
        return crosses(F.col(self.held(left)), F.col(self.held(right)), op == "CROSS_ABOVE", self.by)


def _pattern_name(name: str | None) -> str:
    key = PATTERN_ALIASES.get((name or "").lower(), (name or "").lower())
    if key not in NAMES:
        raise ValueError(f"unknown pattern {name}")
    return key


def crosses(a: Column, b: Column, above: bool, by=("symbol",)) -> Column:
    """a > b now and a <= b a bar ago (or the mirror); null on the first bar."""
    w = over(by)
    a1, b1 = F.lag(a).over(w), F.lag(b).over(w)
    return (a > b) & (a1 <= b1) if above else (a < b) & (a1 >= b1)


def evaluate(df: DataFrame, node: dict, into: str, by=None) -> DataFrame:
    """The tree as a boolean column (Kleene nulls)."""
    compiler = _Compiler(df, by)
    value = compiler.tree(node)
    out = compiler.df.withColumns(compiler.cross) if compiler.cross else compiler.df
    return out.withColumn(into, value).drop(*compiler.cross)


def compile_condition(node: dict, by=None) -> Callable[[DataFrame, str], DataFrame]:
    """A tree, checked now and evaluated later: a function of a table and the name of the boolean column."""
    _Compiler(None, by).tree(node)
    return lambda df, into: evaluate(df, node, into, by)


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def apply_setup(df: DataFrame, component: dict, by=None) -> DataFrame:
    """``setup_valid``."""
    by, p = by or series_of(df), component
    kind = (p.get("type") or "NONE").upper()
    if kind == "NONE":
        return df.withColumn("setup_valid", F.lit(True))
    if kind == "EXPRESSION":
        out = evaluate(df, p["expression"], "setup_valid", by)
    elif kind == "RSI_MOMENTUM":
        column, step = indicator("rsi", {"period": p.get("period", 14)}, by=by)
        low, high = p.get("min"), p.get("max")
        _inside(low, 0, 100, "an RSI bound")
        _inside(high, 0, 100, "an RSI bound")
        ok = F.lit(True) if low is None else F.col(column) >= low
        out = step(df).withColumn("setup_valid", ok if high is None else ok & (F.col(column) <= high))
    elif kind == "SMA_TREND":
        if p.get("slow", 200) <= p.get("fast", 50):
            raise ValueError("slow must be longer than fast")
        (fast, step1), (slow, step2) = (indicator("sma", {"period": p.get(k, n)}, by=by) for k, n in (("fast", 50), ("slow", 200)))
        up = F.col(fast) > F.col(slow) if p.get("direction", "ABOVE") == "ABOVE" else F.col(fast) < F.col(slow)
        out = step2(step1(df)).withColumn("setup_valid", up)
    elif kind == "MACD_TREND":
        (line, step), (signal, _) = indicator("macd", by=by), indicator("macd", None, "signal", by)
        up = F.col(line) > F.col(signal) if p.get("direction", "BULLISH") == "BULLISH" else F.col(line) < F.col(signal)
        out = step(df).withColumn("setup_valid", up)
    elif kind == "VOLUME_TREND":
        n = p.get("period", 20)
        out = prior_volume_mean(df, n, by).withColumn("setup_valid", F.col("volume") >= p.get("multiplier", 1.0) * F.col(f"volume_mean_{n}"))
    elif kind == "INDICATOR_THRESHOLD":
        left, out = named_column(df, p.get("indicator") or p["column"], p.get("params"), p.get("output"), by)
        other = p.get("indicator2") or p.get("compare_to")
        right, out = named_column(out, other, by=by) if other else (F.lit(float(p["value"])), out)
        op = SIGNS.get(p["operator"], p["operator"])
        if op in ("CROSS_ABOVE", "CROSS_BELOW"):
            a, b = fresh(out, "_a", "_b")
            out = out.withColumns({a: left, b: right})
            out = out.withColumn("setup_valid", crosses(F.col(a), F.col(b), op == "CROSS_ABOVE", by)).drop(a, b)
        elif op in COMPARE:
            out = out.withColumn("setup_valid", COMPARE[op](left, right))
        else:
            raise ValueError(f"unknown operator {p['operator']}")
    else:
        raise ValueError(f"unknown setup {kind}")
    return out.withColumn("setup_valid", _false(F.col("setup_valid")))


def _signal(df: DataFrame, **sides: Column) -> DataFrame:
    value = F.lit("HOLD")
    for side, cond in sides.items():
        value = F.when(_false(cond), side).otherwise(value)
    return df.withColumn("signal", value)


def _crossing(df: DataFrame, a: Column, b: Column, above: bool, by, setup: Column) -> DataFrame:
    """BUY where a crosses b from below, or SELL where it does from above."""
    x, y = fresh(df, "_a", "_b")
    out = df.withColumns({x: a, y: b})
    return _signal(out, **{"BUY" if above else "SELL": crosses(F.col(x), F.col(y), above, by) & setup}).drop(x, y)


def apply_trigger(df: DataFrame, component: dict, by=None) -> DataFrame:
    """``signal`` is BUY, SELL or HOLD; without a setup column triggers stand alone."""
    by, p = by or series_of(df), component
    kind = (p.get("type") or "").upper()
    setup = F.col("setup_valid") if "setup_valid" in df.columns else F.lit(True)
    if kind == "CANDLE_PATTERN":
        name = _pattern_name(p["pattern"])
        side = p.get("direction") or DIRECTION[name]
        return _signal(pattern(df, name, by=by), **({side: F.col(name) & setup} if side else {}))
    if kind == "PRICE_CROSSOVER":
        level = p.get("price_level", p.get("level"))
        name = p.get("indicator") or p.get("column")
        if level is None and not name:
            raise ValueError("PRICE_CROSSOVER needs price_level or indicator")
        right, out = (F.lit(float(level)), df) if level is not None else named_column(df, name, p.get("params"), p.get("output"), by)
        return _crossing(out, F.col("close"), right, p.get("direction", "ABOVE") == "ABOVE", by, setup)
    if kind == "INDICATOR_CROSSOVER":
        way = p.get("crossover_type") or p.get("direction", "GOLDEN_CROSS")
        if way not in ("GOLDEN_CROSS", "DEATH_CROSS"):
            raise ValueError(f"unknown crossover {way}")
        fast, out = named_column(df, p.get("indicator1") or p.get("indicator") or p["fast"], by=by)
        slow, out = named_column(out, p.get("indicator2") or p["slow"], by=by)
        return _crossing(out, fast, slow, way == "GOLDEN_CROSS", by, setup)
    if kind == "BREAKOUT":
        if p.get("breakout", "BOLLINGER_UPPER") != "BOLLINGER_UPPER":
            return _signal(df)
        column, step = indicator("bollinger", None, "upper", by)
        return _crossing(step(df), F.col("close"), F.col(column), True, by, setup)
    if kind == "REVERSAL":
        if p["reversal"] not in ("RSI_OVERSOLD", "RSI_OVERBOUGHT"):
            return _signal(df)
        column, step = indicator("rsi", by=by)
        over_sold = p["reversal"] == "RSI_OVERSOLD"
        colour = F.col("close") > F.col("open") if over_sold else F.col("close") < F.col("open")
        return _crossing(step(df), F.col(column), F.lit(30.0 if over_sold else 70.0), over_sold, by, colour & setup)
    if kind == "EXPRESSION":
        (hit,) = fresh(df, "_t")
        out = evaluate(df, p["expression"], hit, by)
        return _signal(out, **{p.get("signal_value") or "BUY": F.col(hit) & setup}).drop(hit)
    raise ValueError(f"unknown trigger {kind}")


def exit_prices(df: DataFrame, stop_loss: float | None = 0.05, take_profit: float | None = 0.10, trailing: bool = True, by=None) -> DataFrame:
    """V1: prices on BUY rows, and the highest close of 20 bars for a trailing stop."""
    buy = F.col("signal") == "BUY"
    out = df
    if stop_loss:
        out = out.withColumn("stop_loss_price", F.when(buy, F.col("close") * (1 - stop_loss)))
    if take_profit:
        out = out.withColumn("take_profit_price", F.when(buy, F.col("close") * (1 + take_profit)))
    if trailing:
        out = rolling_high_close(out, 20, by).withColumnRenamed("close_max_20", "trailing_base")
    return out


#: Leaves about the open position, which the back-test applies, by their kind.
POSITION = {
    "STOP_LOSS_PCT": "stop_loss", "STOP_LOSS": "stop_loss", "TAKE_PROFIT_PCT": "take_profit", "TAKE_PROFIT": "take_profit",
    "TRAILING_STOP_PCT": "trailing_stop", "TRAILING_STOP": "trailing_stop", "TIME_BASED": "max_days", "STOP_LOSS_ANCHOR": "anchor",
}
ANCHORS = ("ENTRY_OPEN", "ENTRY_HIGH", "ENTRY_LOW", "ENTRY_CLOSE")
#: Kinds that documents may hold and that change nothing.
WITHOUT_EFFECT = ("NONE", "INDICATOR_SIGNAL", "COMBINED", "STOP_LOSS_ATR", "TAKE_PROFIT_ATR")


def _leaves(component: dict) -> list[dict]:
    """The rules of an exit: the component itself, or those of a CONDITIONAL_OR_FIXED, however deep these are nested. An unknown one is an error."""
    kind = (component.get("type") or "NONE").upper()
    inside = component.get("conditions") or component.get("leaves")
    if kind == "CONDITIONAL_OR_FIXED" or (kind == "NONE" and inside):
        return [leaf for part in inside or [] for leaf in _leaves(part)]
    if kind not in POSITION and kind not in WITHOUT_EFFECT and kind not in ("INDICATOR_CROSS", "EXPRESSION"):
        raise ValueError(f"unknown exit {kind}")
    return [component]


def apply_exit(df: DataFrame, component: dict, by=None) -> DataFrame:
    """V2-V4, V6: ``exit_signal``; leaves about the open position are for the back-test (``exit_parameters``)."""
    by, helpers, hit = by or series_of(df), [], F.lit(False)
    for leaf in _leaves(component):
        kind = (leaf.get("type") or "NONE").upper()
        if kind == "INDICATOR_CROSS":
            value, df = named_column(df, leaf.get("indicator") or leaf["column"], leaf.get("params"), leaf.get("output"), by)
            a, b = fresh(df, "_a", "_b")
            df = df.withColumns({a: value, b: F.lit(float(leaf.get("value") or 0))})
            (name,) = fresh(df, "_e")
            df = df.withColumn(name, crosses(F.col(a), F.col(b), (leaf.get("direction") or "DOWN") == "UP", by)).drop(a, b)
        elif kind == "EXPRESSION":
            (name,) = fresh(df, "_e")
            df = evaluate(df, leaf["expression"], name, by)
        else:
            continue
        helpers.append(name)
        hit = hit | _false(F.col(name))
    return df.withColumn("exit_signal", F.when(hit, "SELL")).drop(*helpers)


def _inside(value: float | None, low: float, high: float, what: str) -> None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{what} lies in {low} to {high}, not {value}")


def _first(leaf: dict, *keys: str, default=None):
    return next((leaf[k] for k in keys if leaf.get(k) is not None), default)


def exit_parameters(component: dict) -> dict:
    """V5: the back-test's thresholds from an exit component."""
    out: dict = {"stop_loss": None, "take_profit": None, "trailing_stop": None, "max_days": None, "anchor": None, "anchor_offset": 0.0}
    for leaf in _leaves(component):
        key = POSITION.get((leaf.get("type") or "").upper())
        if key == "max_days":
            days = _first(leaf, "max_holding_days", "max_days", "value")
            out[key] = None if days is None else int(days)
        elif key == "anchor":
            out["anchor"], out["anchor_offset"] = leaf.get("anchor") or "ENTRY_LOW", float(_first(leaf, "offset_pct", "offset", default=0.0))
            if out["anchor"] not in ANCHORS:
                raise ValueError(f"unknown anchor {out['anchor']}")
            if not 0 <= out["anchor_offset"] < 1:
                raise ValueError("an anchor's offset lies in [0, 1)")
        elif key:
            share = _first(leaf, "value", "pct")
            _inside(share, 0, 1, "a stop's share")
            out[key] = None if share is None else float(share)
    return out


def compile_strategy(config: dict, by=None) -> Step:
    """A whole strategy on one timeframe: setup, trigger, exit. Series are told apart by ``by`` (symbol, and timeframe if there is one)."""
    parts = config["components"]

    def run(df: DataFrame) -> DataFrame:
        series = by or series_of(df)
        return apply_exit(apply_trigger(apply_setup(df, parts.get("setup") or {}, series), parts["trigger"], series), parts.get("exit") or {}, series)

    return run


_UNITS = {"m": 60, "h": 3600, "d": 86400}


def seconds_of(timeframe: str) -> int:
    """Seconds of a timeframe such as 15m, 1h or 3d."""
    found = re.fullmatch(r"([1-9]\d*)([mhd])", timeframe)
    if not found:
        raise ValueError(f"unknown timeframe {timeframe}")
    return int(found[1]) * _UNITS[found[2]]


def in_timeframe(bars: DataFrame, timeframe: str, base: str) -> DataFrame:
    """Bars of a timeframe from those of the base. Bars of minutes or hours have times as their ``date``."""
    seconds = seconds_of(timeframe)
    timed = dict(bars.dtypes)["date"].startswith("timestamp")
    if not timed:
        if seconds % 86400:
            raise ValueError(f"{timeframe} needs bars with times")
        return resample_calendar(bars, seconds // 86400)
    if seconds < seconds_of(base):
        raise ValueError(f"{timeframe} is shorter than the base {base}")
    return bars if timeframe == base else resample_time(bars, seconds)


def run_document(bars: DataFrame, config: dict) -> DataFrame:
    """A strategy whose components name their own timeframes, on bars of the smallest: bars of the base timeframe with
    ``setup_valid``, ``signal`` and ``exit_signal``. Timeframes are of days, or of minutes and hours where the bars'
    ``date`` is a time.

    A setup is a state: it holds from its bar on until the next (J1). Signals and exits are events: they hold on the
    date of their bar only (J2). A setup reaches a trigger of another timeframe the same way.
    """
    parts, base = config["components"], config.get("timeframe") or "1d"
    times = {name: (parts.get(name) or {}).get("timeframe") or base for name in ("setup", "trigger", "exit")}
    frames = {t: in_timeframe(bars, t, base) for t in {base, *times.values()}}

    def with_setup(timeframe: str) -> DataFrame:
        own = apply_setup(frames[times["setup"]], parts.get("setup") or {})
        if timeframe == times["setup"]:
            return own
        state = asof_state(frames[timeframe], own.select("symbol", "date", "setup_valid"), ["setup_valid"])
        return state.withColumn("setup_valid", _false(F.col("setup_valid")))

    fired = apply_trigger(with_setup(times["trigger"]), parts["trigger"])
    if times["trigger"] == base:
        out = fired
    else:
        out = asof_event(with_setup(base), fired.select("symbol", "date", "signal"), "signal", "HOLD")
    if times["exit"] == base:
        return apply_exit(out, parts.get("exit") or {})
    left = apply_exit(frames[times["exit"]], parts.get("exit") or {})
    return asof_event(out, left.select("symbol", "date", "exit_signal"), "exit_signal")


__all__ = [
    "apply_exit", "apply_setup", "apply_trigger", "compile_condition", "compile_strategy", "crosses", "evaluate", "exit_parameters", "exit_prices", "full", "named_column", "run_document",
]
