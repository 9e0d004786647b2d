"""Technical indicators over each symbol's bars (I operators).

Rolling indicators are windows over one partitioning and order, so a chain of them sorts once. A window of N
gives null until it holds N values. The exponential averages are a recurrence and run per symbol in one pass over
Arrow tables, which keep NaN and null apart; only the prices that they read become arrays.

``by`` names a series; by default it is the symbol, and the timeframe too where the table has one. A column that is
there already is kept, so its name tells all that it depends on: a price other than the close is part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAS = (8, 13, 21, 55, 89, 144, 169)


def series_of(df: DataFrame) -> tuple[str, ...]:
    """The columns that tell series apart."""
    return ("symbol", "timeframe") if "timeframe" in df.columns else ("symbol",)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table doesn't have."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name += "_"
        out.append(name)
    return out


def over(by: Iterable[str] = ("symbol",)) -> Window:
    return Window.partitionBy(*by).orderBy("date")


def full(agg: Callable, x: Column | str, n: int, by: Iterable[str] = ("symbol",), shift: int = 0) -> Column:
    """An aggregate of the last n values (``shift`` rows back), null until there are n."""
    w = over(by).rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def running(df: DataFrame, flags: dict[str, Column], by) -> tuple[DataFrame, Callable[[str, int], Column], list[str]]:
    """Counts of flags in the last n rows in constant time for each row, for any n: the table with running totals, a
    function (flag, n) that gives null until there are n rows, and the helper columns to drop."""
    row, *totals = fresh(df, "_row", *[f"_total_{k}" for k in flags])
    w, of = over(by), dict(zip(flags, totals, strict=True))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({row: F.row_number().over(w)} | {of[k]: F.sum(F.coalesce(flag.cast("int"), F.lit(0))).over(whole) for k, flag in flags.items()})

    def last(flag: str, n: int) -> Column:
        return F.when(F.col(row) >= n, F.col(of[flag]) - F.coalesce(F.lag(of[flag], n).over(w), F.lit(0)))

    return out, last, [row, *totals]


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns that aren't there yet."""
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def named(name: str, price: str) -> str:
    return name if price == "close" else f"{name}_{price}"


def sma(df: DataFrame, p: int = 20, price: str = "close", by=None) -> DataFrame:
    return smas(df, (p,), price, by)


def smas(df: DataFrame, periods: Iterable[int], price: str = "close", by=None) -> DataFrame:
    """Means of the last p values, null until there are p, in constant time for each row, for any p and any number of periods.

    A mean is the difference of two running totals. These are decimals of 18 places, so nothing is lost however long the
    series is, and equal windows have equal means. Values that aren't finite, or beyond 1e20, give NaN.
    """
    periods = [p for p in periods if named(f"sma_{p}", price) not in df.columns]
    if not periods:
        return df
    w = over(by or series_of(df))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact, total, there, odd = fresh(df, "_exact", "_sum", "_there", "_odd")
    out = df.withColumn(exact, F.col(price).try_cast("decimal(38,18)"))
    strange = F.when(F.col(price).isNotNull() & F.col(exact).isNull(), 1).otherwise(0)
    out = out.withColumns({total: F.sum(F.coalesce(exact, F.lit(0).cast("decimal(38,18)"))).over(whole), there: F.count(price).over(whole), odd: F.sum(strange).over(whole)})

    def last(c: str, p: int) -> Column:
        before = F.lag(c, p).over(w)
        return F.when(before.isNull(), F.col(c)).otherwise(F.col(c) - before)

    def mean(p: int) -> Column:
        return F.when(last(there, p) == p, F.when(last(odd, p) > 0, F.lit(float("nan"))).otherwise(last(total, p).cast("double") / p))

    return out.withColumns({named(f"sma_{p}", price): mean(p) for p in periods}).drop(exact, total, there, odd)


#: A column from a price. The second argument numbers the series where there are several, one after the other.
Recurrence = Callable[[pd.Series, "np.ndarray | None"], pd.Series]


def _numbered_series(table: pa.Table, by: list[str]) -> np.ndarray:
    """Numbers of the series of a table that is sorted by ``by``."""
    new = np.zeros(table.num_rows, bool)
    for c in by:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def recurrences(df: DataFrame, wanted: dict[str, tuple[str, Recurrence]], by=None) -> DataFrame:
    """Per series and in date order, columns from functions of a price; all in one Arrow round trip. wanted: name to (price, function).

    A group is all series of a symbol: its widths share the cost of a group, and need no exchange where rows lie by symbol.
    """
    wanted = {k: f for k, f in wanted.items() if k not in df.columns}
    if not wanted:
        return df
    schema = T.StructType([*df.schema.fields, *[T.StructField(k, T.DoubleType()) for k in wanted]])
    first, *rest = by or series_of(df)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (*rest, "date")]))
        series = _numbered_series(table, rest) if rest else None
        prices = {price: table[price].to_pandas() for price, _ in wanted.values()}
        for name, (price, f) in wanted.items():
            table = table.append_column(name, pa.array(f(prices[price], series), pa.float64(), from_pandas=True))
        return table

    return df.groupBy(first).applyInArrow(run, schema)


def _ema_of(p: int, adjust: bool = False) -> Recurrence:
    def average(price: pd.Series, series: np.ndarray | None) -> pd.Series:
        if series is None:
            return price.ewm(span=p, adjust=adjust).mean()
        return price.groupby(series, sort=False).ewm(span=p, adjust=adjust).mean().reset_index(drop=True)

    return average


def ema(df: DataFrame, periods: Iterable[int] = (20,), price: str = "close", by=None, days: int | None = None) -> DataFrame:
    """Alpha 2/(p+1), from the first bar on. With ``days``, series are split over tasks by spans of so many days (``ema_in_spans``)."""
    if days is not None:
        return ema_in_spans(df, periods, days, price, by)
    return recurrences(df, {named(f"ema_{p}", price): (price, _ema_of(p)) for p in periods}, by)


def _decay(x: np.ndarray, alpha: float) -> np.ndarray:
    """What is left of the first valid value's part at each row of a span: from value to value the older part keeps
    (1 - alpha) ** gap, relative to that plus alpha."""
    valid = np.flatnonzero(~np.isnan(x))
    kept = (1 - alpha) ** np.diff(valid).astype(float)
    out = np.zeros(len(x))
    if len(valid):
        steps = np.concatenate([[1.0], np.cumprod(kept / (kept + alpha))])
        out[valid[0] :] = steps[np.searchsorted(valid, np.arange(valid[0], len(x)), side="right") - 1]
    return out


def _entered(value: float, weight: float, lead: int, first: float, alpha: float) -> float:
    """The average at a span's first valid value, from what came before the span."""
    if np.isnan(value):
        return first
    weight *= (1 - alpha) ** (lead + 1)
    return (weight * value + alpha * first) / (weight + alpha)


def ema_in_spans(df: DataFrame, periods: Iterable[int], days: int, price: str = "close", by=None) -> DataFrame:
    """The averages of ``ema`` for series too long for one task.

    A step of the average is an affine map of the value before, and such maps compose. So each span of days is averaged
    on its own and summed up in five numbers for each period; the summaries of a series, a row a span, are put together
    in order, which gives the value that enters each span; and each span adds what that leaves of it. Bars are grouped
    by series and span, so no task holds a whole series.
    """
    by = tuple(by or series_of(df))
    periods = [p for p in periods if named(f"ema_{p}", price) not in df.columns]
    if not periods:
        return df
    alphas = [2 / (p + 1) for p in periods]
    (span,) = fresh(df, "_span")
    spread = df.withColumn(span, F.floor(F.unix_date(F.col("date").cast("date")) / days))
    keys = [spread.schema[c] for c in (*by, span)]
    array = T.ArrayType(T.DoubleType())

    def in_order(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table, sort_keys=[("date", "ascending")]))

    def averages(x: np.ndarray) -> list[np.ndarray]:
        return [pd.Series(x).ewm(alpha=a, adjust=False).mean().to_numpy() for a in alphas]

    def prices(table: pa.Table) -> np.ndarray:
        return table[price].cast(pa.float64()).to_pandas().to_numpy()

    def key_of(table: pa.Table) -> dict[str, pa.Array]:
        return {c: table[c].combine_chunks().slice(0, 1) for c in (*by, span)}

    def summary(table: pa.Table) -> pa.Table:
        x = prices(in_order(table))
        valid = np.flatnonzero(~np.isnan(x))
        some = len(valid) > 0
        row = {"rows": len(x), "lead": int(valid[0]) if some else -1, "tail": int(len(x) - 1 - valid[-1]) if some else len(x), "head": float(x[valid[0]]) if some else None}
        row |= {"ends": [float(y[-1]) for y in averages(x)], "left": [float(_decay(x, a)[-1]) for a in alphas]}
        kinds = {"rows": pa.int64(), "lead": pa.int64(), "tail": pa.int64(), "head": pa.float64(), "ends": pa.list_(pa.float64()), "left": pa.list_(pa.float64())}
        return pa.table(key_of(table) | {k: pa.array([v], kinds[k]) for k, v in row.items()})

    shape = T.StructType([*keys, *[T.StructField(c, T.LongType()) for c in ("rows", "lead", "tail")], T.StructField("head", T.DoubleType()), T.StructField("ends", array), T.StructField("left", array)])
    sums = spread.select(*by, span, "date", price).groupBy(*by, span).applyInArrow(summary, shape)

    def fold(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(span, "ascending")]))
        values, weights = [], []
        value, weight = [float("nan")] * len(alphas), [1.0] * len(alphas)
        for r in table.select(["rows", "lead", "tail", "head", "ends", "left"]).to_pylist():
            values.append(value)
            weights.append(weight)
            if r["lead"] < 0:
                weight = [w * (1 - a) ** r["rows"] for w, a in zip(weight, alphas, strict=True)]
            else:
                value = [e + k * (_entered(v, w, r["lead"], r["head"], a) - r["head"]) for v, w, a, e, k in zip(value, weight, alphas, r["ends"], r["left"], strict=True)]
                weight = [(1 - a) ** r["tail"] for a in alphas]
        kept = table.select([*by, span])
        return kept.append_column("value", pa.array(values, pa.list_(pa.float64()))).append_column("weight", pa.array(weights, pa.list_(pa.float64())))

    entering = sums.groupBy(*by).applyInArrow(fold, T.StructType([*keys, T.StructField("value", array), T.StructField("weight", array)]))
    names = [named(f"ema_{p}", price) for p in periods]

    def finish(table: pa.Table, before: pa.Table) -> pa.Table:
        table = in_order(table)
        x, (value,), (weight,) = prices(table), before["value"].to_pylist(), before["weight"].to_pylist()
        valid = np.flatnonzero(~np.isnan(x))
        for name, a, own, v, w in zip(names, alphas, averages(x), value, weight, strict=True):
            if len(valid):
                own = own + _decay(x, a) * (_entered(v, w, int(valid[0]), float(x[valid[0]]), a) - x[valid[0]])
                own[: valid[0]] = v
            else:
                own = np.full(len(x), v)
            table = table.append_column(name, pa.array(own, pa.float64(), from_pandas=True))
        return table.drop_columns([span])

    out = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return spread.groupBy(*by, span).cogroup(entering.groupBy(*by, span)).applyInArrow(finish, out)


def ema_adjusted(df: DataFrame, spans: Iterable[int] = EMAS, by=None) -> DataFrame:
    """Normalised weights; with the fast and slow differences of the 13/21 and 55/89 pairs."""
    out = recurrences(df, {f"ema_adj_{p}": ("close", _ema_of(p, adjust=True)) for p in spans}, by)
    pairs = {"macd_fast": (13, 21), "macd_slow": (55, 89)}
    return _add(out, {k: F.col(f"ema_adj_{a}") - F.col(f"ema_adj_{b}") for k, (a, b) in pairs.items() if {a, b} <= set(spans)})


def _macd_lines(f: int, s: int, g: int) -> dict[str, tuple[str, Recurrence]]:
    line = lambda price, series: _ema_of(f)(price, series) - _ema_of(s)(price, series)
    return {f"macd_{f}_{s}": ("close", line), f"macd_signal_{f}_{s}_{g}": ("close", lambda price, series: _ema_of(g)(line(price, series), series))}


def _macd_hist(df: DataFrame, f: int, s: int, g: int) -> DataFrame:
    return _add(df, {f"macd_hist_{f}_{s}_{g}": F.col(f"macd_{f}_{s}") - F.col(f"macd_signal_{f}_{s}_{g}")})


def macd(df: DataFrame, f: int = 12, s: int = 26, g: int = 9, by=None) -> DataFrame:
    return _macd_hist(recurrences(df, _macd_lines(f, s, g), by), f, s, g)


def rsi(df: DataFrame, p: int = 14, by=None) -> DataFrame:
    """Simple means of gains and losses; a loss of 0 gives 100, or NaN if the gain is 0 too."""
    if f"rsi_{p}" in df.columns:
        return df
    by = by or series_of(df)
    d = F.coalesce(F.col("close") - F.lag("close").over(over(by)), F.lit(0.0))
    up, down, g, lo = fresh(df, "_gain", "_loss", "_g", "_l")
    out = df.withColumns({up: F.greatest(d, F.lit(0.0)), down: F.greatest(-d, F.lit(0.0))})
    out = out.withColumns({g: full(F.avg, up, p, by), lo: full(F.avg, down, p, by)})
    loss = F.when(F.col(lo) > 0, F.col(lo))
    value = F.when(F.col(lo) > 0, 100 - 100 / (1 + F.col(g) / loss)).when(F.col(g) > 0, 100.0).when(F.col(g) == 0, F.lit(float("nan")))
    return out.withColumn(f"rsi_{p}", value).drop(up, down, g, lo)


def bollinger(df: DataFrame, p: int = 20, k: float = 2.0, by=None) -> DataFrame:
    by = by or series_of(df)
    mid, dev, name = full(F.avg, "close", p, by), full(F.stddev_samp, "close", p, by), f"{p}_{k:g}"
    return _add(df, {f"bb_middle_{name}": mid, f"bb_upper_{name}": mid + k * dev, f"bb_lower_{name}": mid - k * dev})


def atr(df: DataFrame, p: int = 14, by=None) -> DataFrame:
    if f"atr_{p}" in df.columns:
        return df
    by, (tr,) = by or series_of(df), fresh(df, "_tr")
    before = F.lag("close").over(over(by))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn(tr, true_range).withColumn(f"atr_{p}", full(F.avg, tr, p, by)).drop(tr)


def stochastic(df: DataFrame, k: int = 14, d: int = 3, by=None) -> DataFrame:
    by, (lo, hi) = by or series_of(df), fresh(df, "_lo", "_hi")
    out = df.withColumns({lo: full(F.min, "low", k, by), hi: full(F.max, "high", k, by)})
    span = F.col(hi) - F.col(lo)
    value = F.when(span > 0, 100 * (F.col("close") - F.col(lo)) / F.when(span > 0, span)).when(span == 0, F.lit(float("nan")))
    out = _add(out, {f"stoch_k_{k}_{d}": value})
    return _add(out, {f"stoch_d_{k}_{d}": full(F.avg, f"stoch_k_{k}_{d}", d, by)}).drop(lo, hi)


def prior_volume_mean(df: DataFrame, n: int = 20, by=None) -> DataFrame:
    """Mean of the n volumes before this one."""
    return _add(df, {f"volume_mean_{n}": full(F.avg, "volume", n, by or series_of(df), shift=1)})


def rolling_high_close(df: DataFrame, n: int = 20, by=None) -> DataFrame:
    return _add(df, {f"close_max_{n}": full(F.max, "close", n, by or series_of(df))})


def density_area(df: DataFrame, window: int = 30, bins: int = 20, by=None) -> DataFrame:
    """Histogram of the ``window`` closes before: edges of its first fullest bin, and of the fullest to the right of that."""
    w = over(by or series_of(df)).rowsBetween(-window, -1)
    c, lo, hi, width, b, n, m, second = fresh(df, "_c", "_lo", "_hi", "_w", "_b", "_n", "_m", "_s")
    out = df.withColumn(c, F.when(F.count("close").over(w) == window, F.collect_list("close").over(w)))
    flat = F.array_max(c) == F.array_min(c)
    out = out.withColumns({lo: F.when(flat, F.array_min(c) - 0.5).otherwise(F.array_min(c)), hi: F.when(flat, F.array_max(c) + 0.5).otherwise(F.array_max(c))})
    out = out.withColumn(width, (F.col(hi) - F.col(lo)) / bins)
    place = F.transform(c, lambda x: F.least(F.lit(bins - 1), F.floor((x - F.col(lo)) / F.col(width)).cast("int")))
    out = out.withColumn(b, place)
    out = out.withColumn(n, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(b, lambda x: x == i))))
    out = out.withColumn(m, F.array_position(n, F.array_max(n)).cast("int") - 1)
    right = F.slice(n, F.col(m) + 2, F.lit(bins))
    out = out.withColumn(second, F.when(F.col(m) == bins - 1, F.col(m)).otherwise(F.col(m) + F.array_position(right, F.array_max(right)).cast("int")))
    edge = lambda col, plus: F.col(lo) + F.col(width) * (F.col(col) + plus)
    out = _add(out, {"area_main_low": edge(m, 0), "area_main_high": edge(m, 1), "area_second_low": edge(second, 0), "area_second_high": edge(second, 1)})
    return out.drop(c, lo, hi, width, b, n, m, second)


#: Ratios of the levels.
FIB = (0.236, 0.382, 0.5, 0.618, 0.786, 1.236, 1.382)


def fib_levels(df: DataFrame, window: int = 30, by=None) -> DataFrame:
    by = by or series_of(df)
    low, high = full(F.min, "low", window, by, shift=1), full(F.max, "high", window, by, shift=1)
    return _add(df, {f"fib_{str(r).replace('.', '_')}": low + r * (high - low) for r in FIB})


def pct_change(df: DataFrame, col: str = "close", periods: int = 1, by=None) -> DataFrame:
    before = F.lag(col, periods).over(over(by or series_of(df)))
    return _add(df, {named(f"pct_change_{periods}", col): F.try_divide(F.col(col), before) - 1})


def growth_curve(df: DataFrame, capital: float = 10000.0, by=None) -> DataFrame:
    first = F.first("close").over(over(by or series_of(df)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _add(df, {"growth": capital * F.try_divide(F.col("close"), first)})


def all_indicators(df: DataFrame, by=None) -> DataFrame:
    """The whole bundle. The windows come first, because groups keep to their partitioning but not the other way: one exchange."""
    f, s, g = 12, 26, 9
    by = by or series_of(df)
    out = stochastic(atr(bollinger(rsi(smas(df, (20, 50, 200), by=by), by=by), by=by), by=by), by=by)
    out = recurrences(out, {f"ema_{p}": ("close", _ema_of(p)) for p in EMAS} | _macd_lines(f, s, g), by)
    return _macd_hist(out, f, s, g)


def _macd_columns(p: dict) -> dict[str, str]:
    line = f"macd_{p['fast']}_{p['slow']}"
    return {"value": line, "macd": line, "signal": f"macd_signal_{p['fast']}_{p['slow']}_{p['signal']}", "hist": f"macd_hist_{p['fast']}_{p['slow']}_{p['signal']}"}


def _band_columns(p: dict) -> dict[str, str]:
    names = {k: f"bb_{k}_{p['period']}_{p['std_dev']:g}" for k in ("middle", "upper", "lower")}
    return {"value": names["middle"]} | names


def _stoch_columns(p: dict) -> dict[str, str]:
    return {"value": f"stoch_k_{p['k']}_{p['d']}", "k": f"stoch_k_{p['k']}_{p['d']}", "d": f"stoch_d_{p['k']}_{p['d']}"}


#: Name -> (function of table, parameters and series, default parameters, columns by output role).
REGISTRY: dict[str, tuple[Callable, dict, Callable[[dict], dict[str, str]]]] = {
    "rsi": (lambda df, p, by: rsi(df, p["period"], by), {"period": 14}, lambda p: {"value": f"rsi_{p['period']}"}),
    "sma": (lambda df, p, by: sma(df, p["period"], by=by), {"period": 20}, lambda p: {"value": f"sma_{p['period']}"}),
    "ema": (lambda df, p, by: ema(df, [p["period"]], by=by), {"period": 20}, lambda p: {"value": f"ema_{p['period']}"}),
    "macd": (lambda df, p, by: macd(df, p["fast"], p["slow"], p["signal"], by), {"fast": 12, "slow": 26, "signal": 9}, _macd_columns),
    "bollinger": (lambda df, p, by: bollinger(df, p["period"], p["std_dev"], by), {"period": 20, "std_dev": 2.0}, _band_columns),
    "atr": (lambda df, p, by: atr(df, p["period"], by), {"period": 14}, lambda p: {"value": f"atr_{p['period']}"}),
    "stochastic": (lambda df, p, by: stochastic(df, p["k"], p["d"], by), {"k": 14, "d": 3}, _stoch_columns),
}
#: Other spellings of parameters and outputs.
SPELLINGS = {"fast_period": "fast", "slow_period": "slow", "signal_period": "signal", "k_period": "k", "d_period": "d", "histogram": "hist", "default": "value"}
ALIASES = {"bb": "bollinger", "bollinger_bands": "bollinger", "stoch": "stochastic"}


def indicator(name: str, params: dict | None = None, output: str | None = None, by=None) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """The column of an indicator and the step that adds it; an unknown name or output is an error."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in REGISTRY:
        raise ValueError(f"unknown indicator {name}")
    step, defaults, columns = REGISTRY[key]
    given = {SPELLINGS.get(k, k): v for k, v in (params or {}).items()}
    if given.keys() - defaults.keys():
        raise ValueError(f"{name} has no parameter {sorted(given.keys() - defaults.keys())}")
    merged, role = defaults | given, (output or "value").lower()
    role = SPELLINGS.get(role, role)
    found = columns(merged)
    if role not in found:
        raise ValueError(f"{name} has no output {output}")
    return found[role], lambda df: step(df, merged, by or series_of(df))
