"""Screener, picks, quotes and returns for whole universes (Z, O, A operators)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import optional_filter
from .joins import nth_bar_after, pivot_by_rank, top_n, with_day

SORTABLE = ("symbol", "name", "industry", "marketcap", "close", "volume", "rank", "confidence")


def order_by(df: DataFrame, spec: str, then: str = "symbol") -> DataFrame:
    """O1: 'field:desc' of the allowed fields; nulls come last when falling, first when rising."""
    field, _, way = spec.partition(":")
    if field not in SORTABLE:
        raise ValueError(f"can't sort by {field}")
    return df.orderBy(F.desc_nulls_last(field) if way == "desc" else F.asc_nulls_first(field), then)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """O2"""
    return df.offset(offset).limit(limit)


def screener(meta: DataFrame, bars: DataFrame, wm: DataFrame, industry: str | None = None, type: str | None = None, min_mc: int | None = None, max_mc: int | None = None, sort: str = "marketcap:desc", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Active metadata with the bars of the last current watermark date."""
    as_of = F.broadcast(wm.where("is_current").agg(F.max("latest_date").alias("as_of")))
    today = bars.crossJoin(as_of).where(F.col("date") == F.col("as_of")).drop("as_of")
    live = optional_filter(meta.where(F.lower(F.col("active")) == "true"), industry, type, min_mc, max_mc)
    out = order_by(today.join(live, "symbol"), sort)
    return page(out, limit, offset) if limit else out


def _today(picks: DataFrame) -> DataFrame:
    last = F.broadcast(picks.agg(F.max("scan_date").alias("_last")))
    return picks.crossJoin(last).where(F.col("scan_date") == F.col("_last")).drop("_last")


def picks_today(picks: DataFrame, meta: DataFrame, industry: str | None = None, type: str | None = None, min_mc: int | None = None, max_mc: int | None = None, limit: int | None = None) -> DataFrame:
    """The picks of the last scan, by rank, then symbol."""
    out = optional_filter(_today(picks).join(meta, "symbol", "left"), industry, type, min_mc, max_mc).orderBy("rank", "symbol")
    return out.limit(limit) if limit else out


def picks_today_metadata(picks: DataFrame, meta: DataFrame, **filters) -> DataFrame:
    """Z3"""
    return picks_today(picks, meta, **filters).select("symbol", "rank", "metadata")


def pick_detail(picks: DataFrame, meta: DataFrame, symbol: str, scan_date: str | Column | DataFrame, strategy: str | None = None) -> DataFrame:
    """Z4"""
    own = picks.where(F.col("symbol") == F.upper(F.trim(F.lit(symbol))))
    out = with_day(own, scan_date).where(F.col("scan_date") == F.col("_day")).drop("_day")
    if strategy:
        out = out.where(F.col("strategy_name") == strategy)
    return out.join(meta, "symbol", "left")


def _return(now: Column, base: Column) -> Column:
    return F.when(base != 0, (now - base) / F.when(base != 0, base))


def pick_forward_returns(picks: DataFrame, meta: DataFrame, bars: DataFrame, horizons: Iterable[int] = (1, 5, 21)) -> DataFrame:
    """Return after each horizon, and up to the latest close."""
    hs = sorted(horizons)
    out = nth_bar_after(picks, bars, hs, last="last_close")
    out = out.withColumns({f"return_{h}": _return(F.col(f"close_{h}"), F.col("price")) for h in hs} | {"return_to_date": _return(F.col("last_close"), F.col("price"))})
    return out.drop(*[f"close_{h}" for h in hs], "last_close").join(meta.select("symbol", "name", "industry"), "symbol", "left")


def latest_quote(meta: DataFrame, bars: DataFrame, symbols: Iterable[str] | None = None) -> DataFrame:
    """Z6"""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    fields = ("date", "open", "high", "low", "close", "volume")
    last = bars.groupBy("symbol").agg(F.max_by(F.struct(*fields), "date").alias("b")).select("symbol", "b.*")
    return meta.join(last, "symbol")


def history(bars: DataFrame, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = None, newest_first: bool = True, ordered: bool = False) -> DataFrame:
    """Bars in a range, at most ``limit`` of each symbol from the chosen end; sorted on request only."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    way = F.desc("date") if newest_first else F.asc("date")
    out = top_n(bars, ["symbol"], [way], limit) if limit else bars
    return out.orderBy("symbol", way) if ordered else out


def trailing_returns(bars: DataFrame, horizons: Iterable[int] = (1, 5, 21)) -> DataFrame:
    """Z8"""
    hs = sorted(horizons)
    wide = pivot_by_rank(bars, [1, *[h + 1 for h in hs]])
    return wide.select("symbol", F.col("close_1").alias("close"), *[_return(F.col("close_1"), F.col(f"close_{h + 1}")).alias(f"return_{h}") for h in hs])


def last_days(bars: DataFrame, n: int, today: str | Column) -> DataFrame:
    """Z9"""
    d = F.lit(today).cast("date") if isinstance(today, str) else today
    return bars.where(F.col("date") >= F.date_sub(d, n))


def period_range(bars: DataFrame, period: str, end: str | Column) -> DataFrame:
    """From the start of the year or month, the whole end day included."""
    d = F.lit(end).cast("date") if isinstance(end, str) else end
    return bars.where((F.col("date") >= F.trunc(d, {"YTD": "year", "MTD": "month"}[period])) & (F.col("date") < F.date_add(d, 1)))


def growth(bars: DataFrame, days: int, today: str | Column) -> DataFrame:
    """Change in percent of the latest close against the latest at or before ``days`` ago."""
    d = F.lit(today).cast("date") if isinstance(today, str) else today
    past = F.col("date") <= F.date_sub(d, days)
    out = bars.where(F.col("date") <= d).groupBy("symbol").agg(F.max_by("close", "date").alias("now"), F.max_by(F.when(past, F.col("close")), F.when(past, F.col("date"))).alias("past"))
    return out.withColumn("growth_pct", 100 * _return(F.col("now"), F.col("past")))


def vwap_agg(price: str = "close_price", volume: str = "volume") -> Column:
    """A2: volume-weighted price, or the plain mean without volume."""
    total = F.sum(volume)
    return F.when(total > 0, F.sum(F.col(price) * F.col(volume)) / F.when(total > 0, total)).otherwise(F.avg(price))


def one_hot(df: DataFrame, columns: dict[str, Iterable[str]]) -> DataFrame:
    """A 0/1 column for each named category."""
    return df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, values in columns.items() for v in values})


def collect_symbols(df: DataFrame, by: Iterable[str] = ("date", "category")) -> DataFrame:
    """A8"""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def describe_returns(trades: DataFrame, col: str = "pnl_pct", by: Iterable[str] = ()) -> DataFrame:
    """A9"""
    return trades.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.median(col).alias("median"), F.stddev_samp(col).alias("std"), F.min(col).alias("least"), F.max(col).alias("greatest"),
        F.percentile(col, F.lit(0.05)).alias("p5"), F.percentile(col, F.lit(0.95)).alias("p95"),
    )


#: Symbols in one tile of the correlation.
TILE = 256


def return_correlation(bars: DataFrame, as_of: str | Column, days: int = 30, tile: int = TILE) -> DataFrame:
    """A10: correlation of daily returns of each pair of symbols, in long form.

    A symbol's returns are one array. Symbols are dealt to tiles, and a pair of tiles meets in one group: a symbol's
    array travels once for each tile and not once for each day and partner, and no join multiplies rows by days.
    """
    d = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    moves = bars.where(F.col("date").between(F.date_sub(d, days), d)).withColumn("r", F.try_divide("close", before) - 1).where("r IS NOT NULL")
    lines = moves.groupBy("symbol").agg(F.collect_list(F.struct(F.unix_date("date").alias("day"), "r")).alias("moves"))
    tiles = lines.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / tile)).cast("int").alias("tiles"))
    lines = lines.crossJoin(F.broadcast(tiles)).withColumn("own", F.pmod(F.xxhash64("symbol"), "tiles").cast("int"))
    lines = lines.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = lines.select(F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "symbol", "moves")
    return met.groupBy("left", "right").applyInArrow(_correlate, "a string, b string, n long, corr double")


def _correlate(table: pa.Table) -> pa.Table:
    """Pairs of a tile with itself, or between two tiles, over the days that both symbols have."""
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    names, own = table["symbol"].to_pylist(), table["own"].to_pylist()
    moves = [{x["day"]: x["r"] for x in m} for m in table["moves"].to_pylist()]
    days = sorted(set().union(*moves))
    grid = np.array([[m.get(day, np.nan) for day in days] for m in moves])
    has = ~np.isnan(grid)
    x, one = np.where(has, grid, 0.0), has.astype(float)
    a, b = np.triu_indices(len(names), 1)
    keep = np.array([left == right or own[i] != own[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
    a, b = a[keep], b[keep]
    n = (one @ one.T)[a, b]
    seen = n > 0
    a, b, n = a[seen], b[seen], n[seen]
    sums, squares, both = x @ one.T, (x * x) @ one.T, x @ x.T
    sx, sy, sxx, syy, sxy = sums[a, b], sums[b, a], squares[a, b], squares[b, a], both[a, b]
    # Means are taken off first, so that small moves keep their digits.
    var_x, var_y, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    flat = (var_x <= 1e-12 * sxx) | (var_y <= 1e-12 * syy)
    corr = np.divide(cov, np.sqrt(np.where(flat, 1.0, var_x * var_y)), out=np.full(len(n), np.nan), where=~flat)
    first = [names[i] < names[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    pairs = [(names[i], names[j]) if f else (names[j], names[i]) for i, j, f in zip(a.tolist(), b.tolist(), first, strict=True)]
    return pa.table({"a": pa.array([p for p, _ in pairs], pa.string()), "b": pa.array([q for _, q in pairs], pa.string()), "n": pa.array(n.astype(np.int64)), "corr": pa.array(corr, from_pandas=True)})
