"""Candle patterns as boolean columns (C operators); a pattern whose earlier bars are missing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import fresh, over, series_of

#: C11: the direction that a pattern speaks for; a doji speaks for none. Both spellings of the engulfing ones.
DIRECTION = {
    "engulfing_bullish": "BUY", "bullish_engulfing": "BUY", "hammer": "BUY", "morning_star": "BUY", "green_candle": "BUY",
    "engulfing_bearish": "SELL", "bearish_engulfing": "SELL", "shooting_star": "SELL", "evening_star": "SELL", "red_candle": "SELL",
    "doji": None,
}
ALIASES = {"bullish_engulfing": "engulfing_bullish", "bearish_engulfing": "engulfing_bearish", "green": "green_candle", "red": "red_candle"}
NAMES = ("engulfing_bullish", "engulfing_bearish", "hammer", "shooting_star", "doji", "morning_star", "evening_star", "green_candle", "red_candle")


def _parts(by, doji: float, causal: bool, body1: str) -> dict[str, Column]:
    w = over(by)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    o1, c1, o2, c2 = F.lag("open", 1).over(w), F.lag("close", 1).over(w), F.lag("open", 2).over(w), F.lag("close", 2).over(w)
    body, span = F.abs(c - o), h - low
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    # Star patterns compare with the mean body of the bar before: over the whole series, or only up to here.
    mean = F.avg(body1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if causal else Window.partitionBy(*by))
    small = F.col(body1) <= 0.5 * mean
    middle = (o2 + c2) / 2
    return {
        "engulfing_bullish": (c1 < o1) & (c > o) & (o < c1) & (c > o1),
        "engulfing_bearish": (c1 > o1) & (c < o) & (o > c1) & (c < o1),
        "hammer": (body <= 0.3 * span) & (lower >= 2 * body) & (upper <= 0.5 * body),
        "shooting_star": (body <= 0.3 * span) & (upper >= 2 * body) & (lower <= 0.5 * body),
        "doji": body <= doji * span,
        "morning_star": (c2 < o2) & (o1 < c2) & small & (c > o) & (c > middle),
        "evening_star": (c2 > o2) & (o1 > c2) & small & (c < o) & (c < middle),
        "green_candle": c > o,
        "red_candle": c < o,
    }


def patterns(df: DataFrame, names=NAMES, by=None, threshold: float = 0.1, causal: bool = False) -> DataFrame:
    """The named patterns; columns that are there already stay."""
    by, (body1,) = by or series_of(df), fresh(df, "_body1")
    known = _parts(by, threshold, causal, body1)
    wanted = {n: known[ALIASES.get(n, n)] for n in names if n not in df.columns}
    if any(n.endswith("_star") and n != "shooting_star" for n in wanted):
        w = over(by)
        df = df.withColumn(body1, F.abs(F.lag("close").over(w) - F.lag("open").over(w)))
    return df.withColumns(wanted).drop(body1) if wanted else df


def pattern(df: DataFrame, name: str, **options) -> DataFrame:
    key = ALIASES.get(name.lower(), name.lower())
    if key not in NAMES:
        raise ValueError(f"unknown pattern {name}")
    return patterns(df, (key,), **options)


def doji(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    return patterns(df, ("doji",), threshold=threshold)


def all_patterns(df: DataFrame, by=None) -> DataFrame:
    return patterns(df, NAMES, by)


def engulfing_legacy(df: DataFrame, side: str, by=None) -> DataFrame:
    """Engulfing without the colour of the bar before."""
    w = over(by or series_of(df))
    o1, c1, o, c = F.lag("open").over(w), F.lag("close").over(w), F.col("open"), F.col("close")
    rule = (c > o) & (o < c1) & (c > o1) if side == "bullish" else (c < o) & (o > c1) & (c < o1)
    return df.withColumn(f"engulfing_legacy_{side}", rule)
