"""Alerts and candidate lists (L operators). Bars carry an integer ``interval`` in days."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indicators import ema, fresh, over, running
from .strategies import OBSERVE, OTHER_DAYS, _ema4, velocity_status

BY = ("symbol", "interval")
#: L3: half width of the band by interval; other intervals.
TOLERANCE, OTHER_TOLERANCE = {1: 0.002, 3: 0.02, 5: 0.05, 8: 0.07, 13: 0.1}, 0.02


def _velocity(df: DataFrame) -> DataFrame:
    # The status is a rule of the row, so any frame with the averages will do.
    return velocity_status(ema(df, (8, 13, 144, 169), by=BY), "velocity")


def _momentum(df: DataFrame) -> tuple[DataFrame, Column]:
    """L2's kind, as a column over the table with what it reads."""
    out = df
    flags = {"bad": F.col("velocity") != "velocity_maintained", "good": F.col("velocity") == "velocity_maintained"}
    out, last, helpers = running(out, flags, BY)

    def counted(flag: str) -> Column:
        value = last(flag, OTHER_DAYS)
        for length in sorted(set(OBSERVE.values())):
            value = F.when(F.col("interval").isin([k for k, v in OBSERVE.items() if v == length]), last(flag, length)).otherwise(value)
        return value

    bad, good = fresh(out, "_nb", "_ng")
    out = out.withColumns({bad: counted("bad"), good: counted("good")}).drop(*helpers)
    short_min, short_max, _, long_max = _ema4()
    more = F.col(bad) > F.col(good)
    return out, F.when((long_max <= short_max) & (F.col("open") < F.col("close")) & more, "accelerated").when((F.col("close") < short_min) & more, "decelerated")


def _touch() -> Column:
    """L3's kind, null without a touch."""
    short_min, short_max, long_min, long_max = _ema4()
    t: Column = F.lit(OTHER_TOLERANCE)
    for k, v in TOLERANCE.items():
        t = F.when(F.col("interval") == k, v).otherwise(t)
    low, high = F.coalesce(long_min, F.col("ema_13")) * (1 - t), F.coalesce(long_max, F.col("ema_13")) * (1 + t)
    touch = F.col("low").between(low, high) | F.col("ema_13").between(low, high) | F.col("ema_8").between(low, high)
    kind = F.when((short_min > long_max) & (F.least("close", "open") > long_min), "support").when((short_max < long_max) & (F.col("close") < long_max), "resistance").otherwise("neutral")
    return F.when(touch, kind)


def _alerts(out: DataFrame, kind: str, signal: Column) -> DataFrame:
    return out.select(*BY, "date", F.lit(kind).alias("alert_type"), signal.alias("signal")).where("signal IS NOT NULL")


def velocity_alert(df: DataFrame) -> DataFrame:
    """L1"""
    return _alerts(_velocity(df), "velocity_alert", F.col("velocity"))


def momentum_alert(df: DataFrame) -> DataFrame:
    """L2: no cooldown, looser rules than the strategy's."""
    out, kind = _momentum(_velocity(df))
    return _alerts(out, "momentum_alert", kind)


def ema_touch_alert(df: DataFrame) -> DataFrame:
    """L3"""
    return _alerts(ema(df, (8, 13, 144, 169), by=BY), "ema_touch", _touch())


def all_alerts(df: DataFrame, days: int = 5 * 365) -> DataFrame:
    """L4: the three kinds, for the last ``days`` of each interval. One pass over each series finds all three."""
    return weighed_alerts(df, days).drop("w")


def weighed_alerts(df: DataFrame, days: int = 5 * 365, ends: DataFrame | None = None) -> DataFrame:
    """``all_alerts`` with the interval's place among all intervals as ``w``, so that nothing reads the alerts twice.

    Every bar has a velocity, so the alerts have the bars' intervals and last dates. ends: (interval, date), each
    interval's last date, for who knows it without reading the bars.
    """
    out, momentum = _momentum(_velocity(df))
    ends = df.groupBy("interval").agg(F.max("date").alias("date")) if ends is None else ends
    start = ends.select("interval", F.date_sub("date", days).alias("from"), F.dense_rank().over(Window.orderBy("interval")).alias("w"))  # a handful of intervals
    kinds = {"velocity_alert": F.col("velocity"), "momentum_alert": momentum, "ema_touch": _touch()}
    # Days come first, so kinds are told of the rows that stay.
    pairs = F.array(*[F.struct(F.lit(k).alias("alert_type"), kind.alias("signal")) for k, kind in kinds.items()])
    return _since(out, start).select(*BY, "date", F.inline(pairs), "w").where("signal IS NOT NULL")


def _since(rows: DataFrame, start: DataFrame) -> DataFrame:
    """Rows from each interval's date on. start: (interval, from), one row for each interval. It is sent to the tasks: a
    join that deals rows by interval would put all of them into as many tasks as there are intervals."""
    start = F.broadcast(start.withColumnsRenamed({"interval": "_interval", "from": "_from"}))
    return rows.join(start, (rows["interval"] == F.col("_interval")) & (rows["date"] >= F.col("_from"))).drop("_interval", "_from")


_NAMES = ("accelerated", "decelerated", "support", "resistance", "neutral", "velocity_maintained", "velocity_weak", "velocity_loss")


def signal_counts(alerts: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """A3: counts of each signal by symbol and interval (or also by date), all touches as ``touches``, and as ``w`` the
    interval's place among all those of the alerts, which weighed alerts have already."""
    known = "w" in alerts.columns
    out = alerts.groupBy(*by).agg(*[F.count_if(F.col("signal") == n).alias(n) for n in _NAMES], *([F.max("w").alias("w")] if known else []))
    out = out.withColumn("touches", F.col("support") + F.col("resistance") + F.col("neutral"))
    if known:
        return out
    places = alerts.select("interval").distinct().withColumn("w", F.dense_rank().over(Window.orderBy("interval")))  # a handful of intervals
    return out.join(F.broadcast(places), "interval")


def _on_last_date(alerts: DataFrame) -> DataFrame:
    return _since(alerts, alerts.groupBy("interval").agg(F.max("date").alias("from")))


def on_last_days(alerts: DataFrame, days: int) -> DataFrame:
    """The alerts of the last days of each interval."""
    return _since(alerts, alerts.groupBy("interval").agg(F.date_sub(F.max("date"), days).alias("from")))


def _rules() -> dict[str, Column]:
    """The categories over ``signal_counts``: of short intervals (5 days at most), and of long ones (8 at least)."""
    w, n = F.col("w"), F.col("interval")
    faster = (w * F.col("accelerated") > 1) & (w * F.col("decelerated") < 1)
    held = (w * F.col("support") > 1) & (w * F.col("resistance") < 1)
    kept = (w * F.col("velocity_maintained") > 0) & (F.col("velocity_weak") == 0) & (F.col("velocity_loss") == 0)
    return {
        "accelerating": faster & (n <= 3), "long_accelerating": faster & (n == 5), "long_accumulating": held & (F.col("touches") >= 1) & (n == 5),
        "velocity_maintained": kept & (n >= 8), "accumulating": held & (F.col("touches") >= 2) & (n <= 3),
    }


#: Categories of L5, of L6 and of each date in L7.
MICRO, MACRO = ("accelerating", "long_accelerating", "long_accumulating"), ("velocity_maintained",)
CATEGORIES = MICRO + MACRO


def _lists(alerts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    rules = _rules()
    named = signal_counts(alerts).withColumn("category", F.explode(F.array_compact(F.array(*[F.when(rules[k], k) for k in names]))))
    return named.groupBy("category").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def candidates_micro(alerts: DataFrame) -> DataFrame:
    """Symbols by category, from the alerts of short intervals."""
    return _lists(alerts, MICRO)


def candidates_macro(alerts: DataFrame) -> DataFrame:
    """Symbols whose long intervals keep their velocity."""
    return _lists(alerts, MACRO)


def candidates_accumulating(alerts: DataFrame) -> DataFrame:
    """Symbols that the short intervals touched twice or more, supported and never resisted."""
    return _lists(alerts, ("accumulating",))


def candidates_by_date(alerts: DataFrame) -> DataFrame:
    """A row for each date, the latest first, with a list of symbols for each category; a list may be empty.

    All dates are judged in one pass: counts by date, symbol and interval, weighed by the interval's place among all
    intervals of the alerts, and the categories' symbols collected by date. What fits no category is one row a date
    before dates are put together.
    """
    rules = _rules()
    counts = signal_counts(alerts, ("date", *BY))
    found = F.array_compact(F.array(*[F.when(rules[k], k) for k in CATEGORIES]))
    named = counts.select("date", "symbol", F.explode_outer(found).alias("category"))
    named = named.select("date", "category", F.when(F.col("category").isNotNull(), F.col("symbol")).alias("symbol")).distinct()
    lists = [F.sort_array(F.collect_list(F.when(F.col("category") == k, F.col("symbol")))).alias(k) for k in CATEGORIES]
    return named.groupBy("date").agg(*lists).orderBy(F.desc("date"))


def latest_candidates(cands: DataFrame) -> DataFrame:
    """The lists of the last date, a row for each category."""
    last = cands.agg(F.max(F.struct("date", *CATEGORIES)).alias("last")).where("last IS NOT NULL").select("last.*")
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("symbols")) for k in CATEGORIES])
    return last.select("date", F.inline(pairs))


def spaced(at: np.ndarray, gap: int) -> np.ndarray:
    """Which of rising places are shown: the first, and then each that lies more than ``gap`` past the last shown one."""
    shown, i = np.zeros(len(at), bool), 0
    while i < len(at):
        shown[i] = True
        i = int(np.searchsorted(at, at[i] + gap, side="right"))
    return shown


def touch_alert_suppressed(df: DataFrame, quiet: int = 3, memory: int = 50) -> DataFrame:
    """Touches that no shown touch of the same kind precedes within ``quiet`` bars, with the touches shown in the last ``memory`` bars.

    Whether a touch is shown depends on those shown before, so each series is walked in its group, from shown touch to
    shown touch. Bars are numbered before; the group gets the touches alone.
    """
    numbered = ema(df, (8, 13, 144, 169), by=BY).withColumns({"touch": _touch(), "_at": F.row_number().over(over(BY)).cast("long")})
    touches = numbered.where("touch IS NOT NULL").select(*BY, "date", "touch", "_at")
    schema = T.StructType([*touches.drop("_at").schema.fields, T.StructField("touch_count", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("_at", "ascending")]))
        at, kinds = table["_at"].to_numpy(), table["touch"].to_numpy()
        shown = np.zeros(len(at), bool)
        for kind in set(kinds):
            own = np.flatnonzero(kinds == kind)
            shown[own[spaced(at[own], quiet)]] = True
        places = at[shown]
        counts = np.arange(1, len(places) + 1) - np.searchsorted(places, places - memory, side="right")
        return table.filter(pa.array(shown)).drop_columns(["_at"]).append_column("touch_count", pa.array(counts, pa.int64()))

    return touches.groupBy(*BY).applyInArrow(run, schema)
