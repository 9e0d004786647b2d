"""Operators that remember: per-key state on streams, and the same results on tables.

Spark keeps the state by key in its state store, checkpoints it, and moves it with the key; a micro-batch reads the
state of the keys that it holds and nothing of earlier batches. The store must be RocksDB: ``use_state_store`` sets it.

Rows travel through the state as JSON next to their key and time, so any schema passes without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.alerts import spaced

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: A row in the state: its time in microseconds, and itself.
_ROW = StructType([StructField("at", LongType()), StructField("row", StringType())])


def use_state_store(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB."""
    spark.conf.set(STORE, ROCKSDB)


def micros(width: str) -> int:
    """Microseconds of a width such as ``5 minutes``."""
    n, unit = width.split()
    return int(n) * 1_000_000 * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _packed(df: DataFrame, keys: tuple[str, ...], time: str) -> DataFrame:
    """The key as one text, the time, and the row."""
    key = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    return df.select(key.alias("key"), F.col(time).alias("time"), F.unix_micros(F.col(time)).alias("at"), F.to_json(F.struct(*df.columns), _EXACT).alias("row"))


def _unpacked(df: DataFrame, schema: StructType, *more: Column) -> DataFrame:
    return df.select(F.from_json("row", schema, _EXACT).alias("r"), *more).select("r.*", *[c for c in df.columns if c not in ("row", "at", "key", "time")])


def _rows_of(frames: Iterator[pd.DataFrame]) -> list[tuple[int, str]]:
    return sorted((int(at), row) for frame in frames for at, row in zip(frame["at"], frame["row"], strict=True))


class _History(StatefulProcessor):
    """Keeps a key's rows of the last ``back`` microseconds; gives these and the batch's own."""

    def __init__(self, back: int) -> None:
        self.back = back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", _ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old, new = [(int(at), row) for at, row in self.kept.get()], _rows_of(rows)
        first, last = new[0][0], max(new[-1][0], old[-1][0] if old else new[-1][0])
        seen = [r for r in old if r[0] >= first - self.back]
        self.kept.put(sorted(r for r in (*old, *new) if r[0] >= last - self.back))
        yield pd.DataFrame({"row": [r for _, r in (*seen, *new)], "fresh": [False] * len(seen) + [True] * len(new)})

    def close(self) -> None:
        pass


def with_history(stream: DataFrame, back: str = "36 hours", keys: tuple[str, ...] = ("symbol",), time: str = "window_start") -> DataFrame:
    """The stream's rows with those of the same key from ``back`` before on: ``fresh`` tells them apart.

    State holds the look-back of each key and no more, so what a micro-batch reads doesn't grow with the history.
    """
    out = _packed(stream, keys, time).drop("time").groupBy("key").transformWithStateInPandas(_History(micros(back)), "row string, fresh boolean", "Append", "None")
    return _unpacked(out, stream.schema, F.col("fresh"))


class _Spaced(StatefulProcessor):
    """Shows a row, and the next one only more than ``gap`` microseconds later. Rows wait until the watermark has passed them."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.shown = handle.getValueState("shown", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows_of(rows)
        self.waiting.appendList(new)
        for milli in sorted({-(-at // 1000) for at, _ in new}):
            self.handle.registerTimer(milli)
        yield pd.DataFrame({"row": []}, dtype=str)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted((int(at), row) for at, row in self.waiting.get())
        last, out = self.shown.get(), []
        last = None if last is None else int(last[0])
        for at, row in rows:
            if at > due:
                break
            if last is None or at > last + self.gap:
                last = at
                out.append(row)
        left = [r for r in rows if r[0] > due]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if last is not None:
            self.shown.update((last,))
        yield pd.DataFrame({"row": out}, dtype=str)

    def close(self) -> None:
        pass


def dedupe(alerts: DataFrame, within: str, time: str, keys: tuple[str, ...], delay: str = "1 minute") -> DataFrame:
    """Of each key's rows the first, and then each that comes more than ``within`` after the last one shown.

    On a stream, rows wait for the watermark, ``delay`` behind the newest row, and are judged in the order of their
    times; so the stream shows what the table shows, whatever batches its rows come in. Rows of one time go by their
    content. On a table, a pause of more than ``within`` starts anew whatever came before, so groups are runs without
    such a pause, and of a run only the times are walked, from shown row to shown row.
    """
    gap = micros(within)
    if alerts.isStreaming:
        rows = _packed(alerts.withWatermark(time, delay), keys, time)
        out = rows.groupBy("key").transformWithStateInPandas(_Spaced(gap), "row string", "Append", "EventTime")
        return _unpacked(out, alerts.schema)
    packed = _packed(alerts, keys, time).drop("time").where("at IS NOT NULL")
    order = Window.partitionBy("key").orderBy("at")
    before = F.lag("at").over(order)
    runs = packed.withColumn("run", F.sum(F.when(before.isNull() | (F.col("at") > before + gap), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def walk(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("at", "ascending"), ("row", "ascending")]))
        return table.select(["row"]).filter(pa.array(spaced(np.asarray(table["at"]), gap)))

    return _unpacked(runs.groupBy("key", "run").applyInArrow(walk, "row string"), alerts.schema)
