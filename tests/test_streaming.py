"""A stream that is read to its end gives what the same functions give on a table, but for windows still open."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.schemas import CANDLE_EVENT
from tickloom.sources import readers
from tickloom.streaming import candles, state

START = dt.datetime(2026, 1, 5, 10)


def events(spark, n=600):
    rows = [("ohlcv", "AB"[i % 2], float(100 + i % 7), float(101 + i % 7), 99.0, float(100 + i % 5), i % 3, START + dt.timedelta(seconds=41 * i)) for i in range(n)]
    rows += [("ohlcv", s, 1.0, 1.0, 1.0, 1.0, 1, START + dt.timedelta(days=30)) for s in "AB"]  # closes the windows
    rows += [("noise", "A", 1.0, 1.0, 1.0, 1.0, 1, START), ("ohlcv", "A", 0.0, 1.0, 1.0, 1.0, 1, START)]
    return spark.createDataFrame(rows, CANDLE_EVENT)


def closed(df):
    return sorted(map(str, df.where(F.col("window_start") < F.lit(START + dt.timedelta(days=29))).collect()))


def test_cascade_equals_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    events(spark).write.parquet(src)
    stream = readers.read_candle_stream(spark, src)
    candles.run_level(candles.candles_1m(stream), str(tmp_path / "1m"), str(tmp_path / "c1")).start().awaitTermination()
    one = candles.candles_1m(spark.read.schema(CANDLE_EVENT).parquet(src))
    got = spark.read.parquet(str(tmp_path / "1m"))
    assert closed(got) == closed(one.select(*got.columns))
    lower = spark.readStream.schema(got.schema).parquet(str(tmp_path / "1m"))
    query = candles.roll_up(lower, "5m").writeStream.format("memory").queryName("five").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    five = spark.table("five")
    batch = candles.roll_up(one.where(F.col("window_start") < F.lit(START + dt.timedelta(days=29))), "5m")
    seen, expected = closed(five), closed(batch.select(*five.columns))
    assert set(seen) <= set(expected) and len(expected) - len(seen) <= 2


def test_higher_levels_stream_from_level_to_level(spark, tmp_path):
    """1 m to 5 m to 15 m to 1 h, each a query over the table of the level below."""
    src = str(tmp_path / "events")
    events(spark, 2500).write.parquet(src)
    candles.run_level(candles.candles_1m(spark.readStream.schema(CANDLE_EVENT).parquet(src)), str(tmp_path / "1m"), str(tmp_path / "c-1m")).start().awaitTermination()
    for name in ("5m", "15m", "1h"):
        lower = str(tmp_path / candles.LEVELS[name][1])
        schema = spark.read.parquet(lower).schema
        candles.run_level(candles.roll_up(spark.readStream.schema(schema).parquet(lower), name), str(tmp_path / name), str(tmp_path / f"c-{name}")).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / name))
        expected = closed(candles.cascade(spark.read.schema(CANDLE_EVENT).parquet(src), name).select(*got.columns))
        seen = closed(got)
        assert set(seen) <= set(expected) and len(expected) - len(seen) <= 2 * len(candles.LEVELS) and seen


def test_rules_over_earlier_candles_on_a_stream(spark, tmp_path):
    """Two micro-batches find what the rule finds on the whole table."""
    state.use_state_store(spark)
    whole = candles.cascade(events(spark, 2500), "15m").where(F.col("window_start") < F.lit(START + dt.timedelta(days=29)))
    whole = whole.withColumn("close_price", F.col("close_price") + F.hour("window_start") % 3 * 9)
    src = str(tmp_path / "in")
    middle = F.lit(START + dt.timedelta(hours=14))
    for name, rule in (("change", candles.price_change_alerts), ("channel", candles.channel_signals)):
        for part in (whole.where(F.col("window_start") < middle), whole.where(F.col("window_start") >= middle)):
            part.coalesce(1).write.mode("append").parquet(f"{src}-{name}")
            stream = spark.readStream.schema(whole.schema).parquet(f"{src}-{name}")
            candles.stream_rule(stream, rule, str(tmp_path / name), str(tmp_path / f"k-{name}")).start().awaitTermination()
        expected = rule(whole)
        found = spark.read.parquet(f"{tmp_path}/{name}/found").select(*expected.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and expected.count() > 0


def test_no_code_falls_back(spark):
    """The whole cascade compiles: no stage grows beyond what the JVM takes."""
    plan = candles.cascade(events(spark), "4h")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert plan.count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_route_and_upsert(spark, tmp_path):
    src = str(tmp_path / "c")
    good = candles.candles_1m(events(spark)).withColumn("interval_type", F.when(F.minute("window_start") == 5, "odd").otherwise(F.col("interval_type")))
    good.write.parquet(src)
    stream = spark.readStream.schema(good.schema).parquet(src)
    candles.route_candles(stream, str(tmp_path / "out"), str(tmp_path / "k1")).start().awaitTermination()
    routed, bad = spark.read.parquet(f"{tmp_path}/out/candles"), spark.read.parquet(f"{tmp_path}/out/quarantine")
    assert routed.count() + bad.count() == good.count() and bad.count() > 0 and routed.where("expire_at IS NULL").count() == 0
    candles.stream_upsert(stream, str(tmp_path / "t"), ["symbol"], str(tmp_path / "k2"), "window_start").start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    # Batches whose commit was lost are tried again: routed rows and the upserted table stay as they are.
    for k in ("k1", "k2"):
        for f in (tmp_path / k / "commits").glob("*"):
            f.unlink()
    before = (routed.drop("batch").count(), bad.count(), sorted(map(str, spark.read.parquet(f"{tmp_path}/t").collect())))
    candles.route_candles(stream, str(tmp_path / "out"), str(tmp_path / "k1")).start().awaitTermination()
    candles.stream_upsert(stream, str(tmp_path / "t"), ["symbol"], str(tmp_path / "k2"), "window_start").start().awaitTermination()
    routed, bad = spark.read.parquet(f"{tmp_path}/out/candles"), spark.read.parquet(f"{tmp_path}/out/quarantine")
    assert before == (routed.count(), bad.count(), sorted(map(str, spark.read.parquet(f"{tmp_path}/t").collect())))
    assert routed.where("batch IS NULL").count() == 0 and set(routed.select("interval_type").distinct().toPandas()["interval_type"]) == {"1m"}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    """A row inside the delay still counts, one beyond it doesn't and changes no candle that is out."""
    src, at = str(tmp_path / "in"), lambda s: START + dt.timedelta(seconds=s)
    batches = [[(10, 1.0), (50, 2.0), (140, 3.0)], [(115, 9.0), (20, 77.0), (300, 4.0)], [(900, 5.0)]]
    for rows in batches:
        events = [("ohlcv", "A", p, p, p, p, 1, at(s)) for s, p in rows]
        spark.createDataFrame(events, CANDLE_EVENT).coalesce(1).write.mode("append").parquet(src)
        stream = readers.read_candle_stream(spark, src)
        candles.run_level(candles.candles_1m(stream), str(tmp_path / "out"), str(tmp_path / "k")).start().awaitTermination()
    got = {r.window_start: (r.open_price, r.high_price, r.close_price, r.trade_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[at(0)] == (1.0, 2.0, 2.0, 2) and got[at(60)] == (9.0, 9.0, 9.0, 1) and got[at(120)] == (3.0, 3.0, 3.0, 1)


def test_messages_that_are_no_json_are_dropped(spark, tmp_path):
    """JSON values, as a topic has them, from text files."""
    good = '{"record_type": "ohlcv", "symbol": "A", "open_price": 1, "high_price": 2, "low_price": 1, "close_price": 1.5, "volume": 7, "event_time": "2026-01-05T10:00:30.250001Z", "more": 1}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([good, "{broken", "[1, 2]", "", good.replace("10:00:30", "10:05:00")]))
    stream = readers.read_candle_stream(spark, str(tmp_path / "in"), "text")
    candles.run_level(candles.candles_1m(stream), str(tmp_path / "out"), str(tmp_path / "k")).start().awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (row.symbol, row.close_price, row.volume, row.window_start) == ("A", 1.5, 7, START)
    raw = spark.createDataFrame([(bytearray(good.encode()),), (None,)], "value binary")
    events = readers.candle_messages(raw).collect()
    assert events[0].event_time == dt.datetime(2026, 1, 5, 10, 0, 30, 250001) and events[1].symbol is None


ALERT = "alert_id string, symbol string, window_start timestamp, price double, note string"


def _alerts(spark, minutes):
    return spark.createDataFrame([(a, "S", START + dt.timedelta(seconds=60 * m + 0.000123), None if k % 3 else float(k), f"n{k}") for k, (a, m) in enumerate(minutes)], ALERT)


def _shown(minutes, gap=5):
    """One by one: shown if more than ``gap`` minutes after the last shown of its name."""
    last, out = {}, []
    for k, (a, m) in sorted(enumerate(minutes), key=lambda x: x[1][1]):
        if a not in last or m > last[a] + gap:
            last[a] = m
            out.append(f"n{k}")
    return sorted(out)


def test_dedupe_alerts_on_a_table(spark):
    assert candles.dedupe_alerts(_alerts(spark, [("a", 0), ("a", 3), ("a", 9)])).count() == 2
    minutes = [("a", 4 * i) for i in range(15)] + [("b", m) for m in (0, 5, 6, 7, 11, 12, 40, 44, 46)] + [(None, 1), (None, 2)]
    got = candles.dedupe_alerts(_alerts(spark, minutes))
    assert sorted(r.note for r in got.collect()) == _shown(minutes) and got.schema == _alerts(spark, minutes).schema
    assert len(_shown(minutes[:15])) == 8


def test_dedupe_alerts_on_a_stream_is_the_table(spark, tmp_path):
    """Rows out of order inside the delay, in five batches."""
    state.use_state_store(spark)
    minutes = [("a", 4 * i) for i in range(15)] + [("b", m) for m in (0, 6, 7, 12, 20, 33, 50)] + [("c", 1), ("a", 39), ("b", 58)]
    table, src = _alerts(spark, minutes), str(tmp_path / "in")
    shown = []
    for k in range(5):
        part = table.where((F.col("window_start") >= F.lit(START + dt.timedelta(minutes=12 * k))) & (F.col("window_start") < F.lit(START + dt.timedelta(minutes=12 * k + 12))))
        part.orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ALERT).parquet(src)
        out = candles.dedupe_alerts(stream, delay="12 minutes").writeStream.option("checkpointLocation", str(tmp_path / "k")).outputMode("append").trigger(availableNow=True)
        out.format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        shown.append(spark.read.schema(ALERT).parquet(str(tmp_path / "out")).count())
    late = _alerts(spark, [("z", 900)])
    late.write.mode("append").parquet(src)
    stream = candles.dedupe_alerts(spark.readStream.schema(ALERT).parquet(src), delay="12 minutes")
    stream.writeStream.option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    got = spark.read.schema(ALERT).parquet(str(tmp_path / "out"))
    same = lambda df: sorted(map(str, df.where("alert_id <> 'z'").collect()))
    assert same(got) == same(candles.dedupe_alerts(table)) and shown == sorted(shown)


def test_ten_batches_read_no_more_than_the_look_back(spark, tmp_path):
    """What a micro-batch sees stays flat while the history grows, and the rule finds what it finds on the whole table."""
    state.use_state_store(spark)
    hours = [(s, START + dt.timedelta(minutes=15 * i), float(100 + (i * 7 + ord(s)) % 23)) for i in range(400) for s in "AB"]
    whole = spark.createDataFrame(hours, "symbol string, window_start timestamp, close_price double")
    src, sizes = str(tmp_path / "in"), []
    for k in range(10):
        part = whole.where((F.col("window_start") >= F.lit(START + dt.timedelta(hours=10 * k))) & (F.col("window_start") < F.lit(START + dt.timedelta(hours=10 * k + 10))))
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(whole.schema).parquet(src)
        candles.stream_rule(stream, candles.price_change_alerts, str(tmp_path / "r"), str(tmp_path / "k"), back="2 hours").start().awaitTermination()
        sizes.append(spark.read.parquet(f"{tmp_path}/r/seen").count())
    assert sizes == [80] + [2 * (40 + 8)] * 9
    expected = candles.price_change_alerts(whole)
    found = spark.read.parquet(f"{tmp_path}/r/found").select(*expected.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and expected.count() > 100
