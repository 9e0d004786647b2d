"""Tables on disk: versions behind a manifest, compaction by folder, and resampling that goes on where it stopped."""

import datetime as dt
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, bookkeeping, joins, resample
from tickloom.sources import readers, resampled, sinks, versions

DAY = dt.date(2026, 1, 1)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def bars(spark, symbols="ABC", days=60, first=0, seed=1):
    rng = random.Random(seed)
    rows = [(s, DAY + dt.timedelta(i), *[float(rng.randrange(10, 99)) for _ in range(5)]) for s in symbols for i in range(first, days) if rng.random() < 0.9]
    return spark.createDataFrame(rows, BARS)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_readers_see_the_old_snapshot_or_the_new_one(spark, tmp_path):
    root = str(tmp_path / "snap")
    with pytest.raises(ValueError, match="no snapshot"):
        sinks.read_snapshot(spark, root)
    sinks.publish_snapshot(bars(spark, days=10), root, "2026-01-10")
    before = sinks.read_snapshot(spark, root)
    sizes, errors, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                sizes.add(sinks.read_snapshot(spark, root).count())
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in (20, 30):
        sinks.publish_snapshot(bars(spark, days=k), root, f"2026-01-{k}")
    stop.set()
    reader.join()
    assert not errors and sizes <= {bars(spark, days=k).count() for k in (10, 20, 30)}
    assert same(before, bars(spark, days=10))  # who has read the old manifest reads on
    assert same(sinks.read_snapshot(spark, root), bars(spark, days=30)) and same(sinks.read_snapshot(spark, root, "2026-01-20"), bars(spark, days=20))
    sinks.publish_snapshot(bars(spark, days=21), root, "2026-01-20")
    assert same(sinks.read_snapshot(spark, root, "2026-01-20"), bars(spark, days=21)) and len(versions.unused(spark, root)) == 1


def test_compaction_leaves_the_files_of_other_symbols(spark, tmp_path):
    path = str(tmp_path / "c")
    mark = lambda df: df.groupBy("symbol").agg(F.max("date").alias("latest_date")).withColumn("is_current", F.lit(True))
    old = bars(spark, days=30)
    sinks.compact_table(old, path, mark(old))
    assert same(spark.read.parquet(path), old)
    first = files(path)
    new = old.unionByName(bars(spark, "B", days=40, first=30, seed=2)).unionByName(bars(spark, "D", days=5, seed=3))
    sinks.compact_table(new, path, mark(new))
    second = files(path)
    of = lambda found, s: {f for f in found if f.startswith(f"symbol={s}/")}
    assert same(spark.read.parquet(path), new)
    assert of(first, "A") == of(second, "A") and of(first, "C") == of(second, "C") and not of(first, "B") & of(second, "B") and of(second, "D")
    sinks.compact_table(new, path, mark(new))
    assert files(path) == second  # nothing is newer, nothing is written


def test_upsert_into_an_unreadable_table_is_an_error(spark, tmp_path):
    """Only a missing table counts as none."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        sinks.upsert_table(bars(spark, days=3), str(tmp_path / "t"), ["symbol", "date"], ["symbol"])
    assert (tmp_path / "t" / "part-0.parquet").exists()


@pytest.mark.parametrize("cuts", [(60,), (7, 60), (1, 2, 3, 20, 20, 60), tuple(range(5, 61, 5))])
def test_resampling_in_runs_is_resampling_at_once(spark, tmp_path, cuts):
    whole, root = bars(spark), str(tmp_path / "r")
    for k in cuts:
        resampled.run(whole.where(F.col("date") < F.lit(DAY + dt.timedelta(k))), root, (3, 5))
    for n in (3, 5):
        got = resampled.read_buckets(spark, root).where(F.col("interval") == f"{n}d").drop("interval")
        assert same(got, resample.resample_rows(whole, n, by="row"))
    rows = {r.interval: r for r in resampled.read_checkpoint(spark, root).collect()}
    counts = {s: n for s, n in whole.groupBy("symbol").count().collect()}
    for n in (3, 5):
        assert rows[f"{n}d"].record_count == sum(c // n for c in counts.values()) and rows[f"{n}d"].status == "completed"
        assert rows[f"{n}d"].last_processed_date == whole.agg(F.max("date")).first()[0]


def test_resampling_reads_what_is_new_and_knows_new_symbols(spark, tmp_path):
    root, table = str(tmp_path / "r"), str(tmp_path / "bars")
    bars(spark, days=40).write.partitionBy("date").parquet(table)
    resampled.run(spark.read.schema(BARS).parquet(table), root, (4,))
    bars(spark, days=44, first=40, seed=5).write.mode("append").partitionBy("date").parquet(table)
    for old in Path(table).glob("date=2026-01-0*"):  # days long past: a run that goes on doesn't open them
        for f in old.glob("*.parquet"):
            f.write_text("broken")
        for f in old.glob(".*.crc"):
            f.unlink()
    resampled.run(spark.read.schema(BARS).parquet(table), root, (4,))
    whole = bars(spark, days=40).unionByName(bars(spark, days=44, first=40, seed=5))
    assert same(resampled.read_buckets(spark, root).drop("interval"), resample.resample_rows(whole, 4, by="row"))
    late = whole.unionByName(bars(spark, "Z", days=50, seed=6))
    resampled.run(late, root, (4,))
    assert same(resampled.read_buckets(spark, root).drop("interval"), resample.resample_rows(late, 4, by="row"))
    resampled.run(late.where("symbol <> 'A'"), root, (4,), force_full=True)
    assert same(resampled.read_buckets(spark, root).drop("interval"), resample.resample_rows(late.where("symbol <> 'A'"), 4, by="row"))


def test_resampling_of_nothing(spark, tmp_path):
    (row,) = resampled.run(bars(spark).limit(0), str(tmp_path / "r"), (3,)).collect()
    assert (row.interval, row.last_processed_date, row.record_count, row.status) == ("3d", None, 0, "empty")


@pytest.mark.parametrize("days", [1, 7, 32, 1000])
def test_interval_join_meets_little_more_than_it_returns(spark, days):
    b = bars(spark, "AB", days=400)
    rows = [(s, DAY + dt.timedelta(i), DAY + dt.timedelta(i + n)) for s in "AC" for i, n in ((0, 5), (3, 90), (31, 1), (32, 0), (350, 200), (10, -4))]
    trades = spark.createDataFrame(rows, "symbol string, entry_date date, exit_date date")
    expected = sorted((t[0], t[1], t[2], r.date) for t in rows for r in b.collect() if r.symbol == t[0] and t[1] < r.date <= t[2])
    got = joins.bars_in_trade(trades, b, days)
    assert sorted((r.symbol, r.entry_date, r.exit_date, r.date) for r in got.collect()) == expected
    assert set(got.columns) == {*trades.columns, *b.columns} and "Cartesian" not in got._jdf.queryExecution().toString()
    # Without the dates' condition a trade meets its own bars and those of its first and last bucket.
    of = lambda c: F.floor(F.unix_date(c) / days)
    met = trades.join(b.withColumnRenamed("symbol", "s"), (F.col("symbol") == F.col("s")) & of("date").between(of("entry_date"), F.greatest(of("entry_date"), of("exit_date")))).count()
    assert met <= len(expected) + 2 * days * len(rows)


def test_position_history_columns(spark):
    trades = spark.createDataFrame([("A", DAY, 10.0, DAY + dt.timedelta(3), 2.0)], "symbol string, entry_date date, entry_price double, exit_date date, shares double")
    out = backtest.position_history(trades, bars(spark, "A", days=10))
    assert all(r.unrealised == pytest.approx((r.close - 10) * 2) and 0 < r.days_held <= 3 for r in out.collect()) and out.count() > 0


def test_manifest_names_every_part(spark, tmp_path):
    rows = [(str(i), None if i % 3 == 0 else f"name, \"{i}\"\nof two lines", i) for i in range(100)]
    meta = spark.createDataFrame(rows, "symbol string, name string, marketcap long")
    root = f"file://{tmp_path}/m"
    found = readers.read_metadata_manifest(spark, sinks.write_metadata_manifest(meta, root, rows=10), root)
    assert same(meta, found)
    assert len(list((tmp_path / "m" / "parts").glob("part=*"))) == 10


def test_sessions_prune_folders(spark, tmp_path):
    path = f"file://{tmp_path}/bronze"
    b = bars(spark, days=20).withColumns({"timestamp": F.col("date").cast("timestamp"), "interval": F.lit("1d")})
    sinks.write_bronze(b, path)
    sinks.write_bronze(b.where("date = '2026-01-05'"), path)  # appended: a second file for the day
    got = readers.read_bronze(spark, path, dates=["2026-01-05", "2026-01-06", "2027-01-01"], columns=["symbol", "close", "timestamp"])
    expected = b.where("date = '2026-01-05'").unionByName(b.where("date IN ('2026-01-05', '2026-01-06')")).select("symbol", "close", "timestamp")
    assert same(expected, got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    count = {d: b.where(F.col("date") == d).count() for d in ("2026-01-05", "2026-01-06")}  # one bar of a symbol a day
    assert len({r.f for r in got.select(F.col("_metadata.file_path").alias("f")).collect()}) == 2 * count["2026-01-05"] + count["2026-01-06"]


@pytest.mark.parametrize("kind", ["text", "column", "table", "empty"])
def test_a_day_is_a_date_a_column_or_a_table(spark, kind):
    snap = bars(spark, days=10)
    last = snap.agg(F.max("date").alias("last"))
    day = {"text": "2026-01-10", "column": F.lit("2026-01-10").cast("date"), "table": spark.sql("SELECT date'2026-01-10' AS d"), "empty": last.where("last < '2000-01-01'").agg(F.max("last"))}[kind]
    raw = snap.withColumns({"timestamp": F.col("date").cast("timestamp"), "interval": F.lit("1d"), "close": F.col("close") + 1}).drop("date")
    out = sinks.snapshot_incremental(snap, raw, day)
    if kind == "empty":  # no day: nothing is replaced
        assert same(out, snap)
    else:
        assert same(out, snap.withColumn("close", F.when(F.col("date") == "2026-01-10", F.col("close") + 1).otherwise(F.col("close"))))
    meta = spark.createDataFrame([("A", "True"), ("B", None), ("C", "False"), ("Z", "True")], "symbol string, active string")
    live = {r.symbol for r in bookkeeping.scannable(meta, snap, day).collect()}
    assert live == (set() if kind == "empty" else {r.symbol for r in snap.where("date = '2026-01-10'").collect()} & {"A", "B"})


@pytest.mark.parametrize("schema", [None, "symbol string, close double, timestamp timestamp, date date"])
def test_symbols_that_look_like_numbers_stay_text(spark, tmp_path, schema):
    rows = [(s, dt.datetime(2026, 1, d), float(d)) for s in ("0700", "7203", "3D") for d in (5, 6)]
    sinks.write_bronze(spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double"), f"file://{tmp_path}/b")
    for dates, n in ((None, 6), (["2026-01-06"], 3)):
        got = readers.read_bronze(spark, f"file://{tmp_path}/b", dates, ["symbol", "timestamp", "close"], schema)
        assert dict(got.dtypes)["symbol"] == "string"
        assert {r.symbol for r in got.collect()} == {"0700", "7203", "3D"} and got.count() == n


def test_a_manifest_is_there_while_it_is_swapped(spark, tmp_path):
    root, seen, stop = f"file://{tmp_path}/m", [], threading.Event()
    versions.swap_manifest(spark, root, {"latest": 0})

    def read():
        while not stop.is_set():
            seen.append(versions.read_manifest(spark, root).get("latest"))

    readers_ = [threading.Thread(target=read) for _ in range(3)]
    for r in readers_:
        r.start()
    for k in range(1, 101):
        versions.swap_manifest(spark, root, {"latest": k})
    stop.set()
    for r in readers_:
        r.join()
    assert seen and None not in seen and versions.read_manifest(spark, root) == {"latest": 100}
