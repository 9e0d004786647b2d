"""Sinks and table maintenance (K operators): pure functions on DataFrames, and thin writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import top_n, with_day
from . import versions


def _date(d: str | Column) -> Column:
    return F.lit(d).cast("date") if isinstance(d, str) else d


def write_bronze(df: DataFrame, path: str, mode: str = "append") -> None:
    """K1: a file for each symbol and day."""
    df.withColumn("date", F.to_date("timestamp")).repartition("symbol", "date").write.mode(mode).option("compression", "snappy").partitionBy("symbol", "date").parquet(path)


def write_metadata_manifest(meta: DataFrame, root: str, rows: int = 1000) -> str:
    """What S3 reads: parts of about ``rows`` symbols, each one JSON list, and a manifest that names them. Returns the manifest's path."""
    parts = max(1, -(-meta.count() // rows))
    part = F.pmod(F.xxhash64("symbol"), F.lit(parts)).cast("int").alias("part")
    lists = meta.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*meta.columns))).alias("value"))
    lists.write.partitionBy("part").text(f"{root}/parts")
    names = lists.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.concat(F.lit("parts/part="), F.col("part").cast("string")))).alias("part_keys"))).alias("value"))
    names.coalesce(1).write.text(f"{root}/manifest")
    return f"{root}/manifest"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """K2: the new rows (one for each key, the last by ``order``) and the old rows of other keys."""
    new = top_n(new, keys, [F.desc(order) if order else F.lit(1)], 1)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_table(new: DataFrame, path: str, keys: list[str], partition_by: list[str], order: str | None = None) -> None:
    """K2 on disk: only the partitions that the new rows touch are read and written again.

    The partition columns must follow from the keys, else a row that changes its partition leaves its old self behind.
    """
    spark = new.sparkSession
    new = top_n(new, keys, [F.desc(order) if order else F.lit(1)], 1)
    old = spark.read.schema(new.schema).parquet(path) if versions.exists(spark, path) else new.limit(0)
    touched = old.join(new.select(*partition_by).distinct(), partition_by, "left_semi")
    out = upsert(touched, new, keys, order).select(*new.columns)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """K3: rows appended."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def merge_statement(table: str, staging: str, keys: list[str], columns: list[str]) -> str:
    """The database's own upsert from a staging table."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    put = ", ".join(f"{c} = s.{c}" for c in columns if c not in keys)
    update = f"WHEN MATCHED THEN UPDATE SET {put} " if put else ""
    return f"MERGE INTO {table} t USING {staging} s ON {on} {update}WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join('s.' + c for c in columns)})"


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], staging: str | None = None, order: str | None = None, **options: str) -> None:
    """K3: Spark writes all executors' rows to a staging table, then the database merges it in one statement of its own."""
    staging = staging or f"{table}_staging"
    rows = top_n(df, keys, [F.desc(order) if order else F.lit(1)], 1)
    write_jdbc(rows, url, staging, "overwrite", **options)
    run_jdbc(df.sparkSession, url, merge_statement(table, staging, keys, df.columns), options.get("driver"))


def run_jdbc(spark, url: str, statement: str, driver: str | None = None) -> None:
    """One statement in the database."""
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.java.lang.Class.forName(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.createStatement().executeUpdate(statement)
    finally:
        connection.close()


def snapshot_bootstrap(raw: DataFrame, end: str | Column | None = None, days: int = 1825) -> DataFrame:
    """K4: the latest bar of each symbol and day, trimmed to ``days`` before the last date."""
    bars = raw.where(F.col("interval") == "1d").withColumn("date", F.to_date("timestamp"))
    if end is not None:
        bars = bars.where(F.col("date").between(F.date_sub(_date(end), days), _date(end)))
    latest = top_n(bars, ["symbol", "date"], [F.desc("timestamp")], 1)
    columns = ["date", "symbol", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]]
    return trim_retention(latest.select(*columns), days)


def snapshot_incremental(snap: DataFrame, raw: DataFrame, scan_date: str | Column | DataFrame, days: int = 1825) -> DataFrame:
    """K5: the day's rows are replaced; a day without bars leaves the snapshot as it is."""
    new = snapshot_bootstrap(with_day(raw, scan_date).where(F.to_date("timestamp") == F.col("_day")).drop("_day"), None, days)
    has_new = F.broadcast(new.agg((F.count(F.lit(1)) > 0).alias("_new")))
    kept = with_day(snap, scan_date).crossJoin(has_new).where(~F.col("_new") | (F.col("date") != F.col("_day"))).drop("_new", "_day")
    return trim_retention(kept.unionByName(new), days)


def snapshot_report(snap: DataFrame, added: DataFrame) -> DataFrame:
    total = snap.agg(F.count(F.lit(1)).alias("rows_total"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    return total.crossJoin(F.broadcast(added.agg(F.count(F.lit(1)).alias("rows_added"))))


def trim_retention(df: DataFrame, days: int = 1825) -> DataFrame:
    """K6: relative to the last date in the data."""
    last = F.broadcast(df.agg(F.max("date").alias("_last")))
    return df.crossJoin(last).where(F.col("date") >= F.date_sub("_last", days)).drop("_last")


def retain_years(df: DataFrame, years: int, today: str | Column) -> DataFrame:
    """K7"""
    return df.where(F.col("date") >= F.date_sub(_date(today), 365 * years + 30))


def publish_snapshot(df: DataFrame, root: str, date: str) -> None:
    """K8: the rows as history of the date and as the latest; sorted so that files can be skipped.

    The rows are written once, to a folder of their own; then the manifest names that folder for the date and as the
    latest. A reader during the publication gets the old snapshot or the new one. Of several publishers the last wins.
    """
    spark = df.sparkSession
    folder = versions.write_version(df.repartitionByRange("symbol").sortWithinPartitions("symbol", "date"), root, date)
    known = versions.read_manifest(spark, root)
    versions.swap_manifest(spark, root, {"latest": folder, "history": known.get("history", {}) | {date: folder}})


def read_snapshot(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """The latest snapshot, or that of a date."""
    known = versions.read_manifest(spark, root)
    folder = known.get("history", {}).get(date) if date else known.get("latest")
    if folder is None:
        raise ValueError(f"no snapshot {date or 'yet'} in {root}")
    return spark.read.parquet(f"{root}/{folder}")


def compaction_plan(watermark: DataFrame, manifest: DataFrame) -> DataFrame:
    """(symbol, mode, consolidated_to): a symbol without a consolidated date is built in full, one whose watermark is newer by
    its newer days, and the others are skipped."""
    plan = watermark.where("is_current").groupBy("symbol").agg(F.max("latest_date").alias("latest")).join(manifest, "symbol", "left")
    mode = F.when(F.col("consolidated_to").isNull(), "full").when(F.col("latest") > F.col("consolidated_to"), "incremental").otherwise("skip")
    return plan.select("symbol", mode.alias("mode"), "consolidated_to")


def _to_add(bronze: DataFrame, plan: DataFrame) -> DataFrame:
    todo = bronze.join(plan.where("mode <> 'skip'"), "symbol").where("mode = 'full' OR date > consolidated_to")
    return todo.drop("mode", "consolidated_to")


def compact(bronze: DataFrame, consolidated: DataFrame, watermark: DataFrame, manifest: DataFrame) -> DataFrame:
    """K9: for each symbol its consolidated rows and the newer daily rows, each row once. Only symbols that get rows are looked through for copies.

    ``manifest`` has (symbol, consolidated_to).
    """
    plan = compaction_plan(watermark, manifest)
    todo = _to_add(bronze, plan)
    open_ = plan.where("mode <> 'skip'").select("symbol")
    touched = consolidated.join(open_, "symbol", "left_semi").unionByName(todo).dropDuplicates()
    return consolidated.join(open_, "symbol", "left_anti").unionByName(touched)


def compact_table(bronze: DataFrame, path: str, watermark: DataFrame) -> None:
    """K9 on disk: ``path`` has a folder for each symbol; only the folders of symbols that get rows are read and written again.

    What is consolidated is read from the table itself, dates and symbols alone. Files of other symbols stay as they are.
    """
    spark = bronze.sparkSession
    if versions.exists(spark, path):
        old = spark.read.schema(bronze.schema).parquet(path)
        manifest = old.groupBy("symbol").agg(F.max("date").alias("consolidated_to"))
    else:
        old, manifest = bronze.limit(0), bronze.limit(0).select("symbol", F.col("date").alias("consolidated_to"))
    todo = _to_add(bronze, compaction_plan(watermark, manifest))
    touched = old.join(todo.select("symbol").distinct(), "symbol", "left_semi")
    out = touched.select(*bronze.columns).unionByName(todo.select(*bronze.columns)).dropDuplicates()
    out.repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def vacuum_plan(files: DataFrame, consolidated: DataFrame, days: int, today: str | Column) -> DataFrame:
    """Day files (path, symbol, date, size) that may go: old ones of symbols with a consolidated file. Nothing is deleted."""
    return files.where(F.col("date") < F.date_sub(_date(today), days)).join(consolidated.select("symbol").distinct(), "symbol", "left_semi")


def vacuum_report(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def archive_split(raw: DataFrame, archive: DataFrame, today: str | Column, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows older than three years and a month go to the archive unless their key is there; what stays, the archive, and a log row.

    Old rows leave only if at least one of them was newly archived.
    """
    keys = keys or ["symbol", "timestamp", "interval"]
    old = F.col("date") < F.add_months(_date(today), -37)
    new = raw.where(old).join(archive.select(*keys), keys, "left_anti")
    some = F.broadcast(new.agg((F.count(F.lit(1)) > 0).alias("_some")))
    kept = raw.crossJoin(some).where(~(F.coalesce(old, F.lit(False)) & F.col("_some"))).drop("_some")
    log = raw.where(old).agg(F.count(F.lit(1)).alias("old_rows")).crossJoin(F.broadcast(new.agg(F.count(F.lit(1)).alias("archived"))))
    log = log.withColumn("deleted", F.when(F.col("archived") > 0, F.col("old_rows")).otherwise(F.lit(0)))
    log = log.withColumn("status", F.when(F.col("archived") == F.col("old_rows"), "success").when(F.col("archived") > 0, "partial_success").otherwise("failed"))
    return kept, archive.unionByName(new), log


def recover_gap(df: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """The bars of a window, to be written by ``write_bronze``."""
    return df.where(F.col("date").between(_date(start), _date(end)))


def write_resampled(df: DataFrame, path: str) -> None:
    """By interval, symbol, year and month, a file each."""
    parts = ["interval", "symbol", "year", "month"]
    df.withColumns({"year": F.year("date"), "month": F.month("date")}).repartition(*parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def read_resampled(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_resampled`` wrote. The schema is given, as an interval such as 3d in a folder's name would be read as a number."""
    return spark.read.schema("symbol string, interval string, date date, open double, high double, low double, close double, volume double, year int, month int").parquet(path)


def clear_staging(df: DataFrame, date: str | Column) -> DataFrame:
    """K14"""
    return df.where(F.col("scan_date") != _date(date))


#: Days that candles of an interval live.
TTL = {"1m": 7, "5m": 7, "15m": 30, "30m": 30, "1h": 90, "2h": 90, "4h": 90}


def with_ttl(df: DataFrame, ts: str = "window_start", interval: str = "interval_type") -> DataFrame:
    """Expiry in epoch seconds."""
    days = F.create_map(*[x for k, v in TTL.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("expire_at", F.unix_timestamp(ts) + F.element_at(days, F.col(interval)) * 86400)
