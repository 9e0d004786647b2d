"""Market tables derived from the star-schema tables: ticks, bars, metadata, watermarks, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prices in cents are below this, line numbers below 8; so orders up to 6e10 make a place of 63 bits.
_CENTS = 1 << 24


#: All that tells trades of a day apart.
_FULL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order lines that a task takes at once where a query deals them by symbol.
TASK_LINES = 100_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """So many tasks that each has about ``TASK_LINES`` order lines, by the files' counts; one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_LINES))


def ticks(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """A trade for each order line, at a price of whole cents; by: region, nation or supplier."""
    lines = table(spark, sf_dir, "lineitem").select(*_FULL, "l_shipdate")
    if by == "supplier":
        named = lines.withColumn("symbol", F.col("l_suppkey").cast("string"))
    else:
        places = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        places = places.join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        named = lines.join(places.select("s_suppkey", F.col("r_name" if by == "region" else "n_name").alias("symbol")), F.col("l_suppkey") == F.col("s_suppkey"))
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5)
    place = (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * _CENTS + cents
    return named.select("symbol", F.col("l_shipdate").cast("date").alias("date"), (cents / 100).alias("price"), F.col("l_quantity").alias("qty"), place.alias("place"), F.struct(*_FULL).alias("ord"))


def bars(spark: SparkSession, sf_dir: str, by: str = "region", full: bool = False) -> DataFrame:
    """Daily bars; one shuffle, with partial aggregates before it.

    full: trades that share order and line stand in the order of all their columns, which costs a sort.

    A trade's place is its order, line and price in one number, so the first and the last price of a day are in the least
    and the greatest place: plain numbers, which Spark adds up in hash tables.
    """
    trades = ticks(spark, sf_dir, by).groupBy("symbol", "date")
    if full:
        return trades.agg(F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close"), F.sum("qty").alias("volume"))
    rows = trades.agg(
        F.min("place").alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max("place").alias("last"), F.sum("qty").alias("volume")
    )
    price = lambda c: (F.pmod(F.col(c), F.lit(_CENTS)) / 100).alias
    return rows.select("symbol", "date", price("first")("open"), "high", "low", price("last")("close"), "volume")


def raw_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a time of day, some of them twice on a day with another close."""
    b = bars(spark, sf_dir).withColumn("timestamp", F.col("date").cast("timestamp")).withColumn("interval", F.lit("1d"))
    again = b.where(F.dayofmonth("date") % 7 == 0).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 6 HOURS")).withColumn("close", F.floor(F.col("close") * 101 + 0.5) / 100)
    return b.unionByName(again).drop("date")


def symbol_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("s_suppkey")
    return joined.select(
        k.cast("string").alias("symbol"), F.col("s_name").alias("name"), F.col("r_name").alias("market"), F.col("n_name").alias("industry"),
        F.when(k % 3 == 0, "CS").when(k % 3 == 1, "ETF").otherwise("PFD").alias("type"),
        F.when(k % 11 == 0, "False").when(k % 7 == 0, F.lit(None)).otherwise("True").alias("active"),
        F.floor(F.col("s_acctbal") * 1000000 + 0.5).cast("long").alias("marketcap"),
    )


def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir, "supplier").groupBy("symbol").agg(F.max("date").alias("latest_date"), F.count(F.lit(1)).alias("n"))
    k = F.col("symbol").cast("long")
    now = b.where(k % 13 != 0).select("symbol", "latest_date", (k % 8 + 1).alias("records_count"), F.lit(True).alias("is_current"))
    old = b.where((k % 13 != 0) & (k % 2 == 0)).select("symbol", F.date_sub("latest_date", 30).alias("latest_date"), (k % 8 + 1).alias("records_count"), F.lit(False).alias("is_current"))
    return now.unionByName(old)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candle records; the place in the day's order is (event_time, event_id)."""
    e = table(spark, sf_dir, "events")
    v = F.floor(F.col("value") * 100 + 0.5) / 100
    return e.select(
        F.lit("ohlcv").alias("record_type"), F.col("event_type").alias("symbol"), v.alias("open_price"), v.alias("high_price"), v.alias("low_price"), v.alias("close_price"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"), F.col("ts").cast("timestamp").alias("event_time"), "event_id",
    )
