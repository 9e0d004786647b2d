"""Readers, and the normalisation of what they read (S and P operators)."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resample import resample_all
from ..schemas import BAR_COLUMNS, CANDLE_EVENT, PRICES, struct

STANDARD = ("symbol", *PRICES, "volume", "timestamp", "interval")
TIMEFRAMES = {"1d": 1, "3d": 3, "5d": 5, "8d": 8, "13d": 13, "21d": 21, "34d": 34, "55d": 55}
#: Types of instruments that can be traded.
TRADABLE = ("CS", "ADRC", "ETF", "ETV", "PFD")
INTERVALS = ("1m", "5m", "15m", "30m", "1h", "2h", "4h", "1d")
SOURCES = ("polygon", "websocket", "rest", "replay")


def read_bronze(spark: SparkSession, path: str, dates: Iterable[str] | None = None, columns: Iterable[str] = STANDARD, schema: str | None = None) -> DataFrame:
    """Bars under symbol=/date= folders, only the named columns, optionally only some session dates (pruned folders).

    With a ``schema`` (DDL) no file is opened to find one, and a file of other types fails the read. Without one a symbol is
    text too, also where all folders' names look like numbers, such as 0700 or 3D.
    """
    columns = list(columns)
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if not schema and dict(df.dtypes).get("symbol", "string") != "string":
        df = spark.read.schema(T.StructType([T.StructField("symbol", T.StringType()) if f.name == "symbol" else f for f in df.schema])).parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kind = dict(df.dtypes).get("timestamp", "")
    if "timestamp" in columns and not kind.startswith("timestamp"):
        raise ValueError(f"timestamp is {kind}")
    if dates is not None:
        day = F.col("date") if "date" in df.columns else F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"date=(\d{4}-\d{2}-\d{2})", 1))
        df = df.where(day.cast("date").isin([F.lit(d).cast("date") for d in dates]))
    return df.select(*columns)


def read_metadata_manifest(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """S3: parts named by ``part_keys``, else the inline ``metadata`` list."""
    doc = spark.read.json(path, multiLine=True)
    if "part_keys" in doc.columns:
        keys = doc.select(F.explode("part_keys").alias("k")).toLocalIterator()  # a manifest is one short list of file names
        return spark.read.json([f"{root or path.rsplit('/', 1)[0]}/{r['k']}" for r in keys], multiLine=True)
    if "metadata" in doc.columns:
        return doc.select(F.inline("metadata"))
    raise ValueError("a manifest has part_keys or metadata")


def load_bars(df: DataFrame, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None, ordered: bool = False) -> DataFrame:
    """Bars of symbols in [start, end]; both filters reach the files. They are sorted on request only, as that is a shuffle."""
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") < F.date_add(F.lit(end).cast("date"), 1))
    return df.orderBy("symbol", "date") if ordered else df


def load_multi_timeframe(bars: DataFrame, timeframes: Iterable[str]) -> DataFrame:
    """Bars of several timeframes with a ``timeframe`` column, after one shuffle; unknown names are skipped."""
    known = [t for t in timeframes if t in TIMEFRAMES]
    if not known:
        return bars.limit(0).select(*BAR_COLUMNS, F.lit("").alias("timeframe"))
    names = F.create_map(*[x for t in known for x in (F.lit(TIMEFRAMES[t]), F.lit(t))])
    return resample_all(bars, [TIMEFRAMES[t] for t in known]).select(*BAR_COLUMNS, names[F.col("n")].alias("timeframe"))


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table or query, split over ``partitions`` ranges of ``column`` if one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table or f"({query}) q").options(**options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def candle_messages(raw: DataFrame, schema: str = CANDLE_EVENT) -> DataFrame:
    """Candle events from messages: JSON in ``value``, bytes or text. A message that isn't JSON of an object gives a row of nulls, which ``valid_bars`` drops."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def read_candle_stream(spark: SparkSession, source: str, fmt: str = "parquet", schema: str = CANDLE_EVENT, **options: str) -> DataFrame:
    """A stream of candle events: from files, or from JSON messages of a Kafka topic (``kafka``) or of text files, one a line (``text``)."""
    if fmt == "kafka":
        return candle_messages(spark.readStream.format("kafka").option("subscribe", source).options(**options).load(), schema)
    if fmt == "text":
        return candle_messages(spark.readStream.format("text").options(**options).load(source), schema)
    return spark.readStream.format(fmt).schema(struct(schema)).options(**options).load(source)


def load_silver(tables: dict[int, DataFrame]) -> DataFrame:
    """Tables of several intervals, tagged."""
    return reduce(DataFrame.unionByName, [df.withColumn("interval", F.lit(n)) for n, df in tables.items()])


def latest_date(df: DataFrame, by: str | None = None) -> DataFrame:
    """The last date, of each ``by`` or of all."""
    return df.groupBy(by).agg(F.max("date").alias("latest_date")) if by else df.agg(F.max("date").alias("latest_date"))


def latest_rows(df: DataFrame) -> DataFrame:
    """The rows of the last date; the other side is one row."""
    return df.crossJoin(F.broadcast(latest_date(df))).where(F.col("date") == F.col("latest_date")).drop("latest_date")


def to_double(df: DataFrame) -> DataFrame:
    """P1"""
    return df.withColumns({c: F.col(c).cast("double") for c in (*PRICES, "volume")})


def normalize_bars(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Canonical columns; the date comes from the timestamp if there is none."""
    if "date" not in df.columns:
        df = df.withColumn("date", F.to_date("timestamp"))
    if symbol is not None:
        df = df.withColumn("symbol", F.lit(symbol))
    return df.select(*BAR_COLUMNS)


def valid_bars(df: DataFrame) -> DataFrame:
    """P3"""
    ok = (F.col("record_type") == "ohlcv") & F.col("symbol").isNotNull() & (F.col("volume") >= 0)
    return df.where(reduce(Column.__and__, [F.col(f"{p}_price") > 0 for p in PRICES], ok))


def conforms(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the event schema, and the rest."""
    rules = [F.col("symbol").rlike("^[A-Z]{1,10}$")] + [F.col(f"{p}_price") >= 0 for p in PRICES] + [F.col("volume") >= 0]
    rules += [F.col(c).isin(*allowed) for c, allowed in (("interval_type", INTERVALS), ("source", SOURCES)) if c in df.columns]
    ok = F.coalesce(reduce(Column.__and__, rules), F.lit(False))
    return df.where(ok), df.where(~ok)


def normalize_event(df: DataFrame) -> DataFrame:
    """P5: short or long field names of vendor messages to the candle record; a field under both names counts as the short one says, if it says anything."""
    names = {"symbol": ("sym", "symbol"), "open_price": ("o", "open"), "high_price": ("h", "high"), "low_price": ("l", "low"), "close_price": ("c", "close"), "volume": ("v", "volume"), "event_ms": ("e", "timestamp")}
    pick = {k: [F.col(c) for c in own if c in df.columns] for k, own in names.items()}
    return df.select(*[(F.coalesce(*cols) if cols else F.lit(None)).alias(k) for k, cols in pick.items()])


def map_metadata(df: DataFrame) -> DataFrame:
    """P6"""
    names = {"ticker": "symbol", "market_cap": "marketcap", "sic_description": "industry"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def tradable(df: DataFrame, types: Iterable[str] = TRADABLE) -> DataFrame:
    return df.where(F.col("type").isin(list(types)))


def from_vendor_bar(df: DataFrame) -> DataFrame:
    """Epoch milliseconds and short names to a raw bar."""
    return df.select("symbol", *[F.col(s).cast("decimal(10,2)").alias(p) for s, p in zip("ohlc", PRICES, strict=True)], F.col("v").cast("long").alias("volume"), F.timestamp_millis(F.col("t").cast("long")).alias("timestamp"))


def normalize_interval(col: Column) -> Column:
    """P8: '1hour' to '1h', '5min' to '5m', '1day' to '1d'."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(col), "hours?", "h"), "min(ute)?s?", "m"), "days?", "d")


def parse_ts(col: Column) -> Column:
    """ISO text, or epoch milliseconds (above 1e10) or seconds; otherwise null."""
    n = F.when(col.rlike(r"^\d+$"), col.try_cast("long"))
    return F.coalesce(F.when(n > 10_000_000_000, F.timestamp_millis(n)), F.timestamp_seconds(n), F.when(n.isNull(), F.try_to_timestamp(col)))


def norm_symbol(col: Column) -> Column:
    """P10"""
    return F.upper(F.trim(col))


def optional_filter(df: DataFrame, industry: str | None = None, type: str | None = None, min_marketcap: int | None = None, max_marketcap: int | None = None) -> DataFrame:
    """A parameter that isn't given filters nothing."""
    for cond in ((industry, F.col("industry") == industry), (type, F.col("type") == type), (min_marketcap, F.col("marketcap") >= (min_marketcap or 0)), (max_marketcap, F.col("marketcap") <= (max_marketcap or 0))):
        if cond[0] is not None:
            df = df.where(cond[1])
    return df


def with_metadata(df: DataFrame, **values: Column) -> DataFrame:
    """P13"""
    return df.withColumn("metadata", F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])))


def flatten_alerts(df: DataFrame, column: str = "alerts") -> DataFrame:
    """Fields of the nested struct as columns."""
    return df.select("*", f"{column}.*").drop(column)


def parse_horizons(text: str | None) -> list[int]:
    """Distinct horizons 1..252, rising; 1, 5, 21 by default."""
    if not text:
        return [1, 5, 21]
    found = sorted({int(x) for x in text.split(",") if x.strip()})
    if not found or found[0] < 1 or found[-1] > 252:
        raise ValueError("horizons lie in 1..252")
    return found


def read_json_text(text: str) -> dict:
    return json.loads(text)
