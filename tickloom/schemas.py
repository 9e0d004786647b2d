"""Column types of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_OHLCV = "symbol STRING, open DECIMAL(10,2), high DECIMAL(10,2), low DECIMAL(10,2), close DECIMAL(10,2), volume BIGINT, timestamp TIMESTAMP, interval STRING"
BARS = "date DATE, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
METADATA = "symbol STRING, name STRING, market STRING, locale STRING, active STRING, primary_exchange STRING, type STRING, marketcap BIGINT, industry STRING, description STRING"
WATERMARK = "watermark_id BIGINT, symbol STRING, latest_date DATE, ingested_at TIMESTAMP, records_count BIGINT, is_current BOOLEAN"
SIGNALS = "scan_date DATE, symbol STRING, strategy_name STRING, signal STRING, price DECIMAL(12,4), confidence DECIMAL(5,4), metadata STRING"
PICKS = "scan_date DATE, rank INT, symbol STRING, strategy_name STRING, signal STRING, price DECIMAL(12,4), confidence DECIMAL(5,4), score DOUBLE, metadata STRING"
CANDLE_EVENT = "record_type STRING, symbol STRING, open_price DOUBLE, high_price DOUBLE, low_price DOUBLE, close_price DOUBLE, volume BIGINT, event_time TIMESTAMP"
CHECKPOINT = "interval STRING, last_processed_date DATE, record_count BIGINT, status STRING"

PRICES = ("open", "high", "low", "close")
BAR_COLUMNS = ("date", "symbol", *PRICES, "volume")
KEYS = {"bars": ["symbol", "timestamp", "interval"], "metadata": ["symbol"], "signals": ["scan_date", "symbol", "strategy_name"]}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
