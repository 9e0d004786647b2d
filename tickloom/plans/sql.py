"""SQL of the derived tables, shared by the twins of the queries."""

from __future__ import annotations

_ORD = "l_orderkey, l_linenumber, price"
#: All that tells trades of a day apart.
_FULL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_FROM = {
    "region": ("r_name", "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "nation": ("n_name", "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"),
    "supplier": ("CAST(l_suppkey AS VARCHAR)", "lineitem"),
}


def bars(by: str = "region", name: str = "bars", full: bool = False) -> str:
    """full: trades that share order and line stand in the order of all their columns, not of their prices."""
    symbol, tables = _FROM[by]
    order, columns = (_FULL, _FULL) if full else (_ORD, "l_orderkey, l_linenumber")
    return f"""t_{name} AS (SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_quantity AS qty,
{columns} FROM {tables}),
{name} AS (SELECT symbol, date, first(price ORDER BY {order}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {order}) AS close, sum(qty) AS volume
FROM t_{name} GROUP BY symbol, date)"""


RAW = f"""{bars()},
raw AS (SELECT symbol, open, high, low, close, volume, CAST(date AS TIMESTAMP) AS timestamp, '1d' AS interval FROM bars
  UNION ALL SELECT symbol, open, high, low, floor(close * 101 + 0.5) / 100, volume, CAST(date AS TIMESTAMP) + INTERVAL 6 HOURS, '1d' FROM bars WHERE day(date) % 7 = 0)"""

META = """meta AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, r_name AS market, n_name AS industry,
  CASE s_suppkey % 3 WHEN 0 THEN 'CS' WHEN 1 THEN 'ETF' ELSE 'PFD' END AS type,
  CASE WHEN s_suppkey % 11 = 0 THEN 'False' WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'True' END AS active,
  CAST(floor(s_acctbal * 1000000 + 0.5) AS BIGINT) AS marketcap FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

WM = f"""{bars("supplier", "sbars")},
wm0 AS (SELECT symbol, max(date) AS latest_date, CAST(symbol AS BIGINT) AS k FROM sbars GROUP BY symbol),
wm AS (SELECT symbol, latest_date, k % 8 + 1 AS records_count, true AS is_current FROM wm0 WHERE k % 13 <> 0
  UNION ALL SELECT symbol, latest_date - 30, k % 8 + 1, false FROM wm0 WHERE k % 13 <> 0 AND k % 2 = 0)"""

EVENTS = """ev AS (SELECT event_type AS symbol, floor(value * 100 + 0.5) / 100 AS p, CAST(json_extract(props, '$.k') AS BIGINT) AS volume, ts AS event_time, event_id FROM events),
ok AS (SELECT * FROM ev WHERE symbol IS NOT NULL AND p > 0 AND volume >= 0)"""


def resampled(n: int, source: str = "bars") -> str:
    start = f"DATE '1970-01-01' + CAST(floor((date - DATE '1970-01-01') / {n}.0) * {n} AS INTEGER)"
    return f"SELECT symbol, {start} AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM {source} GROUP BY symbol, {start}"


def ema(source: str, periods, name: str = "e", value: str = "close", part: str = "symbol") -> str:
    """Recursive averages e_<p>, alpha 2/(p+1), along ``part`` and date."""
    first = ", ".join(f"{value} AS ema_{p}" for p in periods)
    then = ", ".join(f"2.0 / {p + 1} * o.{value} + (1 - 2.0 / {p + 1}) * r.ema_{p}" for p in periods)
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY date) AS rn FROM {source}),
{name} AS (SELECT {name}_o.*, {first} FROM {name}_o WHERE rn = 1 UNION ALL SELECT o.*, {then} FROM {name} r
JOIN {name}_o o ON {" AND ".join(f"o.{c.strip()} = r.{c.strip()}" for c in part.split(","))} AND o.rn = r.rn + 1)"""


def rolling(agg: str, value: str, n: int, part: str = "symbol", shift: int = 0, last: int | None = None) -> str:
    """An aggregate over the last n rows, null until there are n."""
    w = f"OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({value}) {w} = {n} THEN {agg}({value}) {w} END"
