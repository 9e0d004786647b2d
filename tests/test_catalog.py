"""Every query with a SQL twin agrees with it."""

import math

import duckdb
import pytest

from tickloom.plans import catalog, coverage, registry  # noqa: F401  they fill the registry

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _value(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x if x is None or isinstance(x, (int, bool)) else str(x)


def _sorted(rows):
    return sorted((tuple(map(_value, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(db.sql(registry.ORACLES[name]).columns)
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert _sorted(df.select(*columns).collect()) == _sorted(expected)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def _lines(spark, folder, rows):
    """A folder with these order lines: order, line, part, supplier, quantity, price, day."""
    import datetime as dt

    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    table = [(*r[:-1], dt.datetime.fromisoformat(r[-1])) for r in rows]
    schema = ", ".join(f"{c} {k}" for c, k in zip(names, ("long", "int", "long", "long", "double", "double"), strict=True)) + ", l_shipdate timestamp_ntz"
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_trades_of_one_line_stand_in_the_order_of_all_columns(spark, tmp_path):
    from tickloom.sources import driver_tables as t

    d = _lines(spark, tmp_path, [(1, 1, 7, 5, 1.0, 20.0, "2000-01-01"), (1, 1, 9, 5, 1.0, 10.0, "2000-01-01"), (1, 1, 8, 5, 1.0, 30.0, "2000-01-01")])
    bar = t.bars(spark, d, "supplier", full=True).collect()[0]
    assert (bar.open, bar.close, bar.high, bar.low, bar.volume) == (20.0, 10.0, 30.0, 10.0, 3.0)
    for name in ("pct_change", "all_indicators", "score_multi_tf"):
        assert "l_partkey, l_suppkey, l_quantity, l_extendedprice" in registry.ORACLES[name]


def test_the_scan_is_cut_at_its_date():
    """Bars are made wider after the cut, so no bar of several days holds days past the scan."""
    text = registry.ORACLES["score_multi_tf"]
    assert "cut AS (SELECT * FROM bars WHERE date <=" in text and text.count("FROM cut GROUP BY") == 2 and text.count("k <= 5") == 3


def test_tasks_grow_with_the_order_lines(spark, tmp_path, monkeypatch):
    from tickloom.sources import driver_tables as t

    d = _lines(spark, tmp_path, [(i, 1, 1, i, 1.0, 1.0, "2000-01-01") for i in range(100)])
    assert t.tasks(spark, d) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(t, "TASK_LINES", 3)
    assert t.tasks(spark, d) == 34
    scored = registry.QUERIES["score_multi_tf"](spark, d)
    assert "hashpartitioning(symbol" in (plan := scored._jdf.queryExecution().executedPlan().toString()) and ", 34), REPARTITION_BY_NUM" in plan
