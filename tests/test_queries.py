"""Every registered query with SQL gives DuckDB's rows; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.catalog()
#: Fits that take long even on the smallest tables; test_models covers their parts.
SLOW = {"param_sweep", "lambda_select", "walkforward_costs", "panel_rf", "panel_gbt", "lambda_holdout_share", "lambda_holdout_days", "window_forest", "window_boosting", "sector_forest", "sector_boosting", "walkforward_daily"}


def plain(v):
    return "None" if v is None or v != v else repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(cols, data):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_agree_with_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    r = duck.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_other_queries_run(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    assert rows.columns and rows.count() > 0


def test_entry_has_rows_and_columns(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "spread", "sectors"]


def test_scan_reads_only_what_is_asked(spark, sf):
    plan = QUERIES["date_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "l_extendedprice" not in plan
