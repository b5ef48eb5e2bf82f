"""Every query with SQL gives the SQL's rows, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestar import catalog
from lodestar.operators.filters import FILTERS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float | np.floating):
        return round(float(v), 6) + 0.0
    if isinstance(v, int | np.integer):
        return int(v)
    return pd.Timestamp(v) if hasattr(v, "year") else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got_columns, got = rows_of(catalog.QUERIES[name](spark, SF).toPandas())
    want_columns, want = rows_of(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert got_columns == want_columns
    assert got == want


def test_all_queries_have_sql_or_a_test():
    filters = {f"ta_{name}" for name in FILTERS} | {"grid_search_ema_cross"}  # against loops in test_scan
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - filters <= {"page_text", "signal_news", "signal_energy", "signal_kinematics", "signal_cluster_reversion", "pair_clusters_whole", "pair_report_whole", "pair_report_summary_whole", "pair_lags_whole", "pair_spreads_whole", "monte_carlo_whole"}
