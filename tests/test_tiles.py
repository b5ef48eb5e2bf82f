"""Correlations by tiles against plain ones: several tiles and chunks, gaps, constant series, chosen pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest

from lodestar.operators import pairs, tiles

REACH = 4


@pytest.fixture(scope="module")
def series():
    draw = np.random.default_rng(3)
    data = pd.DataFrame({f"S{k}": draw.normal(1e-3, 0.01, 150) for k in range(9)})
    data["S1"] = data["S0"].shift(3) + draw.normal(0, 0.001, 150)
    data["S2"] = data["S0"].shift(-2) * -1 + draw.normal(0, 0.001, 150)
    data.loc[:60, "S3"] = np.nan  # begins late
    data.loc[draw.random(150) < 0.2, "S4"] = np.nan
    data["S5"] = 0.1  # constant
    data.loc[5:, "S6"] = np.nan  # ends early
    return data


@pytest.fixture(scope="module")
def rows(spark, series):
    long = [(s, i, float(x)) for s in series for i, x in series[s].items() if x == x]
    return spark.createDataFrame(long, "symbol string, i int, ret double")


def plain(series, a, b, lag):
    x, y = series[a], series[b].shift(-lag)
    there = x.notna() & y.notna()
    r = np.corrcoef(x[there], y[there])[0, 1] if there.sum() > 1 and x[there].std() > 1e-12 and y[there].std() > 1e-12 else None
    return int(there.sum()), r


@pytest.mark.parametrize("tile,chunk", [(2, 16), (3, 150), (64, 2048), (1, 7)])
def test_all_pairs_at_all_lags(rows, series, tile, chunk):
    got = {(r.a, r.b, r.lag): (r.n, r.corr) for r in tiles.lag_sums(tiles.pack(rows, REACH, None, chunk, tile), None, REACH).withColumn("corr", tiles.correlation()).collect()}
    for a, b in itertools.combinations(series, 2):
        for lag in range(-REACH, REACH + 1):
            n, r = plain(series, a, b, lag)
            found = got.pop((a, b, lag), (0, None))
            assert found[0] == n and (r is None) == (found[1] is None)
            assert r is None or found[1] == pytest.approx(r, abs=1e-9)
    assert not got


def test_chosen_pairs_only_and_their_lags(spark, rows, series):
    wanted = spark.createDataFrame([("S0", "S1"), ("S0", "S2"), ("S3", "S8"), ("S0", "S5"), ("S0", "S1"), ("S6", "S7")], "a string, b string")
    assert {(r.a, r.b) for r in tiles.lag_sums(tiles.pack(rows, REACH + 3, 9, 16, 2), wanted, REACH).select("a", "b").distinct().collect()} == {(r.a, r.b) for r in wanted.distinct().collect()}
    best = {(r.a, r.b): r for r in pairs.best_lags(rows, wanted, REACH).collect()}
    assert set(best) == {("S0", "S1"), ("S0", "S2"), ("S3", "S8")}  # too few rows, or none that vary, give no lag
    assert (best["S0", "S1"].lag, best["S0", "S1"].leader) == (3, "S0") and (best["S0", "S2"].lag, best["S0", "S2"].leader) == (-2, "S2")
    assert best["S0", "S2"].corr < -0.9


def test_constant_stretches_and_empty_tables(spark, rows):
    few = spark.createDataFrame([("A", i, 0.1 if i < 20 else float(i)) for i in range(40)] + [("B", i, float(i % 7)) for i in range(20)], "symbol string, i int, ret double")
    assert pairs.correlations(few).count() == 0  # A does not vary where B is
    assert pairs.correlations(rows.limit(0)).count() == 0 and pairs.best_lags(rows, rows.limit(0).selectExpr("symbol AS a", "symbol AS b")).count() == 0


def test_the_rows_are_packed_by_one_shuffle(rows):
    plan = tiles.blocks(rows, 4, REACH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("Exchange hashpartitioning") <= 2  # by symbol for the mean, by tile and chunk


def test_clusters_of_long_chains_keep_a_short_plan(spark):
    for length in (5, 40):  # with a plan that grew by each round the first was of millions of characters
        links = [(f"S{k:02}", f"S{k + 1:02}", 0.9) for k in range(length - 1)] + [("X", "Y", 0.9), ("W", "X", 0.9), ("S00", "Y", 0.1)]
        names = sorted({s for a, b, _ in links for s in (a, b)} | {"Z"})
        found = pairs.clusters(spark.createDataFrame(links[::-1], "a string, b string, corr double"), spark.createDataFrame([(s,) for s in names], "symbol string"), 0.5)
        assert len(found._jdf.queryExecution().toString()) < 50_000
        want = {s: ("S00", length) if s[0] == "S" else ("Z", 1) if s == "Z" else ("W", 3) for s in names}
        assert {r.symbol: (r.cluster, r.size) for r in found.collect()} == want
