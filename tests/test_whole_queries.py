"""Queries without SQL that do the whole job of one with SQL, against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from lodestar import catalog
from lodestar.sources.bridge import bars

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def returns(spark):
    grid = bars(spark, SF).toPandas().pivot(index="ts", columns="symbol", values="close").sort_index().ffill()
    return np.log(grid / grid.shift()), np.log(grid.astype(float))


def test_pairs_take_all_times(spark, returns):
    ret, _ = returns
    got = {(r.a, r.b): (r.corr, r.n) for r in catalog.QUERIES["pair_correlations_whole"](spark, SF).collect()}
    names = list(ret.columns)
    assert len(got) == len(names) * (len(names) - 1) // 2 and max(n for _, n in got.values()) > 1000
    for (a, b), (corr, n) in got.items():
        both = ret[[a, b]].dropna()
        assert n == len(both) and corr == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=2e-6)


def test_pair_lags_reach_20(spark, returns):
    ret, _ = returns
    got = {(r.a, r.b): (r.lag, r.corr, r.leader) for r in catalog.QUERIES["pair_lags_whole"](spark, SF).collect()}
    assert max(abs(lag) for lag, _, _ in got.values()) > 5
    for (a, b), (lag, corr, leader) in got.items():
        found = {}
        for k in range(-20, 21):
            x, y = ret[a], ret[b].shift(-k)
            there = x.notna() & y.notna()
            found[k] = np.corrcoef(x[there], y[there])[0, 1]
        best = max(found, key=lambda k: (round(abs(found[k]), 9), -k))
        assert lag == best and corr == pytest.approx(found[best], abs=2e-6) and leader == (a if lag > 0 else b if lag < 0 else None)


def test_pair_report_takes_all_times_and_lags(spark):
    lags = {(r.a, r.b): r for r in catalog.QUERIES["pair_lags_whole"](spark, SF).collect()}
    fits = {(r.a, r.b): r for r in catalog.QUERIES["pair_spreads_whole"](spark, SF).collect()}
    rows = catalog.QUERIES["pair_report_whole"](spark, SF).orderBy("rank").collect()
    assert len(rows) == len(lags) and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    for r in rows:
        lag, fit = lags[r.a, r.b], fits[r.a, r.b]
        assert (r.lag, r.corr, r.leader, r.beta, r.half_life, r.t) == (lag.lag, lag.corr, lag.leader, fit.beta, fit.half_life, fit.t)
        assert r.score == pytest.approx(abs(r.corr) * max(0, min(1, r.t / -3.34)), abs=1e-5)
        assert r.shortlisted == (abs(r.corr) >= 0.05 and r.t <= -3.34)
    assert all(x.score >= y.score - 2e-6 for x, y in zip(rows, rows[1:], strict=False))
    total = catalog.QUERIES["pair_report_summary_whole"](spark, SF).first()
    assert total.pairs == len(rows) and total.shortlisted == sum(r.shortlisted for r in rows) and total.best_score == rows[0].score


def test_pair_spreads_and_clusters_take_all_times(spark, returns):
    ret, log = returns
    for r in catalog.QUERIES["pair_spreads_whole"](spark, SF).collect():
        there = ret[r.a].notna() & ret[r.b].notna()
        beta, alpha = np.polyfit(log[r.b][there], log[r.a][there], 1)
        assert r.beta == pytest.approx(beta, abs=1e-5) and r.alpha == pytest.approx(alpha, abs=1e-4)
        assert r.n == there.sum() - 1
    corr, root = ret.corr(), {s: s for s in ret.columns}
    for _ in root:
        for a in root:
            root[a] = min(root[b] for b in root if a == b or corr.loc[a, b] > 0.05)
    assert {r.symbol: r.cluster for r in catalog.QUERIES["pair_clusters_whole"](spark, SF).collect()} == root


def test_monte_carlo_has_1000_paths(spark):
    got = {r.sim: r for r in catalog.QUERIES["monte_carlo_whole"](spark, SF).collect()}
    assert set(got) == set(range(1000))
    assert all(got[r.sim] == r for r in catalog.QUERIES["monte_carlo"](spark, SF).collect())
