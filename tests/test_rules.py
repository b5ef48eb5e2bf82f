"""Rule strategies that SQL doesn't express, against plain loops over the same bars."""

from __future__ import annotations

import datetime as dt
import os
import random

import numpy as np
import pandas as pd

from lodestar.operators import strategy as st
from lodestar.plans import rules
from lodestar.sources.bridge import bars

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def by_symbol(df):
    rows = df.toPandas().sort_values(["symbol", "ts"])
    return {s: g.reset_index(drop=True) for s, g in rows.groupby("symbol")}


def news_loop(g, take=35.0, stop=25.0):
    """One symbol's positions, bar by bar, for news at 8:30 with a step of 1."""
    out, side, setup, target, guard = [], 0, None, 0.0, 0.0
    for k, r in g.iterrows():
        if k == 0:
            out.append(0)
            continue
        if setup and r.ts.day != setup["day"]:
            setup = None
        if (r.ts.hour, r.ts.minute) == (8, 30):
            setup = {"day": r.ts.day, "high": r.high, "low": r.low, "green": r.close > r.open}
        elif side == 1:
            side = 0 if r.high >= target or r.low <= guard else 1
        elif side == -1:
            side = 0 if r.low <= target or r.high >= guard else -1
        elif setup and r.ts.hour <= 9:
            if setup["green"] and r.high >= setup["high"]:
                side, target, guard = 1, setup["high"] + take, setup["high"] - stop
            elif not setup["green"] and r.low <= setup["low"]:
                side, target, guard = -1, setup["low"] - take, setup["low"] + stop
        out.append(side)
    return out


def test_news_breakout_equals_a_loop(spark):
    half = rules._half_hours(spark, SF)
    got, given = by_symbol(st.news_breakout(half)), by_symbol(half)
    assert {s: g.signal.tolist() for s, g in got.items()} == {s: news_loop(g) for s, g in given.items()}
    assert {x for g in got.values() for x in g.signal} == {-1, 0, 1} or {x for g in got.values() for x in g.signal} >= {0}


def test_news_breakout_enters_and_leaves(spark):
    at = pd.Timestamp("2024-01-02 08:00")
    prices = [(10, 10, 10, 10), (10, 12, 9, 11), (11, 13, 11, 12), (12, 60, 12, 50), (50, 50, 50, 50)]
    rows = [("A", (at + pd.Timedelta(minutes=30 * k)).to_pydatetime(), *map(float, p)) for k, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double")
    assert [r.signal for r in st.news_breakout(df).orderBy("ts").collect()] == [0, 0, 1, 0, 0]


def test_energy_states_equal_numpy(spark):
    given = by_symbol(bars(spark, SF))
    got = by_symbol(st.energy_states(bars(spark, SF)))
    seen = set()
    for s, g in given.items():
        change = g.close.diff()
        speed = change.copy()
        speed.iloc[:4], speed.iloc[4] = np.nan, change.iloc[:5].mean()
        speed = speed.ewm(span=5, adjust=False).mean()
        energy = 0.5 * g.volume / g.volume.rolling(20).mean() * speed**2
        ret = g.close.pct_change().fillna(0.0)

        def less(p):
            p = p[p > 0]
            return -(p * np.log2(p)).sum()

        def patterns(x):
            up = np.mean(np.diff(x) > 0)
            return less(np.array([up, 1 - up]))

        low = (ret.rolling(5).apply(patterns, raw=True) < 0.7).astype(int)
        for n, bins, at in ((7, 5, 1.1), (14, 10, 1.4)):
            low += (ret.rolling(n).apply(lambda x, bins=bins: less(np.histogram(x, bins=bins, density=True)[0] / bins), raw=True) < at).astype(int)  # noqa: PD901
        ordered = low >= 2
        force = -np.where(ordered, 2.0, 0.5) * (g.close - g.close.rolling(20).mean()) - 0.1 * speed
        mine = got[s]
        assert np.allclose(mine.energy.astype(float), energy, equal_nan=True, rtol=1e-8)
        assert (mine.state == np.where(ordered, "ordered", "disordered")).mean() > 0.999  # a bin's edge may fall either way
        same = mine.state == np.where(ordered, "ordered", "disordered")
        assert np.allclose(mine.force.astype(float)[same], force[same], equal_nan=True, rtol=1e-8)
        assert (mine.breakout[same] == (ordered & (energy > 1.5 * energy.rolling(20).mean()))[same]).all()
        assert (mine.reversion[same] == (~ordered & (np.abs(force) > 2 * g.close.std()))[same]).all()
        seen |= set(mine.state)
    assert seen == {"ordered", "disordered"}


def test_cluster_reversion_equals_pandas(spark):
    df = bars(spark, SF)
    wide = df.toPandas().pivot(index="ts", columns="symbol", values="close").sort_index()
    corr = wide.ffill().pct_change().corr()
    limit = 0.01
    groups = {s: s for s in corr}
    for _ in corr:
        for a in corr:
            for b in corr:
                if a != b and corr.loc[a, b] > limit:
                    groups[a] = groups[b] = min(groups[a], groups[b])
    counts = pd.Series(groups).value_counts()
    best = min(counts[counts == counts.max()].index)
    got = by_symbol(st.cluster_reversion(df, threshold=limit))
    given = by_symbol(df)
    assert 1 < sum(v == best for v in groups.values())
    for s, g in given.items():
        z = -(g.close - g.close.rolling(20).mean()) / g.close.rolling(20).std()
        if groups[s] != best:
            assert got[s].z.isna().all() and (got[s].signal == 0).all()
            continue
        entry = pd.Series(np.select([z > 2, z < -2], [1.0, -1.0], np.nan)).ffill().fillna(0)
        assert np.allclose(got[s].z.astype(float), z, equal_nan=True, rtol=1e-6)
        assert (got[s].signal == entry).all()


def test_every_strategy_has_a_grid_that_it_takes():
    import inspect

    assert set(st.GRIDS) == set(st.STRATEGIES) and set(st.ALIASES.values()) <= set(st.STRATEGIES)
    for name, grid in st.GRIDS.items():
        assert set(grid) <= set(inspect.signature(st.STRATEGIES[name]).parameters)
    assert st.default_grid("nr7") == st.GRIDS["narrow_breakout"]


def test_signals_take_other_names(spark):
    rows = bars(spark, SF)
    assert sorted(st.signals(rows, "nr7").select("symbol", "ts", "signal").collect()) == sorted(st.signals(rows, "narrow_breakout").select("symbol", "ts", "signal").collect())


def plain_strength(values, length):
    up = down = 0.0
    out, first = [0.0], True
    for k in range(1, len(values)):
        move = values[k] - values[k - 1]
        u, d = max(move, 0.0), max(-move, 0.0)
        up, down = (u, d) if first else (up + (u - up) / length, down + (d - down) / length)
        first = False
        out.append(round(100 * up / (up + down), 9) if k >= length and up + down else 0.0)
    return out


def plain_stop(tops, bottoms):
    """The line, with rising and falling written apart."""
    out, rising, extreme, line, pace = [0.0], True, tops[0], bottoms[0], 0.02
    for k in range(1, len(tops)):
        line += pace * (extreme - line)
        last = slice(max(0, k - 2), k)
        if rising and line > bottoms[k]:
            rising, line, extreme, pace = False, max(tops[k], extreme), bottoms[k], 0.02
        elif rising:
            if tops[k] > extreme:
                extreme, pace = tops[k], min(pace + 0.02, 0.2)
            line = min([line, *bottoms[last]])
        elif line < tops[k]:
            rising, line, extreme, pace = True, min(bottoms[k], extreme), tops[k], 0.02
        else:
            if bottoms[k] < extreme:
                extreme, pace = bottoms[k], min(pace + 0.02, 0.2)
            line = max([line, *tops[last]])
        out.append(line)
    return out


def plain_mean(values, n):
    """Exponential mean; row n holds the mean of the values there are among the first n."""
    out, y = [], None
    for k, x in enumerate(values):
        if k == n - 1:
            there = [v for v in values[:n] if v is not None]
            y = sum(there) / len(there)
        elif k >= n:
            y += 2 / (n + 1) * (x - y)
        out.append(y)
    return out


def test_frame_kinematics_equals_a_loop(spark):
    zero, draw, price, low = dt.datetime(2024, 1, 1), random.Random(12), 100.0, []
    for k in range(1500):
        close = price * (1 + draw.gauss(0, 0.01))
        low.append((zero + dt.timedelta(minutes=10 * k), price, max(price, close) * 1.002, min(price, close) * 0.998, close))
        price = close
    mid = [(low[k][0], low[k][1], max(r[2] for r in low[k : k + 6]), min(r[3] for r in low[k : k + 6]), low[k + 5][4]) for k in range(0, 1500, 6)]
    coarse = [(zero + dt.timedelta(days=d), draw.choice([1, 1, -1, -1, 0, None])) for d in range(1, 11)]

    closes = [m[4] for m in mid]
    stop = plain_stop(plain_strength([m[2] for m in mid], 14), plain_strength([m[3] for m in mid], 14))
    moves = [None, *(b - a for a, b in zip(closes, closes[1:], strict=False))]
    speed, strength = plain_mean(moves, 5), plain_mean(plain_strength(closes, 14), 5)
    states, state, before = [], 0, (True, True)
    for k, m in enumerate(mid):
        push = speed[k] - speed[k - 1] if k and speed[k - 1] is not None else None
        now = (push is not None and speed[k] > 0 and push > 0 and strength[k] > stop[k], push is not None and speed[k] < 0 and push < 0 and strength[k] < stop[k])
        end = m[0] + dt.timedelta(hours=1)
        regime = ([r for at, r in coarse if at <= end] or [0])[-1] or 0
        if regime == 0:
            state = 0
        elif now[regime < 0] and not before[regime < 0]:
            state = regime
        states.append((end, state))
        before = now
    want, held = [], 0
    for r in low:
        want.append(held)
        end = r[0] + dt.timedelta(minutes=10)
        held = ([s for at, s in states if at <= end] or [0])[-1]
    assert {-1, 0, 1} == set(want)

    kind = "symbol string, ts timestamp, open double, high double, low double, close double"
    frames = [spark.createDataFrame([(s, *r) for s in ("A", "B") for r in rows], kind) for rows in (low, mid)]
    regimes = spark.createDataFrame([("A", *r) for r in coarse], "symbol string, ts timestamp, regime int")
    line = [r.SAR_RSI for r in st.strength_stop(frames[1].where("symbol = 'A'")).orderBy("ts").collect()]
    assert max(abs(x - y) for x, y in zip(line, stop, strict=True)) < 1e-9
    got = st.frame_kinematics(*frames, regimes, 3600, 600)
    assert got.columns == [*frames[0].columns, "signal"]
    rows = got.orderBy("symbol", "ts").collect()
    assert [r.signal for r in rows if r.symbol == "A"] == want and [r.ts for r in rows if r.symbol == "A"] == [r[0] for r in low]
    assert {r.signal for r in rows if r.symbol == "B"} == {0}  # no regime
    assert st.frame_kinematics(frames[0].limit(0), frames[1].limit(0), regimes, 3600, 600).count() == 0
