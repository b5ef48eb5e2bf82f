"""Chained means, matrix and clamp scans, and the filters built on them, against plain loops; plans count their Python passes."""

from __future__ import annotations

import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions.scan import clamp_scan, ewm, matrix_scan, solve_clamps, solve_matrix
from lodestar.operators import backtest, filters, strategy
from lodestar.operators import indicators as ta

DAY = dt.datetime(2024, 1, 1)


def passes(df):
    """Python passes of the plan."""
    return len(re.findall(r"MapIn(?:Pandas|Arrow)|FlatMapGroupsIn", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.fixture(scope="module")
def prices():
    draw = np.random.default_rng(7)
    close = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, 400)))
    high, low = close * (1 + draw.uniform(0, 0.02, 400)), close * (1 - draw.uniform(0, 0.02, 400))
    return pd.DataFrame({"open": close, "high": high, "low": low, "close": close, "volume": draw.integers(1, 100, 400).astype(float)})


@pytest.fixture(scope="module")
def frame(spark, prices):
    rows = [(s, DAY + dt.timedelta(days=i), *map(float, r)) for s in ("A", "B") for i, r in enumerate(prices.itertuples(index=False))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


@pytest.fixture(params=[50, 10_000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def column(df, name):
    got = df.where("symbol = 'B'").orderBy("ts").toPandas()
    return got[name].to_numpy(float)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 500])
def test_solvers_equal_loops(n):
    draw = np.random.default_rng(n)
    a, b = draw.uniform(-0.4, 0.4, (n, 3, 3)), draw.normal(size=(n, 3))
    y, last = solve_matrix(a, b, np.ones(3)), np.ones(3)
    low = draw.normal(size=n)
    high = np.where(draw.random(n) < 0.3, np.inf, low + draw.uniform(-0.5, 2, n))
    low[draw.random(n) < 0.3] = -np.inf
    held, at = solve_clamps(low, high, 0.5), 0.5
    for i in range(n):
        last = a[i] @ last + b[i]
        at = min(max(at, low[i]), high[i])
        assert np.allclose(y[i], last) and held[i] == at


def test_means_chain_in_one_pass(frame, prices, batches):
    df = ewm(frame, [("a", "close", 0.2, 5, "sma"), ("b", "a", 0.2, 5, "sma"), ("d", ("a", "b"), 0.3, 4, "counted")])
    assert passes(df) == 1
    a = pd.Series([np.nan] * 4 + [prices.close[:5].mean(), *prices.close[5:]]).ewm(alpha=0.2, adjust=False).mean()
    b = a.copy()
    b[4:] = a[4:].ewm(alpha=0.2, adjust=False).mean()
    diff = (a - b)[4:]
    d = pd.Series([np.nan] * 7 + [diff[:4].mean(), *diff[4:]]).ewm(alpha=0.3, adjust=False).mean()
    assert np.allclose(column(df, "a"), a, equal_nan=True) and np.allclose(column(df, "b"), b, equal_nan=True) and np.allclose(column(df, "d"), d, equal_nan=True)


def test_plans_do_not_double(frame):
    assert passes(ta.indicators(frame, ["ema", "rma", "dema", "tema"])) <= 4
    assert passes(ta.macd(frame)) == 1 and passes(ta.tema(frame)) == 1 and passes(ta.adx(frame)) == 3


def test_alpha_may_be_a_column(frame, prices):
    df = ewm(frame.withColumns({"al": F.lit(0.25), "n": F.lit(3)}), [("y", "close", "al", "n", "sma")])
    want = pd.Series([np.nan] * 2 + [prices.close[:3].mean(), *prices.close[3:]]).ewm(alpha=0.25, adjust=False).mean()
    assert np.allclose(column(df, "y"), want, equal_nan=True)


def test_matrix_and_clamp_scans_carry_over_batches(frame, prices, batches):
    df = matrix_scan(frame, ["y", "y1"], [[0.5, 0.3], [1.0, 0.0]], [F.col("close"), 0.0])
    df = clamp_scan(df, "z", F.when(F.col("close") > 100, F.col("low")), F.when(F.col("close") <= 100, F.col("high")), start=100.0)
    y, y1, z = 0.0, 0.0, 100.0
    want = []
    for x, lo, hi in zip(prices.close, prices.low, prices.high, strict=True):
        y, y1 = 0.5 * y + 0.3 * y1 + x, y
        z = max(z, lo) if x > 100 else min(z, hi)
        want.append((y, z))
    assert np.allclose(column(df, "y"), [w[0] for w in want]) and np.allclose(column(df, "z"), [w[1] for w in want])


def test_flex(frame, prices):
    x, n = prices.close.to_numpy(), 20
    turn = 2 * 1.414 / n
    a = math.exp(-3.14159 * turn)
    b = 2 * a * math.cos(180 * turn)
    f, power, out = [0.0, 0.0], [0.0, 0.0], []
    for i in range(2, len(x)):
        f.append(0.5 * (a * a - b + 1) * (x[i] + x[i - 1]) + b * f[-1] - a * a * f[-2])
    for i in range(n, len(x)):
        slope = (f[i - n] - f[i]) / n
        sums = [sum(f[i] - f[i - j] + j * s for j in range(1, n)) / n for s in (0.0, slope)]
        power = [0.04 * s * s + 0.96 * p for s, p in zip(sums, power, strict=True)]
        out.append([s / math.sqrt(p) for s, p in zip(sums, power, strict=True)])
    df = filters.flex(frame)
    for k, name in enumerate(("TRENDFLEX_20_20", "REFLEX_20_20")):
        assert np.allclose(column(df, name), [*[np.nan] * n, *(o[k] for o in out)], equal_nan=True)


def test_relative_strength_xtra(frame, prices):
    x, n = prices.close.to_numpy(), 14
    w = 3 / (n + 2)
    want, state = [np.nan] * (n - 1) + [50.0], {1: [0.0] * 6, 2: [0.0] * 6}
    for i in range(n, len(x)):
        step, outs = (100 * (x[i] - x[i - 1]) if i > n else 0.0), []
        for key, v in ((1, step), (2, abs(step))):
            s = state[key]
            for k in (0, 2, 4):
                s[k] = (1 - w) * s[k] + w * v
                s[k + 1] = (1 - w) * s[k + 1] + w * s[k]
                v = 1.5 * s[k] - 0.5 * s[k + 1]
            outs.append(v)
        want.append(min(100.0, max(0.0, (outs[0] / outs[1] + 1) * 50)) if i >= 2 * n - 1 and outs[1] > 1e-10 else 50.0)
    assert np.allclose(column(filters.relative_strength_xtra(frame), f"RSX_{n}"), want, equal_nan=True)


def test_ratchets(frame, prices):
    stop = filters.range_stop(frame)
    cols = ta.ewm(ta.true_range(frame, "tr"), [("a", "tr", 1 / 14, 14, "counted"), ("e", "close", 2 / 21, 20, "sma")])
    a, e, x = 3 * column(cols, "a"), column(cols, "e"), prices.close.to_numpy()
    want = [np.nan] * 20
    for i in range(20, 400):
        before = want[-1]
        want.append(x[i] - a[i] if x[i] > e[i] else x[i] + a[i])
        if before == before:
            want[-1] = max(want[-1], before) if x[i] > e[i] else min(want[-1], before)
    assert np.allclose(column(stop, "ATRTS_14_20"), want, equal_nan=True)
    for kind, momentum in (("rsi", ta.rsi(frame, 14)), ("mfi", ta.mfi(frame, 14))):
        got = column(filters.alpha_trend(frame, momentum=kind), "ALPHAT_14")
        mo, width = column(momentum, f"{kind.upper()}_14"), pd.Series(column(ta.true_range(frame, "tr"), "tr")).rolling(14).mean().to_numpy()
        line, want = None, []
        for m, w, lo, hi in zip(mo, width, prices.low, prices.high, strict=True):
            if w == w:
                up = m >= 50
                bound = lo - w if up else hi + w
                line = bound if line is None else max(line, bound) if up else min(line, bound)
            want.append(np.nan if line is None else line)
        assert np.allclose(got, want, equal_nan=True)


def test_even_better_sine(frame, prices):
    x, n, bars = prices.close.to_numpy(), 40, 10
    keep = (1 - math.sin(2 * math.pi / n)) / math.cos(2 * math.pi / n)
    a = math.exp(-math.sqrt(2) * math.pi / bars)
    b2, b3 = 2 * a * math.cos(math.sqrt(2) * math.pi / bars), -a * a
    high, before, f, want = 0.0, 0.0, [0.0, 0.0, 0.0], [np.nan] * (n - 1) + [0.0]
    for i in range(n, len(x)):
        now = 0.5 * (1 + keep) * (x[i] - before) + keep * high
        f = [f[1], f[2], 0.5 * (1 - b2 - b3) * (now + high) + b2 * f[2] + b3 * f[1]]
        high, before = now, x[i]
        want.append(np.mean(f) / math.sqrt(np.mean(np.square(f))))
    assert np.allclose(column(filters.even_better_sine(frame), "EBSW_40_10"), want, equal_nan=True)


def test_schaff_cycle(frame, prices):
    macd = column(ta.macd(frame), "MACD_12_26_9")
    low, high = (getattr(pd.Series(macd).rolling(10), f)().to_numpy() for f in ("min", "max"))
    k, p, y = 0.0, [0.0], [0.0]
    for i in range(1, 400):
        if low[i] > 0:
            k = 100 * (macd[i] - low[i]) / (high[i] - low[i] or 2.220446049250313e-16)
        p.append(round(p[-1] + 0.5 * (k - p[-1]), 8))
        near = p[max(0, i - 9) :]
        q = 100 * (p[-1] - min(near)) / (max(near) - min(near)) if max(near) > min(near) else 0.0
        y.append(round(y[-1] + 0.5 * (q - y[-1]), 8))
    got = filters.schaff_cycle(frame)
    assert np.allclose(column(got, "STCstoch_10_12_26")[25:], p[25:], atol=1e-6) and np.allclose(column(got, "STC_10_12_26")[25:], y[25:], atol=1e-3)


def test_adaptive_states_follow_the_price(frame, prices, batches):
    """A straight line is followed at its end, steps are approached, and first values are those stated."""
    mama = column(filters.mesa_average(frame), "MAMA")
    trend, jma = column(filters.instant_trend(frame), "HT_TL"), column(filters.adaptive_average(frame), "JMA_7")
    x = prices.close.to_numpy()
    assert np.isnan(mama[:3]).all() and np.allclose(trend[:13], x[:13]) and np.isnan(jma[:6]).all()
    for got in (mama, trend, jma):
        there = got[100:]
        assert np.isfinite(there).all() and np.abs(there / x[100:] - 1).max() < 0.5 and np.corrcoef(there, x[100:])[0, 1] > 0.8


def test_grid_of_means_equals_single_points_and_plans_in_one_pass(frame):
    points = backtest.grid(strategy.default_grid("ema_cross"))
    df = strategy.ema_cross_grid(frame, points)
    got = {k: g.signal.tolist() for k, g in df.where("symbol = 'B'").orderBy("param_id", "ts").toPandas().groupby("param_id")}
    for k, point in enumerate(points):
        assert got[k] == column(strategy.ema_cross(frame, **point), "signal").tolist()
    many = backtest.grid({"fast": list(range(2, 27)), "slow": list(range(30, 130, 5))})
    assert len(many) == 500 and passes(backtest.grid_returns(frame, "ema", many)) == 1


def plain_candidates(high, low, side):
    out = []
    for i in range(side, len(high) - side - 1):
        frame = slice(i - side, i + side + 1)
        out += [(i, -1, low[i])] * bool((low[i] <= low[frame]).all()) + [(i, 1, high[i])] * bool((high[i] >= high[frame]).all())
    return out


def plain_backwards(found, deviation):
    """Points ``[bar, swing, value, change]`` from the last to the first."""
    points = [[*found[-1], 0.0]]
    for i, swing, value in reversed(found[:-1]):
        at, kind, held, _ = points[-1]
        if swing == kind:
            if len(points) > 2 and swing * (value - held) > 0:
                points[-1] = [i, swing, value, 0.0]
                points[-2][3] = 100 * abs(points[-2][2] - value) / value
        else:
            move = 100 * kind * (held - value) / value
            if move > deviation and at != i:
                points[-1][3] = move
                points.append([i, swing, value, 0.0])
    return points


@pytest.mark.parametrize(("legs", "deviation"), [(10, 5.0), (4, 1.0), (2, 0.1), (30, 20.0)])
def test_zigzag_backwards_equals_a_loop(frame, prices, legs, deviation):
    want = plain_backwards(plain_candidates(prices.high.to_numpy(), prices.low.to_numpy(), legs // 2), deviation)
    got = filters.swing_points(frame, legs, deviation, look_ahead=True).orderBy("symbol", F.desc("ts")).collect()
    for symbol in ("A", "B"):
        rows = [((r.ts - DAY).days, r.swing, r.value, r.change) for r in got if r.symbol == symbol]
        assert [r[:2] for r in rows] == [tuple(w[:2]) for w in want]
        assert np.allclose([r[2:] for r in rows], [w[2:] for w in want])
    bars = filters.zigzag(frame, legs, deviation, look_ahead=True).where(f"`ZIGZAGs_{deviation:g}_{legs}` is not null")
    assert bars.count() == 2 * len({w[0] for w in want})


def test_zigzag_without_look_ahead_knows_only_the_past(spark, frame):
    whole = filters.zigzag(frame, 4, 2.0)
    assert whole.count() == 800
    cut = DAY + dt.timedelta(days=200)
    rows = lambda df: df.where(F.col("ts") < cut - dt.timedelta(days=3)).orderBy("symbol", "ts").collect()
    early = filters.zigzag(frame.where(F.col("ts") < cut), 4, 2.0)
    assert rows(early) == rows(whole) and early.where("ZIGZAGs_2_4 is not null").count() > 10
    points = filters.swing_points(frame.where("symbol = 'A'"), 4, 2.0).orderBy("ts").collect()
    for a, b in zip(points, points[1:], strict=False):
        assert b.swing == -a.swing and abs(b.value / a.value - 1) > 0.02 or b.swing == a.swing and b.swing * (b.value - a.value) > 0
        assert b.known_ts - b.ts == dt.timedelta(days=2)


def test_zigzag_of_few_null_and_level_bars(spark):
    kind = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    rows = [("few", DAY + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(3)] + [("level", DAY + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(30)]
    rows += [("null", DAY + dt.timedelta(days=i), 1.0, None if i % 3 else 2.0 + i, 1.0, 1.0, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, kind)
    for ahead in (False, True):
        points = filters.swing_points(df, 10, 5.0, ahead).collect()
        assert [(p.symbol, p.change) for p in points] == [("level", 0.0)]
        assert filters.zigzag(df.limit(0), look_ahead=ahead).count() == 0
