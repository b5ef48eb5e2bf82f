"""Whole grids of strategies on recurrences against their single points, and the passes that they plan."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from lodestar.operators import backtest, strategy
from lodestar.operators.grids import GRID_FORMS
from lodestar.sources.bridge import bars
from tests.test_scan import frame, passes, prices  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Grids that reach every parameter of a form.
WIDE = {
    "macd_trend": {"fast": [3, 8], "slow": [12, 26], "signal": [4, 9], "exit_mode": ["row", "hold"]},
    "macd_reversal": {"fast": [3, 8], "slow": [12], "signal": [9], "middle": [0.0, 0.2], "exit_mode": ["hold", "row"]},
    "rsi_reversal": {"length": [5, 14], "lower": [30.0, 45.0], "upper": [60.0], "middle": [50.0, 55.0], "exit_mode": ["row", "hold"]},
    "bouncy_ball": {"slow": [30, 60], "fast": [5], "length": [4, 14], "oversold": [60.0], "zone": [0.02, 0.05], "exit_mode": ["row", "hold"]},
    "supertrend_direction": {"length": [3, 7, 10], "multiplier": [1.0, 3.0]},
    "squeeze_breakout": {"length": [10, 20], "bands": [0.5, 1.0], "channel": [1.5, 3.0], "follow": [True, False], "exit_mode": ["row", "hold"]},
    "markov_trend": {"lookback": [3, 14], "threshold": [0.3, 0.5], "history": [10, 33], "length": [7, 14]},
    "markov_cross": {"lookback": [3], "threshold": [0.3], "history": [10, 33], "length": [14], "longs": [True, False], "shorts": [True, False]},
}


@pytest.mark.parametrize("name", sorted(GRID_FORMS))
def test_grid_equals_its_points(frame, name):  # noqa: F811
    bars = frame.where("symbol = 'B' or ts < '2024-06-01'").selectExpr("symbol", "ts", "(high + low) / 2 AS open", "high", "low", "close", "volume", "1 AS mark")
    points = backtest.grid(WIDE.get(name, strategy.default_grid(name)))
    rows = GRID_FORMS[name](bars, points).toPandas().sort_values("ts")
    assert sorted(rows.param_id.unique()) == list(range(len(points)))
    got = {key: g.signal.tolist() for key, g in rows.groupby(["param_id", "symbol"])}
    some = set()
    for k in {0, len(points) // 2, len(points) - 1, *range(0, len(points), 5)}:
        one = strategy.signals(bars, name, **points[k])
        assert "mark" in one.columns and not [x for x in one.columns if x.startswith("_")]
        for symbol, g in one.toPandas().sort_values("ts").groupby("symbol"):
            assert got[k, symbol] == g.signal.tolist(), (points[k], symbol)
            some.update(g.signal)
    assert len(some) > 1


@pytest.mark.parametrize("name", sorted(GRID_FORMS))
def test_default_grids_plan_in_two_passes(frame, name):  # noqa: F811
    assert passes(backtest.grid_returns(frame, name, backtest.grid(strategy.default_grid(name)))) <= 2


def test_500_points_plan_in_two_passes(frame):  # noqa: F811
    many = backtest.grid({"length": list(range(5, 25)), "lower": [20.0, 25.0, 30.0, 35.0, 40.0], "upper": [60.0, 65.0, 70.0, 75.0, 80.0]})
    assert len(many) == 500 and passes(backtest.grid_returns(frame, "rsi", many)) == 1
    many = backtest.grid({"length": list(range(5, 30)), "multiplier": [1 + k / 4 for k in range(20)]})
    assert len(many) == 500 and passes(backtest.grid_returns(frame, "supertrend", many)) == 2


def test_grids_refuse_unknown_parameters_and_take_defaults(frame):  # noqa: F811
    with pytest.raises(TypeError):
        GRID_FORMS["macd_trend"](frame, [{"fsat": 3}])
    rows = GRID_FORMS["rsi_reversal"](frame, [{}, {"length": 5}]).where("symbol = 'A'").toPandas().sort_values("ts")
    assert rows[rows.param_id == 0].signal.tolist() == strategy.rsi_reversal(frame.where("symbol = 'A'")).toPandas().sort_values("ts").signal.tolist()


def test_walk_forward_takes_the_greater_ratio_and_the_first_of_equal_ones(spark):
    # one rise; the shorter exit leaves a day before a move of 1.5e-10, which is its whole lead
    level = lambda k: 2.0 if k < 86 else 3.0 if k < 96 else 2.5 if k == 96 else 1.0
    prices = [100.0 + k % 2 if k < 60 else 103.0 if k == 60 else 110.0 * (1 + 1e-10 * level(k)) for k in range(330)]
    days = pd.date_range("2024-01-01", periods=len(prices))
    one = spark.createDataFrame([("A", t.to_pydatetime(), p, p, p, p, 1.0) for t, p in zip(days, prices, strict=True)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    points = [{"entry": 55, "leave": 20}, {"entry": 55, "leave": 10}, {"entry": 55, "leave": 10}]
    got = backtest.walk_forward(one, "turtle", points).orderBy("window").collect()
    assert [r.param_id for r in got] == [1, 1]
    stitched = backtest.walk_forward_returns(one, "turtle", points).collect()
    assert {(r.window, r.param_id) for r in stitched} == {(0, 1), (1, 1)}
    assert backtest.walk_forward(one, "turtle", points, digits=9).where("window = 0").first().param_id == 0
    many = backtest.walk_forward(bars(spark, SF), "turtle", points[1:] * 3).collect()
    assert len(many) > 1 and {r.param_id for r in many} == {0}  # sums of many symbols, the same to the last digit
    for r in got:
        train = backtest.portfolio(backtest.grid_returns(one, "turtle", points[1:2])).orderBy("ts").toPandas().ret[r.window * 63 : r.window * 63 + 252]
        assert r.train_sharpe == pytest.approx(train.mean() / train.std(), rel=1e-9)
