"""Queries of the filters with memory, and of a parameter search over exponential means."""

from __future__ import annotations

from lodestar.operators import backtest, strategy
from lodestar.operators.filters import FILTERS
from lodestar.plans.common import rounded
from lodestar.sources.bridge import bars

_OHLCV = ("open", "high", "low", "close", "volume")

#: Matrix scans, clamp scans and states; held against plain loops in the tests.
QUERIES = {f"ta_{name}": (lambda s, d, f=f: rounded(f(bars(s, d)).drop(*_OHLCV), 4)) for name, f in FILTERS.items()}
QUERIES["grid_search_ema_cross"] = lambda s, d: rounded(backtest.grid_search(bars(s, d), "ema_cross", backtest.grid(strategy.default_grid("ema_cross"))))

ORACLE_SQL: dict[str, str] = {}
