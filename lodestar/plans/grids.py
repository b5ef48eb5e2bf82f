"""Queries of parameter searches over strategies on recurrences, and their SQL."""

from __future__ import annotations

from lodestar.operators import backtest as b
from lodestar.operators import strategy as st
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _W, _recursive
from lodestar.plans.strategies import _CROSS, _grid_sql, _held
from lodestar.plans.strategies import ORACLE_SQL as _SQL
from lodestar.sources.bridge import BARS_SQL, bars

_EMA, _MACD, _RSI, _TREND = (b.grid(st.default_grid(name)) for name in ("ema_cross", "macd_trend", "rsi_reversal", "supertrend_direction"))

QUERIES = {
    "grid_search_macd_trend": lambda s, d: rounded(b.grid_search(bars(s, d), "macd_trend", _MACD)),
    "grid_search_rsi_reversal": lambda s, d: rounded(b.grid_search(bars(s, d), "rsi_reversal", _RSI)),
    "grid_search_supertrend": lambda s, d: rounded(b.grid_search(bars(s, d), "supertrend_direction", _TREND)),
    "walk_forward_macd": lambda s, d: rounded(b.walk_forward(bars(s, d), "macd_trend", _MACD, digits=9)),
    "walk_forward_rsi": lambda s, d: rounded(b.walk_forward(bars(s, d), "rsi_reversal", _RSI, digits=9)),
}

_START = f"WITH RECURSIVE {BARS_SQL}"


def _points(source: str, points: list[dict], picks: dict[str, dict]) -> str:
    """CTE ``pt``: a row of ``source`` for each point, ``symbol`` prefixed by its number; ``picks``: name to an expression of each point's values."""
    rows = " UNION ALL ".join(f"SELECT {k} AS param_id, {k}::VARCHAR || ':' || symbol AS symbol, symbol AS plain, ts, open, high, low, close, {', '.join(f'{make(p)} AS {name}' for name, make in picks.items())} FROM {source}" for k, p in enumerate(points))
    return f"pt AS MATERIALIZED ({rows})"


def _returns(signals: str) -> str:
    """From the signals ``sig`` of all points to the returns ``port``, as for the searches over windows."""
    tail = _grid_sql()
    return f"{signals}, al AS (SELECT param_id, plain AS symbol, ts, close, signal::DOUBLE AS size FROM sig){tail[tail.index(',' + chr(10) + 'p AS ('):]}"


def _means(lengths: set[int]) -> str:
    return _recursive(_START, "bars", [(f"e{n}", "close", 2 / (n + 1), n, "sma") for n in sorted(lengths)], "a")


def _ema() -> str:
    picks = {"f": lambda p: f"e{p['fast']}", "s": lambda p: f"e{p['slow']}"}
    return _returns(f"{_means({n for p in _EMA for n in p.values()})}, {_points('a', _EMA, picks)}, {_held('pt', 'f > s', 'f < s')}")


def _macd() -> str:
    lines = f"{_means({n for p in _MACD for n in (p['fast'], p['slow'])})}, {_points('a', _MACD, {'line': lambda p: f'e{p["fast"]} - e{p["slow"]}'})}"
    # the signal line starts with the mean of the first nine differences
    seeded = """, b AS (SELECT *, count(line) OVER u AS n_, avg(line) OVER u AS a_ FROM pt WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b2 AS (SELECT * EXCLUDE (n_, a_), CASE WHEN n_ = 9 THEN a_ WHEN n_ > 9 THEN line END AS x FROM b)"""
    sides = _held("d2", "line > 0 AND line > sg AND m1 <= s1", "line < 0 AND line < sg AND m1 >= s1", "line * m1 < 0")
    return _returns(f"{_recursive(lines + seeded, 'b2', [('sg', 'x', 0.2, 1, 'first')], 'md')}, d2 AS (SELECT *, lag(line) OVER w AS m1, lag(sg) OVER w AS s1 FROM md {_W}), {sides}")


def _rsi() -> str:
    moves = f"{_START}, g AS (SELECT *, close - lag(close) OVER w AS d FROM bars {_W}), h AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS dn FROM g)"
    means = _recursive(moves, "h", [(f"r{x}{n}", y, 1 / n, n, "first") for n in sorted({p["length"] for p in _RSI}) for x, y in (("u", "up"), ("d", "dn"))], "a")
    picks = {"x": lambda p: "100 * ru{0} / nullif(ru{0} + rd{0}, 0)".format(p["length"]), "lo": lambda p: f"{p['lower']!r}::DOUBLE", "hi": lambda p: f"{p['upper']!r}::DOUBLE"}
    return _returns(f"{means}, {_points('a', _RSI, picks)}, a3 AS (SELECT *, lag(x) OVER w AS x1 FROM pt {_W}), {_held('a3', 'x < lo', 'x > hi', _CROSS('x', 'x1', 50))}")


def _trend() -> str:
    """Mean true ranges of all lengths in one recursion, then the bands of all points in another."""
    lengths = sorted({p["length"] for p in _TREND})
    seeds = ", ".join(f"CASE WHEN c_ = {n} THEN avg(tr) OVER u WHEN c_ > {n} THEN tr END AS x{n}" for n in lengths)
    ranges = f"""{_START}, t1 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS t_, lag(close) OVER w AS b_ FROM bars {_W}),
t2 AS (SELECT *, CASE WHEN b_ IS NOT NULL THEN t_ END AS tr FROM t1), t3 AS (SELECT *, count(tr) OVER u AS c_ FROM t2 WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t4 AS (SELECT *, {seeds} FROM t3 WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    means = _recursive(ranges, "t4", [(f"w{n}", f"x{n}", 1 / n, 1, "first") for n in lengths], "a")
    bands = """n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM pt WHERE span IS NOT NULL),
r AS (
  SELECT symbol, i, mid - span AS lo, mid + span AS up, 1 AS side FROM n WHERE i = 1
  UNION ALL
  SELECT symbol, i, CASE WHEN kept AND side > 0 THEN greatest(lo, plo) ELSE lo END, CASE WHEN kept AND side < 0 THEN least(up, pup) ELSE up END, side
  FROM (SELECT n.symbol, n.i, n.mid - n.span AS lo, n.mid + n.span AS up, r.lo AS plo, r.up AS pup, CASE WHEN n.close > r.up THEN 1 WHEN n.close < r.lo THEN -1 ELSE r.side END AS side, n.close BETWEEN r.lo AND r.up AS kept
        FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)),
sig AS (SELECT pt.*, coalesce(s.side, 0) AS signal FROM pt LEFT JOIN (SELECT n.symbol, n.ts, r.side FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i) s ON s.symbol = pt.symbol AND s.ts = pt.ts)"""
    return _returns(f"{means}, {_points('a', _TREND, {'mid': lambda p: '(high + low) / 2', 'span': lambda p: f'{p["multiplier"]!r}::DOUBLE * w{p["length"]}'})}, {bands}")


def _like(query: str, returns: str) -> str:
    """The SQL of a search over windows with other returns; points that trade alike tie."""
    return _SQL[query].replace(_grid_sql(), returns).replace("ORDER BY sh DESC", "ORDER BY round(sh, 9) DESC")


ORACLE_SQL = {
    "grid_search_ema_cross": _like("grid_search", _ema()),
    "grid_search_macd_trend": _like("grid_search", _macd()),
    "grid_search_rsi_reversal": _like("grid_search", _rsi()),
    "grid_search_supertrend": _like("grid_search", _trend()),
    "walk_forward_macd": _like("walk_forward", _macd()),
    "walk_forward_rsi": _like("walk_forward", _rsi()),
}
