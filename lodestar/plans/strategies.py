"""Queries of strategies, backtests and searches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import backtest as b
from lodestar.operators import strategy as st
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _W, _atr, _lag, _recursive, _roll
from lodestar.sources.bridge import BARS_SQL, bars

_KEEP = ("symbol", "ts", "signal")


def _signals(name: str, **params):
    return lambda s, d: st.signals(bars(s, d), name, **params).select("symbol", "ts", F.col("signal").cast("int").alias("signal"))


def _run(s, d):
    return b.run(b.size(st.turtle(bars(s, d)), "volatility"))


def _net(s, d):
    return b.portfolio(_run(s, d))


_POINTS = b.grid(st.GRIDS["turtle"])

QUERIES = {
    "signal_ema_cross": _signals("ema_cross"),
    "signal_macd_trend": _signals("macd_trend"),
    "signal_bollinger": _signals("bollinger_reversion"),
    "signal_bollinger_hold": _signals("bollinger_reversion", exit_mode="hold"),
    "signal_rsi": _signals("rsi_reversal"),
    "signal_zscore": _signals("zscore_arb"),
    "signal_washer": _signals("washer"),
    "signal_turtle": _signals("turtle"),
    "signal_channel": _signals("channel_breakout"),
    "signal_narrow_range": _signals("narrow_breakout"),
    "signal_swing": _signals("swing_reversal"),
    "signal_supertrend": _signals("supertrend_direction"),
    "signal_pairs": lambda s, d: rounded(st.pairs_trading(bars(s, d), "S00", "S01")),
    "signal_regime": lambda s, d: st.regime_follower(bars(s, d), "S00").select(*_KEEP),
    "backtest_returns": lambda s, d: rounded(_run(s, d).select("symbol", "ts", "size", "position", "gross", "traded", "net")),
    "backtest_kelly": lambda s, d: rounded(b.size(st.turtle(bars(s, d)), "kelly").select("symbol", "ts", "size")),
    "backtest_metrics": lambda s, d: rounded(b.metrics(_run(s, d))),
    "backtest_portfolio": lambda s, d: rounded(_net(s, d)),
    "backtest_risk": lambda s, d: rounded(b.risk(_net(s, d))),
    "backtest_trades": lambda s, d: rounded(b.trades(_run(s, d))),
    "backtest_trade_metrics": lambda s, d: rounded(b.trade_metrics(_run(s, d))),
    "backtest_transactions": lambda s, d: rounded(b.transactions(b.run(b.size(st.turtle(bars(s, d))))), 4),
    "backtest_round_trips": lambda s, d: rounded(b.round_trips(b.transactions(b.run(b.size(st.turtle(bars(s, d))))).select("symbol", "ts", "quantity", "price")), 4),
    "backtest_stop_loss": lambda s, d: b.stop_loss(st.turtle(bars(s, d), exit_mode="hold")).select(*_KEEP),
    "backtest_latest": lambda s, d: rounded(b.latest_signals(st.turtle(bars(s, d)))),
    "backtest_monthly": lambda s, d: rounded(b.monthly_table(_net(s, d))),
    "grid_search": lambda s, d: rounded(b.grid_search(bars(s, d), "turtle", _POINTS)),
    "walk_forward": lambda s, d: rounded(b.walk_forward(bars(s, d), "turtle", _POINTS)),
    "monte_carlo": lambda s, d: rounded(b.monte_carlo(_net(s, d))),
    "monte_carlo_whole": lambda s, d: rounded(b.monte_carlo(_net(s, d), 1000)),
    "weights_inverse_volatility": lambda s, d: rounded(b.inverse_volatility(bars(s, d))),
    "regime_ar": lambda s, d: rounded(b.ar_regime(bars(s, d)), 4),
}

_FIRST = f"WITH {BARS_SQL}"


def _held(source: str, long: str, short: str, leave: str | None = None, mode: str = "row", out: str = "sig") -> str:
    """CTEs that end in ``out`` with the signal of ``source``."""
    sql = f"""e0 AS (SELECT *, CASE WHEN {short} THEN -1 WHEN {long} THEN 1 END AS entry_ FROM {source}),
e1 AS (SELECT *, coalesce(last_value(entry_ IGNORE NULLS) OVER u, 0) AS side FROM e0 WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    if leave is None:
        return f"{sql}, {out} AS (SELECT *, side AS signal FROM e1)"
    gone = f"(side <> 0 AND coalesce({leave}, false))"
    if mode == "row":
        return f"{sql}, {out} AS (SELECT *, CASE WHEN {gone} THEN 0 ELSE side END AS signal FROM e1)"
    return f"""{sql}, e2 AS (SELECT * EXCLUDE (entry_), CASE WHEN {gone} THEN 0 ELSE entry_ END AS entry_ FROM e1),
{out} AS (SELECT *, coalesce(last_value(entry_ IGNORE NULLS) OVER u, 0) AS signal FROM e2 WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_SHOW = " SELECT symbol, ts, signal::INTEGER AS signal FROM sig"
_CROSS = lambda x, y, at: f"(({y} < {at} AND {x} >= {at}) OR ({y} > {at} AND {x} <= {at}))"


def _channel(fn: str, x: str, n: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {fn}({x}) {frame} END"


def _turtle(entry: int, leave: int, mode: str = "row", out: str = "sig") -> str:
    return f"t AS (SELECT *, {_channel('max', 'high', entry)} AS eh, {_channel('min', 'low', entry)} AS el, {_channel('max', 'high', leave)} AS xh, {_channel('min', 'low', leave)} AS xl FROM bars), " + _held(
        "t", "close > eh", "close < el", "CASE WHEN side = 1 THEN close < xl ELSE close > xh END", mode, out
    )


def _bollinger(mode: str) -> str:
    return f"""{_FIRST}, t0 AS (SELECT *, close - {_roll("avg", "close", 20)} AS x, {_roll("stddev_pop", "close", 20)} AS sd FROM bars), t AS (SELECT *, lag(x) OVER w AS x1 FROM t0 {_W}),
{_held("t", "x < -2 * sd", "x > 2 * sd", "x * x1 < 0 OR x = 0", mode)} {_SHOW}"""


_RUN = f"""{_FIRST}, {_turtle(20, 10)},
g AS (SELECT *, ln(close / nullif(lag(close) OVER w, 0)) AS log_ret FROM sig {_W}),
z AS (SELECT *, coalesce(signal * least(2.0::DOUBLE, 0.2::DOUBLE / nullif({_roll("stddev_samp", "log_ret", 20)} * sqrt(252.0::DOUBLE), 0)), 0.0::DOUBLE) AS size FROM g),
p AS (SELECT *, coalesce(lag(size) OVER w, 0.0::DOUBLE) AS position FROM z {_W}),
q AS (SELECT *, position * log_ret AS gross, coalesce(abs(position - lag(position) OVER w), 0.0::DOUBLE) AS traded FROM p {_W}),
run AS (SELECT *, gross - traded * 0.001::DOUBLE AS net FROM q)"""
_NET = f"{_RUN}, port AS (SELECT ts, ln(1 + sum(coalesce(exp(net) - 1, 0.0::DOUBLE)) / (SELECT count(DISTINCT symbol) FROM run)) AS ret FROM run GROUP BY ts)"
_CUM = "OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_METRICS = """round(exp(sum({x})) - 1, 6) AS total, round(exp(avg({x}) * 252) - 1, 6) AS annual, round(stddev_samp({x}) * sqrt(252.0::DOUBLE), 6) AS volatility,
  round((exp(avg({x}) * 252) - 1) / nullif(stddev_samp({x}) * sqrt(252.0::DOUBLE), 0), 6) AS sharpe, round(min(d), 6) AS max_drawdown"""
_TRADES = f"""{_RUN}, n AS (SELECT *, coalesce((position <> 0) <> lag(position <> 0) OVER w, true)::INTEGER AS new_ FROM run {_W}),
m AS (SELECT *, sum(new_) {_CUM.format(by="symbol")} AS run_ FROM n),
tr AS (SELECT symbol, min(ts) AS opened, max(ts) AS closed, count(*) AS bars, exp(sum(gross)) - 1 AS ret FROM m WHERE position <> 0 GROUP BY symbol, run_)"""


def _grid_sql() -> str:
    """Signals of all points, each with its own CTEs, united."""
    parts, union = [], []
    for k, p in enumerate(_POINTS):
        sql = _turtle(p["entry"], p["leave"], out=f"sig{k}")
        for name in ("t", "e0", "e1"):
            sql = sql.replace(f"{name} AS (", f"{name}_{k} AS (").replace(f"FROM {name})", f"FROM {name}_{k})").replace(f"FROM {name} ", f"FROM {name}_{k} ")
        parts.append(sql)
        union.append(f"SELECT {k} AS param_id, symbol, ts, close, signal::DOUBLE AS size FROM sig{k}")
    return f"""{_FIRST}, {", ".join(parts)}, al AS ({" UNION ALL ".join(union)}),
p AS (SELECT *, coalesce(lag(size) OVER w, 0.0::DOUBLE) AS position, ln(close / nullif(lag(close) OVER w, 0)) AS log_ret FROM al WINDOW w AS (PARTITION BY param_id, symbol ORDER BY ts)),
q AS (SELECT *, position * log_ret - coalesce(abs(position - lag(position) OVER w), 0.0::DOUBLE) * 0.001::DOUBLE AS net FROM p WINDOW w AS (PARTITION BY param_id, symbol ORDER BY ts)),
port AS (SELECT param_id, ts, ln(1 + sum(coalesce(exp(net) - 1, 0.0::DOUBLE)) / (SELECT count(DISTINCT symbol) FROM bars)) AS ret FROM q GROUP BY 1, 2)"""


_H = lambda k: f"h{k}" if k else "high"
_L = lambda k: f"l{k}" if k else "low"
_PEAK = " AND ".join([f"{_H(2)} > {_H(k)}" for k in (3, 4, 1, 0)] + [f"{_H(k)} > {_H(k + 1)}" for k in (2, 3, 4)])
_TROUGH = " AND ".join([f"{_L(2)} < {_L(k)}" for k in (3, 4, 1, 0)] + [f"{_L(k)} < {_L(k + 1)}" for k in (2, 3, 4)])

ORACLE_SQL = {
    "signal_ema_cross": _recursive(f"WITH RECURSIVE {BARS_SQL}", "bars", [("f", "close", 2 / 11, 10, "sma"), ("s", "close", 2 / 51, 50, "sma")], "a") + f", {_held('a', 'f > s', 'f < s')} {_SHOW}",
    "signal_macd_trend": _recursive(
        _recursive(f"WITH RECURSIVE {BARS_SQL}", "bars", [("f", "close", 2 / 13, 12, "sma"), ("s", "close", 2 / 27, 26, "sma")], "a")
        + """, b AS (SELECT *, f - s AS line, count(f - s) OVER u AS n_, avg(f - s) OVER u AS a_ FROM a WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b2 AS (SELECT * EXCLUDE (n_, a_), CASE WHEN n_ = 9 THEN a_ WHEN n_ > 9 THEN line END AS x FROM b)""",
        "b2", [("sg", "x", 0.2, 1, "first")], "d",
    )
    + f", d2 AS (SELECT *, lag(line) OVER w AS m1, lag(sg) OVER w AS s1 FROM d {_W}), {_held('d2', 'line > 0 AND line > sg AND m1 <= s1', 'line < 0 AND line < sg AND m1 >= s1', 'line * m1 < 0')} {_SHOW}",
    "signal_bollinger": _bollinger("row"),
    "signal_bollinger_hold": _bollinger("hold"),
    "signal_rsi": _recursive(
        f"WITH RECURSIVE {BARS_SQL}, g AS (SELECT *, close - lag(close) OVER w AS d FROM bars {_W}), h AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS dn FROM g)",
        "h", [("ru", "up", 1 / 14, 14, "first"), ("rd", "dn", 1 / 14, 14, "first")], "a",
    )
    + f", a2 AS (SELECT *, 100 * ru / nullif(ru + rd, 0) AS x FROM a), a3 AS (SELECT *, lag(x) OVER w AS x1 FROM a2 {_W}), {_held('a3', 'x < 30', 'x > 70', _CROSS('x', 'x1', 50))} {_SHOW}",
    "signal_zscore": f"{_FIRST}, t0 AS (SELECT *, (close - {_roll('avg', 'close', 20)}) / nullif({_roll('stddev_samp', 'close', 20)}, 0) AS z FROM bars), t AS (SELECT *, lag(z) OVER w AS z1 FROM t0 {_W}), {_held('t', 'z < -2', 'z > 2', _CROSS('z', 'z1', 0))} {_SHOW}",
    "signal_washer": f"""{_FIRST}, t0 AS (SELECT *, close / nullif({_lag("close", 4)}, 0) - 1 AS r FROM bars {_W}), t AS (SELECT *, (r - {_roll("avg", "r", 24)}) / nullif({_roll("stddev_samp", "r", 24)}, 0) AS z FROM t0),
e AS (SELECT *, CASE WHEN abs(z) < 0.5 THEN 0 WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 END AS e FROM t)
SELECT symbol, ts, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::INTEGER AS signal FROM e""",
    "signal_turtle": f"{_FIRST}, {_turtle(20, 10)} {_SHOW}",
    "signal_channel": f"{_FIRST}, t AS (SELECT *, {_channel('max', 'high', 20)} AS eh, {_channel('min', 'low', 20)} AS el, {_channel('max', 'high', 10)} AS xh, {_channel('min', 'low', 10)} AS xl FROM bars), {_held('t', 'high >= eh', 'low <= el', 'CASE WHEN side = 1 THEN low <= xl ELSE high >= xh END')} {_SHOW}",
    "signal_narrow_range": f"""{_FIRST}, t0 AS (SELECT *, (high - low) = {_roll("min", "(high - low)", 7)} AS on_ FROM bars),
t1 AS (SELECT *, last_value(CASE WHEN on_ THEN high END IGNORE NULLS) OVER u AS nh, last_value(CASE WHEN on_ THEN low END IGNORE NULLS) OVER u AS nl FROM t0 WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, lag(nh) OVER w AS nh1, lag(nl) OVER w AS nl1, lag(close) OVER w AS c1 FROM t1 {_W}), {_held("t", "close > nh AND c1 <= nh1", "close < nl AND c1 >= nl1")} {_SHOW}""",
    "signal_swing": f"""{_FIRST}, t AS (SELECT *, {", ".join(f"lag(high, {k}) OVER w AS h{k}, lag(low, {k}) OVER w AS l{k}" for k in range(1, 6))}, lag(close, 2) OVER w AS c2 FROM bars {_W}),
{_held("t", f"({_TROUGH} AND c2 > least(open, close))", f"({_PEAK} AND c2 < greatest(open, close))", "CASE WHEN side = 1 THEN close < least(open, close) ELSE close > greatest(open, close) END")} {_SHOW}""",
    "signal_supertrend": _atr(10)
    + f""", n AS MATERIALIZED (SELECT symbol, ts, close, (high + low) / 2 AS mid, atr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM a),
r AS (
  SELECT symbol, i, mid - 3 * atr AS lo, mid + 3 * atr AS up, 1 AS side FROM n WHERE i = 11
  UNION ALL
  SELECT symbol, i, CASE WHEN kept AND side > 0 THEN greatest(lo, plo) ELSE lo END, CASE WHEN kept AND side < 0 THEN least(up, pup) ELSE up END, side
  FROM (SELECT n.symbol, n.i, n.mid - 3 * n.atr AS lo, n.mid + 3 * n.atr AS up, r.lo AS plo, r.up AS pup, CASE WHEN n.close > r.up THEN 1 WHEN n.close < r.lo THEN -1 ELSE r.side END AS side, n.close BETWEEN r.lo AND r.up AS kept
        FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1))
SELECT n.symbol, n.ts, coalesce(side, 0)::INTEGER AS signal FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i""",
    "signal_pairs": f"""{_FIRST}, j AS (SELECT 1 AS symbol, a.ts, ln(a.close) AS ly, ln(b.close) AS lx FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol = 'S00' AND b.symbol = 'S01'),
k AS (SELECT *, CASE WHEN count(ly) OVER v = 60 THEN covar_samp(ly, lx) OVER v / nullif(var_samp(lx) OVER v, 0) END AS beta FROM j WINDOW v AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, ly - beta * lx AS s FROM k), z AS (SELECT *, (s - {_roll("avg", "s", 60)}) / nullif({_roll("stddev_samp", "s", 60)}, 0) AS z FROM s),
e AS (SELECT *, CASE WHEN abs(z) < 0 THEN 0 WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 END AS e FROM z), g AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::INTEGER AS g FROM e)
SELECT v.symbol, ts, round(beta, 6) AS beta, round(z, 6) AS z, (g * v.m)::INTEGER AS signal FROM g, (VALUES ('S00', 1), ('S01', -1)) v(symbol, m)""",
    "signal_regime": f"""{_FIRST}, idx AS (SELECT ts, lag(CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END) OVER (ORDER BY ts) AS green FROM bars WHERE symbol = 'S00'),
a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM bars WHERE symbol <> 'S00' {_W}), b AS (SELECT *, lag(r) OVER w AS r1, row_number() OVER w AS i FROM a {_W}),
c AS (SELECT b.*, green, row_number() OVER (PARTITION BY b.ts ORDER BY r1 DESC NULLS LAST, symbol) AS best, row_number() OVER (PARTITION BY b.ts ORDER BY r1 NULLS LAST, symbol) AS worst FROM b LEFT JOIN idx ON idx.ts = b.ts),
e AS (SELECT *, CASE WHEN r1 IS NULL THEN NULL WHEN green = 1 AND best <= 3 THEN 1 WHEN green = -1 AND worst <= 3 THEN -1 END AS e FROM c),
l AS (SELECT *, last_value(e IGNORE NULLS) OVER u AS le, last_value(CASE WHEN e IS NOT NULL THEN i END IGNORE NULLS) OVER u AS li FROM e WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, ts, coalesce(CASE WHEN i - li < 5 THEN le END, 0)::INTEGER AS signal FROM l""",
    "backtest_returns": f"{_RUN} SELECT symbol, ts, round(size, 6) AS size, round(position, 6) AS position, round(gross, 6) AS gross, round(traded, 6) AS traded, round(net, 6) AS net FROM run",
    "backtest_kelly": f"""{_FIRST}, {_turtle(20, 10)}, g AS (SELECT *, coalesce(lag(signal) OVER w * ln(close / nullif(lag(close) OVER w, 0)), 0.0::DOUBLE) AS r FROM sig {_W}),
k AS (SELECT *, CASE WHEN count(r) OVER u >= 50 THEN avg(r) OVER u / nullif(var_samp(r) OVER u, 0) END AS f FROM g WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, ts, round(CASE WHEN f IS NULL AND signal IS NOT NULL THEN signal * greatest(0.0::DOUBLE, 2.0::DOUBLE) ELSE signal * greatest(0.0::DOUBLE, least(2.0::DOUBLE, f / 2)) END, 6) AS size FROM k""",
    "backtest_metrics": f"{_RUN}, c AS (SELECT *, sum(net) {_CUM.format(by='symbol')} AS c FROM run WHERE net IS NOT NULL), d AS (SELECT *, exp(c - max(c) {_CUM.format(by='symbol')}) - 1 AS d FROM c) SELECT symbol, {_METRICS.format(x='net')}, round(sum(traded), 6) AS traded FROM d GROUP BY symbol",
    "backtest_portfolio": f"{_NET} SELECT ts, round(ret, 6) AS ret FROM port",
    "backtest_risk": f"""{_NET}, c AS (SELECT ret, exp(ret) - 1 AS x, sum(ret) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, ts FROM port), d AS (SELECT *, exp(c - max(c) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS d FROM c), v AS (SELECT quantile_cont(x, 0.05) AS v FROM d)
SELECT round(first(v), 6) AS var_95, round(avg(CASE WHEN x <= v THEN x END), 6) AS cvar_95, round((exp(avg(ret) * 252) - 1) / nullif(sqrt(avg(CASE WHEN x < 0 THEN x * x END)) * sqrt(252.0::DOUBLE), 0), 6) AS sortino,
       round((exp(avg(ret) * 252) - 1) / nullif(abs(min(d)), 0), 6) AS calmar, round(avg((x > 0)::INTEGER::DOUBLE), 6) AS win_rate, round(min(d), 6) AS max_drawdown FROM d, v""",
    "backtest_trades": f"{_TRADES} SELECT symbol, opened, closed, bars, round(ret, 6) AS ret FROM tr",
    "backtest_trade_metrics": f"{_TRADES} SELECT symbol, count(*) AS trades, round(avg((ret > 0)::INTEGER::DOUBLE), 6) AS win_rate, round(sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END), 0), 6) AS profit_factor, round(avg(ret), 6) AS avg_ret, round(avg(bars), 6) AS avg_bars FROM tr GROUP BY symbol",
    "backtest_transactions": f"""{_FIRST}, {_turtle(20, 10)}, p AS (SELECT *, coalesce(lag(signal::DOUBLE) OVER w, 0.0::DOUBLE) AS position FROM sig {_W}), q AS (SELECT *, position - coalesce(lag(position) OVER w, 0.0::DOUBLE) AS quantity FROM p {_W})
SELECT symbol, ts, CASE WHEN quantity > 0 THEN 'BUY' ELSE 'SELL' END AS action, round(quantity, 4) AS quantity, round(close, 4) AS price, round(quantity * close, 4) AS value FROM q WHERE quantity <> 0""",
    "backtest_round_trips": f"""{_FIRST}, {_turtle(20, 10)}, p AS (SELECT *, coalesce(lag(signal::DOUBLE) OVER w, 0.0::DOUBLE) AS position FROM sig {_W}), q AS (SELECT *, position - coalesce(lag(position) OVER w, 0.0::DOUBLE) AS quantity, coalesce(lag(position) OVER w, 0.0::DOUBLE) AS prev FROM p {_W}),
f AS (SELECT symbol, ts, close AS price, quantity, prev, CASE WHEN prev * quantity < 0 THEN least(abs(prev), abs(quantity)) ELSE 0.0::DOUBLE END AS cq FROM q WHERE quantity <> 0),
lots AS (SELECT symbol, ts AS opened, price AS entry, CASE WHEN quantity > 0 THEN 'long' ELSE 'short' END AS side FROM f WHERE abs(quantity) > cq),
outs AS (SELECT symbol, ts AS closed, price AS exit FROM f WHERE cq > 0)
SELECT l.symbol, side, opened, o.closed, round(entry, 4) AS entry, round(exit, 4) AS exit, round(1.0::DOUBLE, 4) AS quantity, round(CASE WHEN side = 'long' THEN exit - entry ELSE entry - exit END, 4) AS pnl
FROM lots l JOIN outs o ON o.symbol = l.symbol AND o.closed > l.opened QUALIFY row_number() OVER (PARTITION BY l.symbol, l.opened ORDER BY o.closed) = 1""",
    "backtest_stop_loss": f"""{_FIRST}, {_turtle(20, 10, "hold")}, n AS (SELECT symbol, ts, high, low, close, signal, coalesce(signal <> lag(signal) OVER w, true)::INTEGER AS new_ FROM sig {_W}), m AS (SELECT *, sum(new_) {_CUM.format(by="symbol")} AS run_ FROM n),
h AS (SELECT *, CASE WHEN row_number() OVER v > 1 AND ((signal > 0 AND low <= first_value(close) OVER v * (1 - 0.05::DOUBLE)) OR (signal < 0 AND high >= first_value(close) OVER v * (1 + 0.05::DOUBLE))) THEN 1 ELSE 0 END AS hit FROM m WINDOW v AS (PARTITION BY symbol, run_ ORDER BY ts))
SELECT symbol, ts, (CASE WHEN max(hit) {_CUM.format(by="symbol, run_")} = 1 THEN 0 ELSE signal END)::INTEGER AS signal FROM h""",
    "backtest_latest": f"""{_FIRST}, {_turtle(20, 10)}, b AS (SELECT *, coalesce(lag(signal) OVER w, 0) AS old FROM sig {_W}), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), k AS (SELECT sum(abs(signal)) AS total FROM l)
SELECT symbol, ts, signal::INTEGER AS signal, CASE WHEN signal = 0 AND old <> 0 THEN 'CLOSE' WHEN signal > 0 AND old <= 0 THEN 'BUY' WHEN signal < 0 AND old >= 0 THEN 'SELL_SHORT' ELSE 'HOLD' END AS action,
       round(CASE WHEN total > 1 THEN signal * 1.0::DOUBLE / total ELSE signal::DOUBLE END, 6) AS weight FROM l, k""",
    "backtest_monthly": f"{_NET} SELECT year(ts)::INTEGER AS year, " + ", ".join(f'round(exp(sum(ret) FILTER (WHERE month(ts) = {m})) - 1, 6) AS "{m}"' for m in range(1, 13)) + " FROM port GROUP BY 1",
    "grid_search": f"{_grid_sql()}, c AS (SELECT *, sum(ret) {_CUM.format(by='param_id')} AS c FROM port), d AS (SELECT *, exp(c - max(c) {_CUM.format(by='param_id')}) - 1 AS d FROM c) SELECT param_id, round(sum(ret), 6) AS log_return, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0::DOUBLE), 6) AS sharpe, round(min(d), 6) AS max_drawdown FROM d GROUP BY param_id",
    "walk_forward": f"""{_grid_sql()}, dy AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM port)), wn AS (SELECT unnest(generate_series(0, greatest(0, ((SELECT max(i) FROM dy) - 252) // 63)))::BIGINT AS wd),
rw AS (SELECT wd, param_id, ret, i < wd * 63 + 252 AS tr FROM port JOIN dy USING (ts) JOIN wn ON i >= wd * 63 AND i < wd * 63 + 315),
s AS (SELECT wd, param_id, avg(CASE WHEN tr THEN ret END) / nullif(stddev_samp(CASE WHEN tr THEN ret END), 0) AS sh, sum(CASE WHEN NOT tr THEN ret END) AS tt, count(CASE WHEN NOT tr THEN 1 END) AS n FROM rw GROUP BY 1, 2)
SELECT wd AS "window", param_id, round(sh, 6) AS train_sharpe, round(tt, 6) AS test_ret, n AS test_days FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY wd ORDER BY sh DESC, param_id) = 1""",
    "monte_carlo": f"""{_NET}, r AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, ret FROM port), n AS (SELECT count(*) AS n FROM r),
dr AS (SELECT sim, t, ('0x' || substr(md5('42:' || sim::VARCHAR || ':' || t::VARCHAR), 1, 8))::BIGINT % n AS i FROM n, generate_series(0, 99) a(sim), generate_series(0, (SELECT n - 1 FROM n)) b(t)),
c AS (SELECT sim, t, ret, sum(ret) OVER (PARTITION BY sim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM dr JOIN r USING (i)),
d AS (SELECT sim, ret, exp(c - greatest(0.0::DOUBLE, max(c) OVER (PARTITION BY sim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) - 1 AS d FROM c)
SELECT sim, round(exp(sum(ret)), 6) AS end_value, round(min(d), 6) AS max_drawdown FROM d GROUP BY sim""",
    "weights_inverse_volatility": f"{_FIRST}, g AS (SELECT symbol, ln(close / nullif(lag(close) OVER w, 0)) AS g FROM bars {_W}), v AS (SELECT symbol, stddev_samp(g) AS vol FROM g GROUP BY symbol) SELECT symbol, round(vol, 6) AS vol, round((1 / vol) / (sum(1 / vol) OVER ()), 6) AS weight FROM v",
    "regime_ar": f"""{_FIRST}, a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM bars {_W}), b AS (SELECT *, lag(r) OVER w AS r1 FROM a {_W}),
p AS (SELECT symbol, ts, CASE WHEN count(r1) OVER v = 60 THEN covar_samp(r, r1) OVER v / nullif(var_samp(r1) OVER v, 0) END AS phi FROM b WHERE r1 IS NOT NULL WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, phi / nullif(sqrt(greatest(0.0::DOUBLE, (1 - phi * phi) / 60)), 0) AS t FROM p)
SELECT symbol, ts, round(phi, 4) AS phi, round(t, 4) AS t, CASE WHEN t > 1.96 THEN 'trend' WHEN t < -1.96 THEN 'reversion' WHEN t IS NOT NULL THEN 'neutral' END AS regime FROM t""",
}
