"""Queries of further rule strategies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import resample as rs
from lodestar.operators import strategy as st
from lodestar.operators.backtest import ar_filter
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _ATR_X, _TR, _W, _lag, _recursive, _roll
from lodestar.plans.strategies import _CROSS, _SHOW, _held, _signals
from lodestar.sources.bridge import BARS_SQL, TICKS_SQL, bars, ticks


def _half_hours(s, d):
    return rs.tick_bars(ticks(s, d), {"30m": 1800}).drop("frame")


def _kinematics(s, d):
    """Ticks in three time frames; the coarse regime: with the last day's move where moves go on, against it where they revert, else flat."""
    frames = rs.tick_bars(ticks(s, d), {"30m": 1800, "4h": 14400, "D": 86400})
    low, mid, day = (frames.where(F.col("frame") == f).drop("frame") for f in ("30m", "4h", "D"))
    way = F.signum("ret") * F.when(F.col("regime") == "momentum", 1).when(F.col("regime") == "mean_reversion", -1).otherwise(0)
    known = ar_filter(day, window=10, least_t=0.5).select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), way.alias("regime"))
    return rounded(st.frame_kinematics(low, mid, known, 14400, 1800).select("symbol", "ts", "close", "signal"))


QUERIES = {
    "signal_kinematics": _kinematics,
    "signal_macd_reversal": _signals("macd_reversal"),
    "signal_grid_trend": _signals("grid_trading"),
    "signal_grid_reversal": _signals("grid_reversal"),
    "signal_markov": _signals("markov_trend"),
    "signal_markov_cross": _signals("markov_cross"),
    "signal_double_markov": _signals("double_markov"),
    "signal_tdi_time_exit": _signals("tdi_time_exit"),
    "signal_rebalancing": _signals("rebalancing_premium"),
    "signal_rebalancing_trend": _signals("rebalancing_premium", trend=True),
    "signal_bouncy_ball": _signals("bouncy_ball", oversold=60.0, zone=0.2),
    "signal_ichimoku": _signals("ichimoku_cloud"),
    "signal_ichimoku_lookahead": _signals("ichimoku_cloud", lookahead=True),
    "signal_daily_range": _signals("daily_range_breakout"),
    "signal_daily_range_ticks": lambda s, d: st.daily_range_breakout(_half_hours(s, d)).select("symbol", "ts", F.col("signal").cast("int").alias("signal")),
    "signal_squeeze": _signals("squeeze_breakout", channel=6.0),
    "signal_tdi_heikin_ashi": _signals("tdi_heikin_ashi"),
    "signal_newsom": _signals("newsom"),
    "signal_news": lambda s, d: st.news_breakout(_half_hours(s, d)).select("symbol", "ts", F.col("signal").cast("int").alias("signal")),
    "signal_cluster_reversion": lambda s, d: rounded(st.cluster_reversion(bars(s, d), threshold=0.01).select("symbol", "ts", "z", F.col("signal").cast("int").alias("signal"))),
    "screen_slope": lambda s, d: st.slope_screen(bars(s, d)),
    "signal_energy": lambda s, d: rounded(st.energy_states(bars(s, d)).select("symbol", "ts", "energy", "state", "force", "breakout", "reversion"), 4),
}

_FIRST, _REC = f"WITH {BARS_SQL}", f"WITH RECURSIVE {BARS_SQL}"
_UP_TO = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BARS30 = f"""{TICKS_SQL},
bars AS (
  SELECT symbol, to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(volume) AS volume
  FROM ticks GROUP BY 1, 2)"""


def _with_atr(n: int, setup: str = _REC, source: str = "bars") -> str:
    """CTEs that end in ``a`` with ``atr`` beside the columns of ``source``."""
    return _recursive(f"{setup}, {_TR.replace('FROM bars', f'FROM {source}')}, {_ATR_X.format(n=n)}", "tr3", [("atr", "x", 1 / n, 1, "first")], "a")


def _with_rsi(n: int, setup: str = _REC, source: str = "bars") -> str:
    """CTEs that end in ``rs`` with ``x`` beside the columns of ``source``."""
    moves = f"{setup}, g AS (SELECT *, close - lag(close) OVER w AS d FROM {source} {_W}), h AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS dn FROM g)"
    return _recursive(moves, "h", [("ru", "up", 1 / n, n, "first"), ("rd", "dn", 1 / n, n, "first")], "rr") + ", rs AS (SELECT * EXCLUDE (d, up, dn, ru, rd), 100 * ru / nullif(ru + rd, 0) AS x FROM rr)"


_MACD = (
    _recursive(
        _recursive(_REC, "bars", [("f", "close", 2 / 13, 12, "sma"), ("s", "close", 2 / 27, 26, "sma")], "a")
        + f""", b AS (SELECT *, f - s AS line, count(f - s) OVER u AS n_, avg(f - s) OVER u AS a_ FROM a WINDOW u AS {_UP_TO}),
b2 AS (SELECT * EXCLUDE (n_, a_), CASE WHEN n_ = 9 THEN a_ WHEN n_ > 9 THEN line END AS x FROM b)""",
        "b2", [("sg", "x", 0.2, 1, "first")], "d",
    )
    + f", d2 AS (SELECT *, lag(line) OVER w AS m1 FROM d {_W})"
)


def _grid(reverse: bool) -> str:
    up, down = "k > lag(k) OVER w", "m < lag(m) OVER w"
    long, short = (down, up) if reverse else (up, down)
    place = "((close / first_value(close) OVER w - 0.9::DOUBLE) / ((1.1::DOUBLE - 0.9::DOUBLE) / 9))"
    return f"""{_FIRST}, p AS (SELECT *, greatest(0, least(10, floor({place}) + 1)) AS k, greatest(0, least(10, ceil({place}))) AS m FROM bars {_W}),
t AS (SELECT symbol, ts, {long} AS lo, {short} AS sh FROM p {_W}), {_held("t", "lo", "sh")} {_SHOW}"""


_UPS = (
    _with_atr(14)
    + f""", z AS (SELECT *, (close - {_lag("close", 14)}) / nullif(atr, 0) AS z FROM a {_W}),
st AS (SELECT *, coalesce(last_value(CASE WHEN z > 0.5 THEN 1 WHEN z < -0.5 THEN -1 END IGNORE NULLS) OVER {_UP_TO}, 1) AS state FROM z),
ups AS (SELECT *, {_roll("sum", "(state = 1)::INTEGER", 33)} AS ups FROM st)"""
)


def _ichimoku(late: str) -> str:
    mid = lambda n: f"(({_roll('max', 'high', n)}) + ({_roll('min', 'low', n)})) / 2"
    return f"""{_FIRST}, m AS (SELECT *, {mid(9)} AS tk, {mid(26)} AS kj, {mid(52)} AS sb FROM bars), i AS (SELECT *, lag((tk + kj) / 2, 25) OVER w AS sa, lag(sb, 25) OVER w AS sbb FROM m {_W}),
j AS (SELECT *, lag(sa, 26) OVER w AS ca, lag(sbb, 26) OVER w AS cb, {late} AS late FROM i {_W}), k AS (SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN greatest(ca, cb) END AS top, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN least(ca, cb) END AS low_ FROM j),
l AS (SELECT *, lag(top, 26) OVER w AS top1, lag(low_, 26) OVER w AS low1 FROM k {_W}),
e AS (SELECT *, CASE WHEN close <= top AND close >= low_ THEN 0 WHEN close < low_ AND late < low1 AND sa < sbb THEN -1 WHEN close > top AND late > top1 AND sa > sbb THEN 1 END AS e FROM l)
SELECT symbol, ts, coalesce(last_value(e IGNORE NULLS) OVER {_UP_TO}, 0)::INTEGER AS signal FROM e"""


def _rebalancing(trend: bool) -> str:
    long, short = ("x > 0", "x < 0") if trend else ("x < -2 * sd", "x > 2 * sd")
    return f"""{_FIRST}, t0 AS (SELECT *, close - {_roll("avg", "close", 20)} AS x, {_roll("stddev_pop", "close", 20)} AS sd FROM bars), t AS (SELECT *, lag(x) OVER w AS x1 FROM t0 {_W}),
e AS (SELECT *, CASE WHEN {_CROSS("x", "x1", 0)} THEN 0 WHEN {short} THEN -1 WHEN {long} THEN 1 END AS e FROM t)
SELECT symbol, ts, coalesce(last_value(e IGNORE NULLS) OVER {_UP_TO}, 0)::INTEGER AS signal FROM e"""


def _daily_range(setup: str) -> str:
    return f"""WITH {setup}, dd AS (SELECT symbol, ts::DATE + 1 AS day, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2),
j AS (SELECT b.*, last_value(dd.h IGNORE NULLS) OVER v AS h, last_value(dd.l IGNORE NULLS) OVER v AS l FROM bars b LEFT JOIN dd ON dd.symbol = b.symbol AND dd.day = b.ts::DATE WINDOW v AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, CASE WHEN close < l AND lag(close) OVER w >= lag(l) OVER w THEN -1 WHEN close > h AND lag(close) OVER w <= lag(h) OVER w THEN 1 END AS e FROM j {_W}),
s AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER {_UP_TO}, 0) AS side FROM k),
n AS (SELECT *, CASE WHEN side <> 0 AND side IS DISTINCT FROM lag(side) OVER w THEN ts END AS b FROM s {_W}), o AS (SELECT *, last_value(b IGNORE NULLS) OVER {_UP_TO} AS begun FROM n)
SELECT symbol, ts, (CASE WHEN floor((epoch(ts) - epoch(begun)) / 86400) >= 5 THEN 0 ELSE side END)::INTEGER AS signal FROM o"""


_NEWSOM = (
    _recursive(_with_atr(22) + ", q AS (SELECT * EXCLUDE (tr, x), 100 * atr / nullif(close, 0) AS q FROM a)", "q", [("e", "close", 2 / 11, 10, "sma"), ("v", "q", 2 / 21, 20, "sma")], "ev")
    + f""", cs AS MATERIALIZED (SELECT *, coalesce({_roll("max", "close", 22)} - 3 * atr, 0) AS ls, coalesce({_roll("min", "close", 22)} + 3 * atr, 0) AS ss, 4 * {_roll("stddev_pop", "close", 20)} AS wd, row_number() OVER w AS i FROM ev {_W}),
ch AS (
  SELECT symbol, i, close, ls, ss, 0 AS dir, 1 AS side FROM cs WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.i, n.close, CASE WHEN r.close > r.ls THEN greatest(n.ls, r.ls) ELSE n.ls END, CASE WHEN r.close < r.ss THEN least(n.ss, r.ss) ELSE n.ss END,
         CASE WHEN n.close > r.ss THEN 1 WHEN n.close < r.ls THEN -1 ELSE r.side END, CASE WHEN n.close > r.ss THEN 1 WHEN n.close < r.ls THEN -1 ELSE r.side END
  FROM ch r JOIN cs n ON n.symbol = r.symbol AND n.i = r.i + 1),
nw AS (
  SELECT cs.*, ch.dir, lag(ch.dir) OVER w AS d1, wd > lag(wd) OVER w AND q > v AS calm, lag(cs.close) OVER w < lag(open) OVER w AS fell, lag(cs.close) OVER w > lag(open) OVER w AS rose
  FROM cs JOIN ch ON ch.symbol = cs.symbol AND ch.i = cs.i WINDOW w AS (PARTITION BY cs.symbol ORDER BY ts))"""
)
_TDI_HA = (
    _recursive(
        _recursive(
            _with_rsi(13) + ", ha AS (SELECT *, (open + high + low + close) / 4 AS hc, (open + close) / 2 AS ho FROM rs)",
            "ha", [("e", "hc", 2 / 6, 5, "sma"), ("g", "x", 2 / 3, 2, "sma")], "eg",
        ),
        "eg", [("r", "g", 2 / 8, 7, "sma")], "egr",
    )
    + f""", k AS (SELECT *, lag(e, 2) OVER w AS o, lag(g) OVER w AS g1, lag(g, 2) OVER w AS g2, lag(r) OVER w AS r1, lag(r, 2) OVER w AS r2,
  lag(hc > ho) OVER w AND lag(hc < ho, 2) OVER w AS up, lag(hc < ho) OVER w AND lag(hc > ho, 2) OVER w AS dn FROM egr {_W}),
l AS (SELECT *, o IS NOT NULL AND least(low, ho, hc) >= o AS above, o IS NOT NULL AND greatest(high, ho, hc) <= o AS below, g1 - g2 AS slope,
  coalesce(g2 < r2 AND g1 >= r1, false) AS over_, coalesce(g2 > r2 AND g1 <= r1, false) AS under_ FROM k),
m AS (SELECT *, coalesce(lag(over_) OVER w, false) AS over1, coalesce(lag(under_) OVER w, false) AS under1 FROM l {_W})"""
)

ORACLE_SQL = {
    "signal_macd_reversal": f"{_MACD}, {_held('d2', 'line > sg', 'line < sg', _CROSS('line', 'm1', 0))} {_SHOW}",
    "signal_grid_trend": _grid(False),
    "signal_grid_reversal": _grid(True),
    "signal_markov": f"{_UPS}, {_held('ups', '2 * ups > 33', '2 * ups < 33')} {_SHOW}",
    "signal_markov_cross": f"{_UPS}, u1 AS (SELECT *, lag(ups) OVER w AS b FROM ups {_W}), {_held('u1', '2 * ups > 33 AND 2 * b <= 33', '2 * ups < 33 AND 2 * b >= 33')} {_SHOW}",
    "signal_double_markov": f"""{_UPS}, dv AS (SELECT *, coalesce(close - lag(close) OVER w, 0) AS d FROM ups {_W}),
sm AS (SELECT *, {_roll("sum", "(d > 0)::INTEGER", 90)} AS nu, {_roll("sum", "(d < 0)::INTEGER", 90)} AS nd, {_roll("sum", "greatest(0, d)", 90)} AS su, {_roll("sum", "greatest(0, -d)", 90)} AS sd FROM dv),
ev AS (SELECT *, nu * su / nullif(nu * su + nd * sd, 0) * su / nullif(nu, 0) - nd * sd / nullif(nu * su + nd * sd, 0) * sd / nullif(nd, 0) AS ev FROM sm), es AS (SELECT *, {_roll("avg", "ev", 20)} AS es FROM ev),
{_held("es", "2 * ups > 33 AND es > 0", "2 * ups < 33 AND es < 0")} {_SHOW}""",
    "signal_tdi_time_exit": _with_atr(20, _with_rsi(21).replace("AS x FROM rr", "AS rsi FROM rr"), "rs")
    + f""", f AS (SELECT *, {_roll("avg", "rsi", 2)} AS f, {_roll("avg", "rsi", 7)} AS s, {_roll("stddev_pop", "close", 10)} AS sd FROM a),
k AS (SELECT *, lag(f) OVER w AS f1, lag(s) OVER w AS s1, coalesce(3 * sd > lag(3 * sd) OVER w, false) AS wide, coalesce(atr > lag(atr) OVER w, false) AS rise FROM f {_W}),
e AS (SELECT *, (rise AND wide) OR (coalesce(((s1 < f1 AND s >= f) OR (s1 > f1 AND s <= f)) AND abs(f - f1) > 0.9, false) AND (rise OR wide)) AS go FROM k),
e2 AS (SELECT *, CASE WHEN go AND f < s THEN -1 WHEN go AND f > s THEN 1 END AS en FROM e), e3 AS (SELECT *, (en IS NOT NULL AND en IS DISTINCT FROM lag(en) OVER w)::INTEGER AS fresh FROM e2 {_W}),
e4 AS (SELECT *, sum(fresh) OVER {_UP_TO} AS id, coalesce(last_value(en IGNORE NULLS) OVER {_UP_TO}, 0) AS side FROM e3)
SELECT symbol, ts, (CASE WHEN row_number() OVER (PARTITION BY symbol, id ORDER BY ts) - 1 >= 10 THEN 0 ELSE side END)::INTEGER AS signal FROM e4""",
    "signal_rebalancing": _rebalancing(False),
    "signal_rebalancing_trend": _rebalancing(True),
    "signal_bouncy_ball": _recursive(_with_rsi(14), "rs", [("s", "close", 2 / 201, 200, "sma"), ("f", "close", 2 / 21, 20, "sma")], "m")
    + f", {_held('m', '(close - s) / nullif(s, 0) BETWEEN 0 AND 0.2::DOUBLE AND x < 60 AND close > open', 'false', 'side = 1 AND close >= f')} {_SHOW}",
    "signal_ichimoku": _ichimoku("close"),
    "signal_ichimoku_lookahead": _ichimoku("lead(close, 25) OVER w"),
    "signal_daily_range": _daily_range(BARS_SQL),
    "signal_daily_range_ticks": _daily_range(_BARS30),
    "signal_squeeze": _recursive(f"{_REC}, {_TR}", "tr", [("k", "close", 2 / 21, 20, "sma"), ("wd", "tr", 2 / 21, 20, "sma")], "a")
    + f""", b AS (SELECT *, {_roll("avg", "close", 20)} AS m, {_roll("stddev_pop", "close", 20)} AS sd FROM a), b2 AS (SELECT *, close - m AS y, m + 2 * sd <= k + 6 * wd AND m - 2 * sd >= k - 6 * wd AS sq FROM b), b3 AS (SELECT *, lag(y) OVER w AS y1 FROM b2 {_W}),
{_held("b3", "sq AND y < -2 * sd", "sq AND y > 2 * sd", "((side = 1 AND y1 > 0 AND y <= 0) OR (side = -1 AND y1 < 0 AND y >= 0))")} {_SHOW}""",
    "signal_tdi_heikin_ashi": f"""{_TDI_HA}, {_held("m", "(over_ OR over1) AND slope >= 1 AND up AND above", "(under_ OR under1) AND slope <= -1 AND dn AND below",
    "CASE WHEN side = 1 THEN coalesce(abs(slope) <= 0.2, false) OR coalesce(slope <= -1, false) OR under_ ELSE coalesce(abs(slope) <= 0.2, false) OR coalesce(slope >= 1, false) OR over_ END")} {_SHOW}""",
    "signal_newsom": f"""{_NEWSOM}, {_held("nw", "close > e AND fell AND (open + high + low + close) / 4 > e AND dir = 1 AND calm", "close < e AND rose AND (open + high + low + close) / 4 < e AND dir = -1 AND calm", "dir IS DISTINCT FROM d1")} {_SHOW}""",
    "screen_slope": _recursive(_REC, "bars", [("wk", "close", 2 / 8, 7, "first"), ("qt", "close", 2 / 91, 90, "first")], "a")
    + f""", d AS (SELECT *, wk - lag(wk) OVER w AS dw, qt - lag(qt) OVER w AS dq FROM a {_W}), e AS (SELECT *, lag(dw) OVER w AS dw1, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM d {_W}),
f AS (SELECT symbol, ts, coalesce(dw1 < 0 AND dw > 0 AND dq > 0, false) AS bull_entry, coalesce(dw1 > 0 AND dw < 0 AND dq < 0, false) AS bear_entry FROM e WHERE k <= 5)
SELECT * FROM f WHERE symbol IN (SELECT symbol FROM f WHERE bull_entry OR bear_entry)""",
}
