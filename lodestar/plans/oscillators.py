"""Queries of further technical indicators, and their SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from lodestar.operators import oscillators as o
from lodestar.operators.indicators import sma
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _ATR_X, _EPS, _FIRST, _OHLCV, _REC, _TR, _W, _kernel, _lag, _r, _recursive, _roll, _select, _study
from lodestar.plans.rules import _with_atr, _with_rsi
from lodestar.sources.bridge import bars


def _pivots(method: str):
    return lambda s, d: rounded(o.more_pivots(bars(s, d), method).drop(*_OHLCV))


def _crosses(s, d):
    df = o.crosses(sma(bars(s, d), 10), "close", "SMA_10")
    return o.trend_signals(df, F.col("close") > F.col("SMA_10")).drop(*_OHLCV, "SMA_10")


QUERIES = {
    "ta_more_kernels": _study("gravity", "correlation_trend", "regression_angle", "price_distance", "fast_stoch", "brar", digits=4),
    "ta_more_volume": _study(("ease_of_movement", {"divisor": 1.0}), "volume_indexes", ("volume_heat", {"length": 60}), "time_segmented_volume", ("vwap", {"anchor": "month"}), digits=2),
    "ta_volume_profile": lambda s, d: rounded(o.volume_profile(bars(s, d))),
    "ta_volume_profile_price": lambda s, d: rounded(o.volume_profile(bars(s, d), by_price=True)),
    "ta_more_flags": _study(("exhaustion", {"length": 4}), "imbalances", "candle_scores"),
    "ta_transforms": _study("detrended", "remap", ("cube", {"power": 2.0}), "inverse_fisher", "deviation_lines", digits=2),
    "ta_detrended_lookahead": _study(("detrended", {"lookahead": True})),
    "ta_percent_rank": _study("percent_rank"),
    "ta_pivots_classic": _pivots("classic"),
    "ta_pivots_woodie": _pivots("woodie"),
    "ta_pivots_demark": _pivots("demark"),
    "ta_crosses": _crosses,
    "ta_smoothed": _study("smma", "alligator"),
    "ta_t3": _study("t3"),
    "ta_zero_lag": _study("zero_lag"),
    "ta_ppo": _study("ppo"),
    "ta_tsi": _study("tsi"),
    "ta_smi": _study("smi"),
    "ta_pretty_good": _study("pretty_good"),
    "ta_elder_ray": _study("elder_ray"),
    "ta_kdj": _study("kdj"),
    "ta_stoch_rsi": _study("stoch_rsi", digits=4),
    "ta_connors_rsi": _study("connors_rsi", digits=4),
    "ta_inertia": _study("inertia", digits=4),
    "ta_thermometer": _study("thermometer"),
    "ta_aberration": _study("aberration"),
    "ta_chandelier": _study("chandelier"),
    "ta_kroll": _study("kroll_stops"),
    "ta_squeeze": _study("squeeze_pro"),
    "ta_archer": _study("archer_trends"),
    "ta_random_walk": _study("random_walk"),
    "ta_klinger": _study("klinger", digits=4),
    "ta_archer_volume": _study("archer_volume", digits=4),
    "ta_true_momentum": _study("true_momentum"),
    "ta_vidya": _study("vidya"),
    "ta_hilo": _study("hilo"),
    "ta_mcginley": _study(("mcginley", {"k": 1e9}), digits=4),
    "ta_fisher": _study("fisher"),
    "ta_holt_winter": _study("holt_winter", digits=4),
    "ta_super_smoother": _study("super_smoother", digits=4),
    "ta_decay": _study(("decay", {"length": 5})),
    "ta_qqe": _study("qqe", digits=4),
}

_UP = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PREV = "lag(close) OVER w"
_AVG = lambda x, n: _roll("avg", x, n)
_HI, _LO = (lambda n: _roll("max", "high", n)), (lambda n: _roll("min", "low", n))
_EWMS = lambda setup, source, out, *specs: _recursive(setup, source, [(n, x, 2 / (k + 1), k, "sma") for n, x, k in specs], out)


def _numbered(setup: str, source: str) -> str:
    return f"{setup}, nb AS MATERIALIZED (SELECT *, row_number() OVER w AS i FROM {source} {_W})"


def _restart(setup: str, source: str, x: str, n: int, name: str, out: str) -> str:
    """A mean of ``x`` that starts with the plain mean of its first n values."""
    sql = f"{setup}, k0{out} AS (SELECT *, count({x}) OVER {_UP} AS n_, avg({x}) OVER {_UP} AS a_ FROM {source}), k1{out} AS (SELECT * EXCLUDE (n_, a_), CASE WHEN n_ = {n} THEN a_ WHEN n_ > {n} THEN {x} END AS x_ FROM k0{out})"
    return _recursive(sql, f"k1{out}", [(name, "x_", 2 / (n + 1), 1, "first")], out)


def _runs(fast: str, slow: str, n: int) -> str:
    up, down = (lambda x: f"coalesce({x} > {_lag(x, n)}, false)"), (lambda x: f"coalesce({x} < {_lag(x, n)}, false)")
    return f"({up(fast)} AND ({up(slow)} OR {down(slow)}))::INTEGER AS lr, ({down(fast)} AND ({down(slow)} OR {up(slow)}))::INTEGER AS sr"


def _pivot_sql(p: str, levels: dict[str, str]) -> str:
    return f"""{_FIRST}, pp AS (SELECT symbol, date_trunc('month', ts) AS m, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
pq AS (SELECT symbol, m, o AS now_, lag(o) OVER v AS o, lag(h) OVER v AS h, lag(l) OVER v AS l, lag(c) OVER v AS c FROM pp WINDOW v AS (PARTITION BY symbol ORDER BY m)), pr AS (SELECT *, {p} AS p FROM pq)
SELECT b.symbol, b.ts, round(p, 6) AS "PIVOT", {", ".join(f'round({x}, 6) AS "{k}"' for k, x in levels.items())} FROM bars b LEFT JOIN pr ON pr.symbol = b.symbol AND pr.m = date_trunc('month', b.ts)"""


_IX = "WITH ix AS (SELECT 1)"
_SIDES = lambda x: f"CASE WHEN {x} > 0 THEN {x} WHEN {x} IS NOT NULL THEN 0.0::DOUBLE END"
_RVI = _EWMS(
    f"{_REC}, v0 AS (SELECT *, {_roll('stddev_samp', 'close', 14)} AS sd, close - {_PREV} AS d FROM bars {_W}), v1 AS (SELECT *, CASE WHEN d > 0 THEN sd WHEN d IS NOT NULL AND sd IS NOT NULL THEN 0.0::DOUBLE END AS p, CASE WHEN d < 0 THEN sd WHEN d IS NOT NULL AND sd IS NOT NULL THEN 0.0::DOUBLE END AS n FROM v0)",
    "v1", "v2", ("ep", "p", 14), ("en", "n", 14),
)
_PROFILE = """, pd AS (SELECT *, {bin} AS bin, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
pv AS (SELECT symbol, bin::INTEGER AS bin, min(close) AS lo, avg(close) AS me, max(close) AS hi, sum(CASE WHEN d > 0 THEN volume ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN volume ELSE 0 END) AS dn, sum(CASE WHEN d = 0 OR d IS NULL THEN volume ELSE 0 END) AS st FROM pd GROUP BY 1, 2)
SELECT symbol, bin, round(lo, 6) AS low, round(me, 6) AS mean, round(hi, 6) AS high, round(up, 6) AS rising, round(dn, 6) AS falling, round(st, 6) AS still, round(up + dn, 6) AS total FROM pv"""
_A2, _B2 = math.exp(-math.pi * math.sqrt(2) / 20), 2 * math.exp(-math.pi * math.sqrt(2) / 20) * math.cos(math.pi * math.sqrt(2) / 20)
_E3 = math.exp(-math.pi / 20)
_G3, _H3 = 2 * _E3 * math.cos(-math.pi * math.sqrt(3) / 20), _E3 * _E3
_D2, _D3, _D4 = _G3 + _H3, -_H3 * (1 + _G3), _H3 * _H3
_T3 = (0.7**3 + 3 * 0.7**2 + 3 * 0.7 + 1, -6 * 0.7**2 - 3 * 0.7 - 3 * 0.7**3, 3 * 0.7**2 + 3 * 0.7**3, -(0.7**3))


def _chain(n: int, length: int) -> str:
    sql, before, col = _REC, "bars", "close"
    for k in range(1, n + 1):
        sql = _EWMS(sql, before, f"h{k}", (f"e{k}", col, length))
        before, col = f"h{k}", f"e{k}"
    return sql


def _strength(name: str, fast: int, slow: int, signal: int) -> str:
    sql = _EWMS(f"{_REC}, d0 AS (SELECT *, close - {_PREV} AS d, abs(close - {_PREV}) AS q FROM bars {_W})", "d0", "d1", ("s", "d", slow), ("t", "q", slow))
    sql = _EWMS(sql, "d1", "d2", ("fs", "s", fast), ("ft", "t", fast)) + ", d3 AS (SELECT *, 100 * fs / nullif(ft, 0) AS v FROM d2)"
    return _EWMS(sql, "d3", "d4", ("sg", "v", signal))


def _connors() -> str:
    """CTEs that end in ``rs2``: the strength of the close as x3, the close as cl0, and the strength of its streak as x."""
    streaks = f"""{_REC}, k0 AS (SELECT *, coalesce(close > {_PREV}, false) AS up, coalesce(close < {_PREV}, false) AS dn FROM bars {_W}), k1 AS (SELECT *, sum((NOT up)::INTEGER) OVER {_UP} AS gu, sum((NOT dn)::INTEGER) OVER {_UP} AS gd FROM k0),
st AS (SELECT * EXCLUDE (up, dn, gu, gd), (sum(up::INTEGER) OVER (PARTITION BY symbol, gu ORDER BY ts) - sum(dn::INTEGER) OVER (PARTITION BY symbol, gd ORDER BY ts))::DOUBLE AS k FROM k1)"""
    first = _with_rsi(3, streaks, "st") + ", st2 AS (SELECT * EXCLUDE (x, close, k), x AS x3, close AS cl0, k AS close FROM rs)"
    again = re.sub(r"\b(g|h|rr|rs|src_rr|rec_rr)\b", r"\g<1>2", _with_rsi(2, "", "st2"))
    return first + again


_CONNORS = _connors()
ORACLE_SQL = {
    "ta_more_kernels": f"""{_FIRST}, n AS (SELECT *, row_number() OVER w::DOUBLE AS i, greatest(0, high - {_PREV}) + 0 * {_PREV} AS hp, greatest(0, {_PREV} - low) + 0 * {_PREV} AS pl, {_PREV} AS pc FROM bars {_W}),
t AS (SELECT *, {_roll("corr($, i)", "close", 12)} AS r, {_roll("regr_slope($, i)", "close", 14)} AS m, 100 * (close - {_LO(14)}) / CASE WHEN {_HI(14)} = {_LO(14)} THEN {_EPS} ELSE {_HI(14)} - {_LO(14)} END AS fk FROM n) """
    + _select([
        _r(f"-({_kernel('close', [float(k + 1) for k in range(10)])} * 55) / {_roll('sum', 'close', 10)}", "CG_10", 4), _r("r", "CTI_12", 4), _r("degrees(atan(m))", "LRa_14", 4), _r("2 * (high - low) + abs(open - pc) - abs(close - open)", "PDIST", 4),
        _r("fk", "STOCHFk_14_3", 4), _r(_AVG("fk", 3), "STOCHFd_14_3", 4), _r(f"100 * {_roll('sum', '(high - open)', 26)} / nullif({_roll('sum', '(open - low)', 26)}, 0)", "AR_26", 4), _r(f"100 * {_roll('sum', 'hp', 26)} / nullif({_roll('sum', 'pl', 26)}, 0)", "BR_26", 4),
    ], "t"),
    "ta_more_volume": f"""{_FIRST}, t AS (SELECT *, ((high + low) / 2 - lag((high + low) / 2) OVER w) / nullif(volume / 1.0::DOUBLE / CASE WHEN high = low THEN {_EPS} ELSE high - low END, 0) AS e, coalesce(100 * (close - {_PREV}) / nullif({_PREV}, 0), 0) AS g, volume - lag(volume) OVER w AS dv,
  sign(close - {_PREV}) * abs(close - {_PREV}) * volume AS cv, (high + low + close) / 3 AS tp, date_trunc('month', ts) AS mo FROM bars {_W}),
u AS (SELECT *, {_roll("sum", "cv", 18)} AS tsv, sum(tp * volume) OVER a / nullif(sum(volume) OVER a, 0) AS vw FROM t WINDOW a AS (PARTITION BY symbol, mo ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, sqrt(sum(volume * (tp - vw) ** 2) OVER a / nullif(sum(volume) OVER a, 0)) AS sd FROM u WINDOW a AS (PARTITION BY symbol, mo ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) """
    + _select([
        _r(_AVG("e", 14), "EOM_14", 2), _r(f"1000 + sum(CASE WHEN dv < 0 THEN g ELSE 0 END) OVER {_UP}", "NVI", 2), _r(f"1000 + sum(CASE WHEN dv > 0 THEN g ELSE 0 END) OVER {_UP}", "PVI", 2), _r(f"(volume - {_AVG('volume', 60)}) / nullif({_roll('stddev_pop', 'volume', 60)}, 0)", "VHM_60", 2),
        _r("tsv", "TSV_18", 2), _r(_AVG("tsv", 10), "TSVs_18", 2), _r(f"tsv / nullif({_AVG('tsv', 10)}, 0)", "TSVr_18", 2), _r("vw", "VWAP", 2), _r("vw - sd", "VWAP_L_1", 2), _r("vw + sd", "VWAP_U_1", 2), _r("vw - 2 * sd", "VWAP_L_2", 2), _r("vw + 2 * sd", "VWAP_U_2", 2),
    ], "v"),
    "ta_volume_profile": _FIRST + _PROFILE.format(bin="ntile(10) OVER w - 1"),
    "ta_volume_profile_price": _FIRST + _PROFILE.format(bin="least(9, floor((close - min(close) OVER (PARTITION BY symbol)) / nullif(max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol), 0) * 10))"),
    "ta_more_flags": f"""{_FIRST}, t0 AS (SELECT *, coalesce(close < {_lag("close", 4)}, false) AS fell, coalesce(close > {_lag("close", 4)}, false) AS rose, low - {_lag("high", 2)} AS bi, {_lag("low", 2)} - high AS ti, nullif({_HI(14)} - {_LO(14)}, 0) AS s FROM bars {_W}),
t1 AS (SELECT *, sum((NOT fell)::INTEGER) OVER {_UP} AS gf, sum((NOT rose)::INTEGER) OVER {_UP} AS gr FROM t0), t AS (SELECT *, sum(fell::INTEGER) OVER (PARTITION BY symbol, gf ORDER BY ts) AS dn, sum(rose::INTEGER) OVER (PARTITION BY symbol, gr ORDER BY ts) AS up FROM t1) """
    + _select([
        'CASE WHEN dn BETWEEN 6 AND 9 THEN dn ELSE 0 END::INTEGER AS "EXHCd_4"', 'CASE WHEN up BETWEEN 6 AND 9 THEN up ELSE 0 END::INTEGER AS "EXHCu_4"', _r("bi", "SMCbi"), _r("ti", "SMCti"), _r("100 * bi / s", "SMCbp"), _r("100 * ti / s", "SMCtp"),
        f'coalesce(high - low > 1.5::DOUBLE * {_AVG("(high - low)", 20)}, false)::INTEGER AS "SMChv"', 'coalesce(bi > 0 AND 100 * bi / s > 1, false)::INTEGER AS "SMCbf"', 'coalesce(ti > 0 AND 100 * ti / s > 1, false)::INTEGER AS "SMCtf"',
        *(_r(f"({x} - {_AVG(x, 30)}) / nullif({_roll('stddev_samp', x, 30)}, 0)", f"{x}_Z_30") for x in ("open", "high", "low", "close")),
    ], "t"),
    "ta_transforms": f"""{_FIRST}, n AS (SELECT *, row_number() OVER w - 1 AS i, {_AVG("close", 20)} AS m, min(close) OVER (PARTITION BY symbol) AS lo, max(close) OVER (PARTITION BY symbol) AS hi FROM bars {_W}),
f AS (SELECT symbol, regr_slope(close, i) AS b, regr_intercept(close, i) AS a, stddev_samp(close) AS sd FROM n GROUP BY 1), t AS (SELECT n.*, a + b * i AS lr, sd, exp(CASE WHEN lo >= -1 AND hi <= 1 THEN close ELSE 2 * (close - lo) / nullif(hi - lo, 0) - 1 END) AS x FROM n JOIN f USING (symbol)) """
    + _select([
        _r(f"close - {_lag('m', 11)}", "DPO_20", 2), _r("-1 + 2.0::DOUBLE / 100 * close", "REMAP", 2), _r("pow(close, 2)", "CUBE_2", 2), _r(f"{_lag('pow(close, 2)', 1)}", "CUBEs_2", 2), _r("(x - 1) / (x + 1)", "INVFISHER", 2),
        _r("lr", "TOS_LR", 2), *(_r(f"lr {s} {k} * sd", f"TOS_{side}_{k}", 2) for k in (1, 2) for side, s in (("L", "-"), ("U", "+"))),
    ], "t"),
    "ta_detrended_lookahead": f"{_FIRST}, t0 AS (SELECT *, {_AVG('close', 20)} AS m FROM bars), t AS (SELECT *, {_lag('close', 11)} - m AS x FROM t0 {_W}) " + _select([_r("lead(x, 11) OVER w", "DPO_20")], "t"),
    "ta_percent_rank": f"""{_FIRST}, r AS (SELECT *, close / nullif({_PREV}, 0) - 1 AS r FROM bars {_W}), l AS (SELECT *, list(r) FILTER (WHERE r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS v FROM r)
SELECT symbol, ts, round(CASE WHEN len(v) = 100 THEN 100.0::DOUBLE * len(list_filter(v, lambda x: x < r)) / 100 END, 6) AS "PRANK_100" FROM l""",
    "ta_pivots_classic": _pivot_sql("(h + l + c) / 3", {"S1": "2 * p - h", "S2": "p - (h - l)", "S3": "p - 2 * (h - l)", "S4": "p - 3 * (h - l)", "R1": "2 * p - l", "R2": "p + (h - l)", "R3": "p + 2 * (h - l)", "R4": "p + 3 * (h - l)"}),
    "ta_pivots_woodie": _pivot_sql("(2 * now_ + h + l) / 4", {"S1": "2 * p - h", "S2": "p - (h - l)", "S3": "l - 2 * (h - p)", "R1": "2 * p - l", "R2": "p + (h - l)", "R3": "h + 2 * (p - l)"}),
    "ta_pivots_demark": _pivot_sql("CASE WHEN o = c THEN (h + l + 2 * c) / 4 WHEN c > o THEN (2 * h + l + c) / 4 ELSE (h + 2 * l + c) / 4 END", {"S1": "2 * p - h", "R1": "2 * p - l"}),
    "ta_crosses": f"""{_FIRST}, t0 AS (SELECT *, (close > {_AVG("close", 10)})::INTEGER AS a, (close < {_AVG("close", 10)})::INTEGER AS b FROM bars), t AS (SELECT *, coalesce(a, 0) AS tr FROM t0)
SELECT symbol, ts, coalesce(a, 0) AS "X_above", coalesce(a = 1 AND lag(a) OVER w = 0, false)::INTEGER AS "X_over", coalesce(b = 1 AND lag(b) OVER w = 0, false)::INTEGER AS "X_under", tr AS "TS_Trends", coalesce(tr - lag(tr) OVER w, 0) AS "TS_Trades",
       (coalesce(tr - lag(tr) OVER w, 0) > 0)::INTEGER AS "TS_Entries", (coalesce(tr - lag(tr) OVER w, 0) < 0)::INTEGER AS "TS_Exits" FROM t {_W}""",
    "ta_smoothed": _recursive(_REC, "bars", [("s7", "close", 1 / 7, 7, "sma"), ("j", "close", 1 / 13, 13, "sma"), ("t", "close", 1 / 8, 8, "sma"), ("l", "close", 1 / 5, 5, "sma")], "a") + f" SELECT symbol, ts, {_r('s7', 'SMMA_7')}, {_r('j', 'AGj')}, {_r('t', 'AGt')}, {_r('l', 'AGl')} FROM a",
    "ta_t3": _chain(6, 10) + f" SELECT symbol, ts, {_r(' + '.join(f'{w!r}::DOUBLE * e{k}' for w, k in zip(_T3, (3, 4, 5, 6), strict=True)), 'T3_10')} FROM h6",
    "ta_zero_lag": _EWMS(f"{_REC}, z AS (SELECT *, 2 * close - {_lag('close', 4)} AS x FROM bars {_W})", "z", "a", ("y", "x", 10)) + f" SELECT symbol, ts, {_r('y', 'ZL_EMA_10')} FROM a",
    "ta_ppo": _restart(f"{_REC}, p AS (SELECT *, 100 * ({_AVG('close', 12)} - {_AVG('close', 26)}) / nullif({_AVG('close', 26)}, 0) AS v FROM bars)", "p", "v", 9, "sg", "q") + f" SELECT symbol, ts, {_r('v', 'PPO_12_26')}, {_r('sg', 'PPOs_12_26')}, {_r('v - sg', 'PPOh_12_26')} FROM q",
    "ta_tsi": _strength("TSI", 13, 25, 13) + f" SELECT symbol, ts, {_r('v', 'TSI_13_25')}, {_r('sg', 'TSIs_13_25')} FROM d4",
    "ta_smi": _strength("SMI", 5, 20, 5) + f" SELECT symbol, ts, {_r('v', 'SMI_5_20')}, {_r('sg', 'SMIs_5_20')}, {_r('v - sg', 'SMIo_5_20')} FROM d4",
    "ta_pretty_good": _EWMS(_with_atr(14), "a", "b", ("e", "atr", 14)) + f" SELECT symbol, ts, {_r(f'(close - {_AVG("close", 14)}) / nullif(e, 0)', 'PGO_14')} FROM b",
    "ta_elder_ray": _EWMS(_REC, "bars", "a", ("e", "close", 13)) + f" SELECT symbol, ts, {_r('high - e', 'ERIbull_13')}, {_r('low - e', 'ERIbear_13')} FROM a",
    "ta_kdj": _numbered(f"{_REC}, kk AS (SELECT *, 100 * (close - {_LO(9)}) / CASE WHEN {_HI(9)} = {_LO(9)} THEN {_EPS} ELSE {_HI(9)} - {_LO(9)} END AS f FROM bars)", "kk")
    + f""", r AS (SELECT symbol, i, NULL::DOUBLE AS k, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0 AS n, NULL::DOUBLE AS d, 0.0::DOUBLE AS u2, 0.0::DOUBLE AS v2, 0 AS n2 FROM nb WHERE i = 1
  UNION ALL SELECT symbol, i, k, u, v, n, CASE WHEN n2 >= 3 THEN u2 / v2 END, u2, v2, n2 FROM (
    SELECT *, CASE WHEN k IS NULL THEN pu2 * {2 / 3!r} ELSE pu2 * {2 / 3!r}::DOUBLE + k END AS u2, CASE WHEN k IS NULL THEN pv2 * {2 / 3!r} ELSE pv2 * {2 / 3!r}::DOUBLE + 1 END AS v2, pn2 + (k IS NOT NULL)::INTEGER AS n2 FROM (
      SELECT symbol, i, u, v, n, pu2, pv2, pn2, CASE WHEN n >= 3 THEN u / v END AS k FROM (
        SELECT nb.symbol, nb.i, r.u * {2 / 3!r}::DOUBLE + coalesce(nb.f, 0) AS u, r.v * {2 / 3!r}::DOUBLE + (nb.f IS NOT NULL)::INTEGER AS v, r.n + (nb.f IS NOT NULL)::INTEGER AS n, r.u2 AS pu2, r.v2 AS pv2, r.n2 AS pn2 FROM r JOIN nb ON nb.symbol = r.symbol AND nb.i = r.i + 1))))
SELECT nb.symbol, ts, {_r("k", "K_9")}, {_r("d", "D_9")}, {_r("3 * k - 2 * d", "J_9")} FROM nb JOIN r USING (symbol, i)""",
    "ta_stoch_rsi": _with_rsi(14) + f", s0 AS (SELECT *, 100 * (x - {_roll('min', 'x', 14)}) / CASE WHEN {_roll('max', 'x', 14)} = {_roll('min', 'x', 14)} THEN {_EPS} ELSE {_roll('max', 'x', 14)} - {_roll('min', 'x', 14)} END AS s FROM rs), s1 AS (SELECT *, {_AVG('s', 3)} AS k FROM s0) SELECT symbol, ts, {_r('k', 'STOCHRSIk_14', 4)}, {_r(_AVG('k', 3), 'STOCHRSId_14', 4)} FROM s1",
    "ta_connors_rsi": _CONNORS
    + f", cr AS (SELECT *, cl0 / nullif(lag(cl0) OVER w, 0) - 1 AS r FROM rs2 {_W}), cv AS (SELECT *, list(r) FILTER (WHERE r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS v FROM cr) SELECT symbol, ts, {_r('(x3 + x + CASE WHEN len(v) = 100 THEN 100.0::DOUBLE * len(list_filter(v, lambda y: y < r)) / 100 END) / 3', 'CRSI_3_2_100', 4)} FROM cv",
    "ta_inertia": _RVI + f", i0 AS (SELECT *, 100 * ep / nullif(ep + en, 0) AS v, row_number() OVER w::DOUBLE AS i FROM v2 {_W}) SELECT symbol, ts, {_r(_roll('regr_intercept($, i)', 'v', 20) + ' + i * ' + _roll('regr_slope($, i)', 'v', 20), 'INERTIA_20_14', 4)} FROM i0",
    "ta_thermometer": _EWMS(f"{_REC}, t0 AS (SELECT *, greatest(abs(low - lag(low) OVER w), abs(high - lag(high) OVER w)) AS t FROM bars {_W})", "t0", "a", ("m", "t", 20)) + f" SELECT symbol, ts, {_r('m', 'THERMOma_20')}, {_r('t', 'THERMO_20')}, coalesce(t < 2 * m, false)::INTEGER AS \"THERMOl_20\", coalesce(t > 0.5::DOUBLE * m, false)::INTEGER AS \"THERMOs_20\" FROM a",
    "ta_aberration": _with_atr(15) + f", b AS (SELECT *, {_AVG('((high + low + close) / 3)', 5)} AS z FROM a) SELECT symbol, ts, {_r('z', 'ABER_ZG_5')}, {_r('z + atr', 'ABER_SG_5')}, {_r('z - atr', 'ABER_XG_5')} FROM b",
    "ta_chandelier": _with_atr(14)
    + f""", b AS (SELECT *, max(high) OVER v - 2 * atr AS l, min(low) OVER v + 2 * atr AS s, row_number() OVER w AS i FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts), v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, coalesce(close > lag(l) OVER w, false)::INTEGER - coalesce(close < lag(s) OVER w, false)::INTEGER AS xx FROM b {_W}), e AS (SELECT *, CASE WHEN i = 1 AND xx = 0 THEN 1 WHEN xx <> 0 THEN xx END AS y FROM d)
SELECT symbol, ts, {_r("l", "CHDLREXTl")}, {_r("s", "CHDLREXTs")}, last_value(y IGNORE NULLS) OVER {_UP} AS "CHDLREXTd" FROM e""",
    "ta_kroll": _with_atr(10) + f", b AS (SELECT *, {_HI(10)} - 3 * atr AS l, {_LO(10)} + 3 * atr AS s FROM a) SELECT symbol, ts, {_r(_roll('max', 'l', 20), 'CKSPl_10')}, {_r(_roll('min', 's', 20), 'CKSPs_10')} FROM b",
    "ta_squeeze": f"{_FIRST}, {_TR}, b AS (SELECT *, 2 * {_roll('stddev_pop', 'close', 20)} AS d, {_AVG('tr', 20)} AS wd, close - {_lag('close', 12)} AS mo FROM tr {_W}) SELECT symbol, ts, {_r(_AVG('mo', 6), 'SQZ')}, "
    + ", ".join(f'coalesce(d < {x} * wd, false)::INTEGER AS "SQZ_ON_{x:g}", coalesce(d > {x} * wd, false)::INTEGER AS "SQZ_OFF_{x:g}", 1 - coalesce(d < {x} * wd, false)::INTEGER - coalesce(d > {x} * wd, false)::INTEGER AS "SQZ_NO_{x:g}"' for x in (2.0, 1.5, 1.0)) + " FROM b",
    "ta_archer": _EWMS(_REC, "bars", "a", ("f", "close", 8), ("s", "close", 21)) + f", b AS (SELECT *, {_runs('f', 's', 2)} FROM a {_W}) SELECT symbol, ts, lr AS \"AMATl_8_21\", sr AS \"AMATs_8_21\" FROM b",
    "ta_random_walk": _with_atr(14) + f" SELECT symbol, ts, {_r(f'(high - {_lag("low", 14)}) / nullif(atr * {math.sqrt(14)!r}::DOUBLE, 0)', 'RWIh_14')}, {_r(f'({_lag("high", 14)} - low) / nullif(atr * {math.sqrt(14)!r}::DOUBLE, 0)', 'RWIl_14')} FROM a {_W}",
    "ta_klinger": _restart(_EWMS(f"{_REC}, k0 AS (SELECT *, coalesce(sign((high + low + close) / 3 - lag((high + low + close) / 3) OVER w), -1) * volume AS v FROM bars {_W})", "k0", "a", ("f", "v", 34), ("s", "v", 55)) + ", b AS (SELECT *, f - s AS k FROM a)", "b", "k", 13, "sg", "q") + f" SELECT symbol, ts, {_r('k', 'KVO_34_55', 4)}, {_r('sg', 'KVOs_34_55', 4)} FROM q",
    "ta_archer_volume": _EWMS(f"{_REC}, g0 AS (SELECT *, coalesce(sign(close - {_PREV}), 1) * volume AS g FROM bars {_W}), g1 AS (SELECT *, sum(g) OVER {_UP} AS o FROM g0)", "g1", "a", ("f", "o", 4), ("s", "o", 12)) + f", b AS (SELECT *, {_runs('f', 's', 2)} FROM a {_W}) SELECT symbol, ts, {_r('f', 'AOBVf_4', 4)}, {_r('s', 'AOBVs_12', 4)}, lr AS \"AOBVl_2\", sr AS \"AOBVd_2\" FROM b",
    "ta_true_momentum": _EWMS(_EWMS(_EWMS(f"{_REC}, t0 AS (SELECT *, {' + '.join(f'sign(close - {_lag("open", k)})' for k in range(1, 14))} AS t FROM bars {_W})", "t0", "a", ("x", "t", 5)), "a", "b", ("y", "x", 3)), "b", "d", ("z", "y", 3)) + f" SELECT symbol, ts, {_r('y', 'TMO_14')}, {_r('z', 'TMOs_14')} FROM d",
    "ta_vidya": _numbered(f"{_REC}, d0 AS (SELECT *, close - {_PREV} AS d FROM bars {_W}), d1 AS (SELECT *, {_SIDES('d')} AS u, {_SIDES('(-d)')} AS n FROM d0), d2 AS (SELECT *, {_roll('sum', 'u', 14)} AS su, {_roll('sum', 'n', 14)} AS sn FROM d1), d3 AS (SELECT *, coalesce(abs((su - sn) / nullif(su + sn, 0)), 0) * {2 / 15!r}::DOUBLE AS k FROM d2)", "d3")
    + f", r AS (SELECT symbol, i, 0.0::DOUBLE AS y FROM nb WHERE i = 14 UNION ALL SELECT nb.symbol, nb.i, nb.k * nb.close + (1 - nb.k) * r.y FROM r JOIN nb ON nb.symbol = r.symbol AND nb.i = r.i + 1) SELECT nb.symbol, ts, {_r('CASE WHEN nb.i > 14 THEN y END', 'VIDYA_14')} FROM nb LEFT JOIN r USING (symbol, i)",
    "ta_hilo": f"""{_FIRST}, m AS (SELECT *, {_AVG("high", 13)} AS h, {_AVG("low", 21)} AS l FROM bars), n AS (SELECT *, CASE WHEN close > lag(h) OVER w THEN 1 WHEN close < lag(l) OVER w THEN 2 ELSE 0 END AS z FROM m {_W}),
g AS (SELECT *, sum((z > 0)::INTEGER) OVER {_UP} AS g FROM n) SELECT symbol, ts, {_r("first_value(CASE z WHEN 1 THEN l WHEN 2 THEN h END) OVER (PARTITION BY symbol, g ORDER BY ts)", "HILO_13_21")} FROM g""",
    "ta_mcginley": f"{_FIRST} " + _select([_r(f"{_PREV} + (close - {_PREV}) / nullif(1e10::DOUBLE * pow(close / nullif({_PREV}, 0), 4), 0)", "MCGD_10", 4)]),
    "ta_fisher": _numbered(f"{_REC}, f0 AS (SELECT *, (high + low) / 2 AS m FROM bars), f1 AS (SELECT *, (m - {_roll('min', 'm', 9)}) / greatest(0.001::DOUBLE, {_roll('max', 'm', 9)} - {_roll('min', 'm', 9)}) - 0.5::DOUBLE AS p FROM f0)", "f1")
    + f""", r AS (SELECT symbol, i, 0.0::DOUBLE AS v, 0.0::DOUBLE AS y FROM nb WHERE i = 9
  UNION ALL SELECT symbol, i, v, 0.5::DOUBLE * (ln((1 + v) / (1 - v)) + y) FROM (SELECT symbol, i, y, CASE WHEN q < -0.99 THEN -0.999::DOUBLE WHEN q > 0.99 THEN 0.999::DOUBLE ELSE q END AS v FROM (SELECT nb.symbol, nb.i, r.y, 0.66::DOUBLE * nb.p + 0.67::DOUBLE * r.v AS q FROM r JOIN nb ON nb.symbol = r.symbol AND nb.i = r.i + 1))),
z AS (SELECT nb.symbol, ts, y FROM nb LEFT JOIN r USING (symbol, i)) SELECT symbol, ts, {_r("y", "FISHERT_9")}, {_r("lag(y) OVER w", "FISHERTs_9")} FROM z {_W}""",
    "ta_holt_winter": _numbered(_REC, "bars")
    + f""", r AS (SELECT symbol, i, close AS f, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a, 0.0::DOUBLE AS va, close AS x, close AS o, 0.0::DOUBLE AS wd FROM nb WHERE i = 1
  UNION ALL SELECT symbol, i, f1, v1, 0.9::DOUBLE * a + 0.1::DOUBLE * (v1 - v), 0.9::DOUBLE * va + 0.1::DOUBLE * (x - o) ** 2, close, f1 + v1 + 0.5::DOUBLE * (0.9::DOUBLE * a + 0.1::DOUBLE * (v1 - v)), sqrt(va) FROM (
    SELECT *, 0.9::DOUBLE * (v + a) + 0.1::DOUBLE * (f1 - f) AS v1 FROM (SELECT nb.symbol, nb.i, nb.close, r.f, r.v, r.a, r.va, r.x, r.o, 0.8::DOUBLE * (r.f + r.v + 0.5::DOUBLE * r.a) + 0.2::DOUBLE * nb.close AS f1 FROM r JOIN nb ON nb.symbol = r.symbol AND nb.i = r.i + 1)))
SELECT nb.symbol, ts, {_r("o", "HWMA", 4)}, {_r("o - wd", "HWL", 4)}, {_r("o + wd", "HWU", 4)} FROM nb JOIN r USING (symbol, i)""",
    "ta_super_smoother": _numbered(_REC, "bars")
    + f""", r AS (SELECT symbol, i, close AS x, close AS y, 0.0::DOUBLE AS y1, close AS z, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2 FROM nb WHERE i = 1
  UNION ALL SELECT nb.symbol, nb.i, nb.close, CASE WHEN nb.i <= 2 THEN nb.close ELSE {0.5 * (_A2 * _A2 - _B2 + 1)!r}::DOUBLE * (nb.close + r.x) + {_B2!r}::DOUBLE * r.y - {_A2 * _A2!r}::DOUBLE * r.y1 END, r.y,
    CASE WHEN nb.i <= 3 THEN nb.close ELSE {1 - _D2 - _D3 - _D4!r}::DOUBLE * nb.close + {_D2!r}::DOUBLE * r.z + {_D3!r}::DOUBLE * r.z1 + {_D4!r}::DOUBLE * r.z2 END, r.z, r.z1 FROM r JOIN nb ON nb.symbol = r.symbol AND nb.i = r.i + 1)
SELECT nb.symbol, ts, {_r("y", "SSF_20", 4)}, {_r("z", "SSF3_20", 4)} FROM nb JOIN r USING (symbol, i)""",
    "ta_decay": _numbered(_REC, "bars")
    + f""", r AS (SELECT symbol, i, close AS l, close AS e FROM nb WHERE i = 1 UNION ALL SELECT nb.symbol, nb.i, greatest(nb.close, r.l - 0.2::DOUBLE, 0.0::DOUBLE), greatest(nb.close, r.e - {1 - math.exp(-5)!r}::DOUBLE, 0.0::DOUBLE) FROM r JOIN nb ON nb.symbol = r.symbol AND nb.i = r.i + 1)
SELECT nb.symbol, ts, {_r("l", "LDECAY_5")}, {_r("e", "EXPDECAY_5")} FROM nb JOIN r USING (symbol, i)""",
    "ta_qqe": _numbered(
        _EWMS(_EWMS(_EWMS(_with_rsi(14), "rs", "q1", ("m", "x", 5)) + f", q2 AS (SELECT *, abs(m - lag(m) OVER w) AS t FROM q1 {_W})", "q2", "q3", ("s", "t", 27)), "q3", "q4", ("v", "s", 27)) + ", q5 AS (SELECT *, 4.236::DOUBLE * v AS wd FROM q4)", "q5",
    )
    + f""", r AS (SELECT symbol, i, NULL::DOUBLE AS x, NULL::DOUBLE AS l, NULL::DOUBLE AS s, NULL::DOUBLE AS l1, NULL::DOUBLE AS s1, 1 AS side, NULL::DOUBLE AS shown, NULL::INTEGER AS sh FROM nb WHERE i = 1
  UNION ALL SELECT symbol, i, m, CASE WHEN ok THEN nl END, CASE WHEN ok THEN ns END, CASE WHEN ok THEN l END, CASE WHEN ok THEN s END, CASE WHEN ok THEN nside ELSE 1 END, CASE WHEN ok THEN CASE WHEN nside > 0 THEN nl ELSE ns END END, CASE WHEN ok THEN nside END FROM (
    SELECT *, CASE WHEN l IS NULL OR x IS NULL THEN side WHEN m > s AND (s1 IS NULL OR x <= s1) THEN 1 WHEN m < l AND (l1 IS NULL OR x >= l1) THEN -1 ELSE side END AS nside, CASE WHEN x > l AND m > l THEN greatest(m - wd, l) ELSE m - wd END AS nl, CASE WHEN x < s AND m < s THEN least(m + wd, s) ELSE m + wd END AS ns FROM (
      SELECT nb.symbol, nb.i, nb.m, nb.wd, nb.m IS NOT NULL AND nb.wd IS NOT NULL AS ok, r.x, r.l, r.s, r.l1, r.s1, r.side FROM r JOIN nb ON nb.symbol = r.symbol AND nb.i = r.i + 1)))
SELECT nb.symbol, ts, {_r("shown", "QQE_14", 4)}, sh::DOUBLE AS "QQEd_14", {_r("m", "QQEm_14", 4)} FROM nb JOIN r USING (symbol, i)""",
}
