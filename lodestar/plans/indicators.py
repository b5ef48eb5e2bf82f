"""Queries of the technical indicators, and their SQL."""

from __future__ import annotations

import math

from lodestar.operators.indicators import indicators
from lodestar.plans.common import rounded
from lodestar.sources.bridge import BARS_SQL, bars

_OHLCV = ("open", "high", "low", "close", "volume")


def _study(*specs, digits: int = 6):
    return lambda spark, sf_dir: rounded(indicators(bars(spark, sf_dir), list(specs)).drop(*_OHLCV), digits, ("VAR_30", "AD", "OBV", "PVT", "PVOL"))


QUERIES = {
    "ta_averages": _study("sma", "midpoint", "midprice", "trima", "vwma", "qstick", "price_mixes"),
    "ta_kernels": _study("wma", "hma", "fwma", "pwma", "sinwma", "swma", "alma", "coppock"),
    "ta_statistics": _study("rolling_median", "rolling_quantile", "variance", "stdev", "zscore", "skew", "kurtosis", "mad", "entropy", digits=4),
    "ta_linreg": _study("linreg", digits=4),
    "ta_momentum": _study("momentum", "bias", "change", "efficiency", "awesome", "apo"),
    "ta_oscillators": _study("willr", "stoch", "psl", "ultimate", "cci", "bop"),
    "ta_trend": _study("donchian", "vhf", "aroon", "vortex", "ichimoku"),
    "ta_range": _study("true_range", "bbands", "accbands", "ulcer"),
    "ta_volume": _study("volume_lines", "cmf", "mfi", digits=4),
    "ta_flags": _study("flags"),
    "ta_pivots": _study("pivots"),
    "ta_ema": _study("ema", "rma", "dema", "tema"),
    "ta_macd": _study("macd"),
    "ta_rsi": _study("rsi"),
    "ta_atr": _study("atr"),
    "ta_adx": _study("adx"),
    "ta_keltner": _study("keltner"),
    "ta_heikin_ashi": _study("heikin_ashi"),
    "ta_kama": _study("kama"),
    "ta_supertrend": _study("supertrend"),
    "ta_cycles": _study("ttm_trend", "kst", "rvgi", "cmo", "chop"),
    "ta_volume_ewm": _study("price_volume_ewm", digits=2),
    "ta_trix": _study("trix"),
    "ta_mass_index": _study("mass_index"),
    "ta_psar": _study("psar"),
}


def _roll(fn: str, x: str, n: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    call = fn.replace("$", x) if "$" in fn else f"{fn}({x})"
    return f"(CASE WHEN count({x}) {frame} = {n} THEN {call} {frame} END)"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER w" if k else x


def _kernel(x: str, weights: list[float]) -> str:
    n = len(weights)
    return "((" + " + ".join(f"({_lag(x, n - 1 - k)}) * {v!r}::DOUBLE" for k, v in enumerate(weights)) + f") / {math.fsum(weights)!r}::DOUBLE)"


def _r(x: str, name: str, digits: int = 6) -> str:
    return f'round({x}, {digits}) AS "{name}"'


_W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
_FIRST = f"WITH {BARS_SQL}"
_EPS = "2.220446049250313e-16::DOUBLE"


def _select(columns: list[str], source: str = "bars") -> str:
    return "SELECT symbol, ts, " + ", ".join(columns) + f" FROM {source} {_W}"


_SIN = [math.sin((i + 1) * math.pi / 15) for i in range(14)]
_ALMA = [math.exp(-((i - 0.85 * 8) ** 2) / (2 * 1.5 * 1.5)) for i in range(9)]
_RAMP = lambda n: [float(i + 1) for i in range(n)]
_SHARE = f"((2 * close - high - low) / CASE WHEN high = low THEN {_EPS} ELSE high - low END)"
_DAY1 = "sum({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _recursive(setup: str, source: str, specs: list[tuple[str, str, float, int, str]], output: str) -> str:
    """SQL of exponential means over ``source``, one recursion for all of them."""
    pre = ", ".join(f"count({x}) OVER u AS c{k}, avg({x}) OVER u AS m{k}" for k, (_, x, _, _, _) in enumerate(specs))
    init, step, show = [], [], []
    for k, (name, x, alpha, n, seed) in enumerate(specs):
        a = f"{alpha!r}::DOUBLE"
        if seed == "sma":
            init.append(f"CASE WHEN {n} = 1 THEN m{k} END AS y{k}")
            step.append(f"CASE WHEN s.i < {n} THEN NULL WHEN s.i = {n} THEN s.m{k} WHEN s.{x} IS NULL THEN rec.y{k} WHEN rec.y{k} IS NULL THEN s.{x} ELSE {a} * s.{x} + (1 - {a}) * rec.y{k} END")
            show.append(f"CASE WHEN s.i >= {n} AND c{k} > 0 THEN y{k} END AS {name}")
        else:
            init.append(f"{x} AS y{k}")
            step.append(f"CASE WHEN s.{x} IS NULL THEN rec.y{k} WHEN rec.y{k} IS NULL THEN s.{x} ELSE {a} * s.{x} + (1 - {a}) * rec.y{k} END")
            show.append(f"CASE WHEN c{k} >= {n} THEN y{k} END AS {name}")
    return f"""{setup},
src_{output} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, {pre} FROM {source} WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rec_{output} AS (
  SELECT symbol, i, {", ".join(init)} FROM src_{output} WHERE i = 1
  UNION ALL
  SELECT s.symbol, s.i, {", ".join(step)} FROM rec_{output} rec JOIN src_{output} s ON s.symbol = rec.symbol AND s.i = rec.i + 1),
{output} AS (SELECT s.* EXCLUDE (i, {", ".join(f"c{k}, m{k}" for k in range(len(specs)))}), {", ".join(show)} FROM src_{output} s JOIN rec_{output} r ON r.symbol = s.symbol AND r.i = s.i)"""


_REC = f"WITH RECURSIVE {BARS_SQL}"
_TRUE = "CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"
_TR = f"tr AS (SELECT *, {_TRUE} AS tr FROM bars {_W})"
_ATR_X = """tr2 AS (SELECT *, count(tr) OVER u AS n_, avg(tr) OVER u AS a_ FROM tr WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tr3 AS (SELECT * EXCLUDE (n_, a_), CASE WHEN n_ = {n} THEN a_ WHEN n_ > {n} THEN tr END AS x FROM tr2)"""


def _atr(n: int) -> str:
    return _recursive(f"{_REC}, {_TR}, {_ATR_X.format(n=n)}", "tr3", [("atr", "x", 1 / n, 1, "first")], "a")


_PIVOT = """p AS (SELECT symbol, date_trunc('month', ts) AS m, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
q AS (SELECT symbol, m, lag(h) OVER v AS h, lag(l) OVER v AS l, lag(c) OVER v AS c FROM p WINDOW v AS (PARTITION BY symbol ORDER BY m))"""

ORACLE_SQL = {
    "ta_averages": f"{_FIRST}, t AS (SELECT *, {_roll('avg', 'close', 6)} AS half FROM bars) "
    + _select(
        [
            _r(_roll("avg", "close", 10), "SMA_10"),
            _r(f"({_roll('min', 'close', 2)} + {_roll('max', 'close', 2)}) / 2", "MIDPOINT_2"),
            _r(f"({_roll('min', 'low', 2)} + {_roll('max', 'high', 2)}) / 2", "MIDPRICE_2"),
            _r(_roll("avg", "half", 6), "TRIMA_10"),
            _r(f"{_roll('avg', '(close * volume)', 10)} / {_roll('avg', 'volume', 10)}", "VWMA_10"),
            _r(_roll("avg", "(close - open)", 10), "QS_10"),
            _r("(high + low) / 2", "HL2"), _r("(high + low + close) / 3", "HLC3"), _r("(open + high + low + close) / 4", "OHLC4"), _r("(high + low + close * 2) / 4", "WCP"),
        ],
        "t",
    ),
    "ta_kernels": f"{_FIRST}, t AS (SELECT *, 2 * {_kernel('close', _RAMP(5))} - {_kernel('close', _RAMP(10))} AS d, ((close - {_lag('close', 11)}) / {_lag('close', 11)} + (close - {_lag('close', 14)}) / {_lag('close', 14)}) * 100 AS s FROM bars {_W}) "
    + _select(
        [
            _r(_kernel("close", _RAMP(10)), "WMA_10"), _r(_kernel("d", _RAMP(3)), "HMA_10"), _r(_kernel("close", [1.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 55.0]), "FWMA_10"),
            _r(_kernel("close", [float(math.comb(9, i)) for i in range(10)]), "PWMA_10"), _r(_kernel("close", _SIN), "SINWMA_14"), _r(_kernel("close", [1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 4.0, 3.0, 2.0, 1.0]), "SWMA_10"),
            _r(_kernel("close", _ALMA), "ALMA_9"), _r(_kernel("s", _RAMP(10)), "COPC_11_14_10"),
        ],
        "t",
    ),
    "ta_statistics": f"{_FIRST}, t AS (SELECT *, -(close / sum(close) OVER v) * log2(close / sum(close) OVER v) AS p, list(close) OVER v30 AS vs, avg(close) OVER v30 AS vm FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), v30 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) "
    + _select(
        [
            _r(_roll("quantile_cont($, 0.5)", "close", 30), "MEDIAN_30", 4), _r(_roll("quantile_cont($, 0.25)", "close", 30), "QTL_30_25", 4), _r(_roll("var_samp", "close", 30), "VAR_30", 2), _r(_roll("stddev_samp", "close", 30), "STDEV_30", 4),
            _r(f"(close - {_roll('avg', 'close', 30)}) / {_roll('stddev_samp', 'close', 30)}", "ZS_30", 4), _r(_roll("skewness", "close", 30), "SKEW_30", 4), _r(_roll("kurtosis", "close", 30), "KURT_30", 4),
            _r("CASE WHEN len(vs) = 30 THEN list_sum(list_transform(vs, lambda x: abs(x - vm))) / 30 END", "MAD_30", 4), _r(_roll("sum", "p", 10), "ENTP_10", 4),
        ],
        "t",
    ),
    "ta_linreg": f"{_FIRST}, n AS (SELECT *, row_number() OVER w::DOUBLE AS i FROM bars {_W}), t AS (SELECT *, {_roll('regr_slope($, i)', 'close', 14)} AS m, {_roll('regr_intercept($, i)', 'close', 14)} AS b0, {_roll('corr($, i)', 'close', 14)} AS r FROM n) "
    + _select([_r("b0 + m * i", "LR_14", 4), _r("m", "LRm_14", 4), _r("b0 + m * (i - 14)", "LRb_14", 4), _r("r", "LRr_14", 4), _r("b0 + m * (i + 1)", "TSF_14", 4)], "t"),
    "ta_momentum": f"{_FIRST}, t AS (SELECT *, abs(close - lag(close) OVER w) AS d, first(close) OVER w AS f FROM bars {_W}) "
    + _select(
        [
            _r(f"close - {_lag('close', 10)}", "MOM_10"), _r(f"(close - {_lag('close', 10)}) / {_lag('close', 10)} * 100", "ROC_10"), _r(f"close / {_roll('avg', 'close', 26)} - 1", "BIAS_SMA_26"), _r("close - lag(close) OVER w", "SLOPE_1"),
            _r("close / lag(close) OVER w - 1", "PCTRET_1"), _r("ln(close / lag(close) OVER w)", "LOGRET_1"), _r("close / f - 1", "CUMPCTRET"), _r("ln(close / f)", "CUMLOGRET"), _r(f"abs(close - {_lag('close', 10)}) / nullif({_roll('sum', 'd', 10)}, 0)", "ER_10"),
            _r(f"{_roll('avg', '((high + low) / 2)', 5)} - {_roll('avg', '((high + low) / 2)', 34)}", "AO_5_34"), _r(f"{_roll('avg', 'close', 12)} - {_roll('avg', 'close', 26)}", "APO_12_26"),
        ],
        "t",
    ),
    "ta_oscillators": f"""{_FIRST}, t AS (
  SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN close - least(low, lag(close) OVER w) END AS bp, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high, lag(close) OVER w) - least(low, lag(close) OVER w) END AS tr,
         CASE WHEN close > lag(close) OVER w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up, (high + low + close) / 3 AS tp, 100 * (close - {_roll("min", "low", 14)}) / CASE WHEN {_roll("max", "high", 14)} = {_roll("min", "low", 14)} THEN {_EPS} ELSE {_roll("max", "high", 14)} - {_roll("min", "low", 14)} END AS k
  FROM bars {_W}), t2 AS (SELECT *, {_roll("avg", "k", 3)} AS sk, list(tp) OVER v AS vs, avg(tp) OVER v AS vm FROM t WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) """
    + _select(
        [
            _r(f"100 * ((close - {_roll('min', 'low', 14)}) / nullif({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)}, 0) - 1)", "WILLR_14"), _r("sk", "STOCHk_14_3_3"), _r(_roll("avg", "sk", 3), "STOCHd_14_3_3"), _r(f"100 * {_roll('sum', 'up', 12)} / 12", "PSL_12"),
            _r("100 * (" + " + ".join(f"{k} * {_roll('sum', 'bp', n)} / nullif({_roll('sum', 'tr', n)}, 0)" for n, k in ((7, 4), (14, 2), (28, 1))) + ") / 7", "UO_7_14_28"),
            _r("CASE WHEN len(vs) = 14 THEN (tp - vm) / nullif(0.015::DOUBLE * list_sum(list_transform(vs, lambda x: abs(x - vm))) / 14, 0) END", "CCI_14"), _r(f"(close - open) / CASE WHEN high = low THEN {_EPS} ELSE high - low END", "BOP"),
        ],
        "t2",
    ),
    "ta_trend": f"""{_FIRST}, t AS (SELECT *, abs(close - lag(close) OVER w) AS d, row_number() OVER w AS i, {_TRUE} AS tr, abs(high - lag(low) OVER w) AS p, abs(low - lag(high) OVER w) AS q,
  ({_roll("max", "high", 9)} + {_roll("min", "low", 9)}) / 2 AS ts9, ({_roll("max", "high", 26)} + {_roll("min", "low", 26)}) / 2 AS ks, ({_roll("max", "high", 52)} + {_roll("min", "low", 52)}) / 2 AS sb FROM bars {_W}),
t2 AS (SELECT *, CASE WHEN count(high) OVER v = 15 THEN 100 * (1 - (i - arg_max(i, row(high, i)) OVER v) / 14.0::DOUBLE) END AS au, CASE WHEN count(high) OVER v = 15 THEN 100 * (1 - (i - arg_max(i, row(-low, i)) OVER v) / 14.0::DOUBLE) END AS ad FROM t WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) """
    + _select(
        [
            _r(_roll("min", "low", 20), "DCL_20_20"), _r(f"({_roll('min', 'low', 20)} + {_roll('max', 'high', 20)}) / 2", "DCM_20_20"), _r(_roll("max", "high", 20), "DCU_20_20"), _r(f"abs({_roll('max', 'close', 28)} - {_roll('min', 'close', 28)}) / nullif({_roll('sum', 'd', 28)}, 0)", "VHF_28"),
            _r("au", "AROONU_14"), _r("ad", "AROOND_14"), _r("au - ad", "AROONOSC_14"), _r(f"{_roll('sum', 'p', 14)} / nullif({_roll('sum', 'tr', 14)}, 0)", "VTXP_14"), _r(f"{_roll('sum', 'q', 14)} / nullif({_roll('sum', 'tr', 14)}, 0)", "VTXM_14"),
            _r("ts9", "ITS_9"), _r("ks", "IKS_26"), _r(_lag("((ts9 + ks) / 2)", 25), "ISA_9"), _r(_lag("sb", 25), "ISB_26"),
        ],
        "t2",
    ),
    "ta_range": f"{_FIRST}, t AS (SELECT *, {_TRUE} AS tr, 100 * (close / {_roll('max', 'close', 14)} - 1) AS d, 4 * (high - low) / (high + low) AS s, {_roll('avg', 'close', 5)} AS m, {_roll('stddev_pop', 'close', 5)} AS sd FROM bars {_W}) "
    + _select(
        [
            _r("tr", "TRUERANGE"), _r("m - 2 * sd", "BBL_5"), _r("m", "BBM_5"), _r("m + 2 * sd", "BBU_5"), _r("100 * ((m + 2 * sd) - (m - 2 * sd)) / m", "BBB_5"), _r(f"(close - (m - 2 * sd)) / CASE WHEN sd = 0 THEN {_EPS} ELSE (m + 2 * sd) - (m - 2 * sd) END", "BBP_5"),
            _r(_roll("avg", "(low * (1 - s))", 20), "ACCBL_20"), _r(_roll("avg", "close", 20), "ACCBM_20"), _r(_roll("avg", "(high * (1 + s))", 20), "ACCBU_20"), _r(f"sqrt({_roll('sum', '(d * d)', 14)} / 14)", "UI_14"),
        ],
        "t",
    ),
    "ta_volume": f"""{_FIRST}, t AS (
  SELECT *, {_SHARE} * volume AS av, coalesce(sign(close - lag(close) OVER w), 1) * volume AS sv, (close - lag(close) OVER w) / lag(close) OVER w * 100 * volume AS pv, close - lag(close) OVER w AS dc, volume - lag(volume) OVER w AS dv,
         (high + low + close) / 3 AS tp, (high + low + close) / 3 - lag((high + low + close) / 3) OVER w AS dt FROM bars {_W}),
t2 AS (SELECT *, CASE WHEN dt > 0 THEN tp * volume WHEN dt IS NOT NULL THEN 0.0::DOUBLE END AS fu, CASE WHEN dt < 0 THEN tp * volume WHEN dt IS NOT NULL THEN 0.0::DOUBLE END AS fd FROM t) """
    + _select(
        [
            _r(_DAY1.format(x="av"), "AD", 2), _r(_DAY1.format(x="sv"), "OBV", 2), _r(_DAY1.format(x="pv"), "PVT", 2), _r("close * volume", "PVOL", 2),
            'CASE WHEN dc >= 0 AND dv >= 0 THEN 1 WHEN dc >= 0 AND dv < 0 THEN 2 WHEN dc < 0 AND dv >= 0 THEN 3 WHEN dc < 0 AND dv < 0 THEN 4 END AS "PVR"', _r(f"{_roll('sum', 'av', 20)} / {_roll('sum', 'volume', 20)}", "CMF_20", 4),
            _r(f"100 * {_roll('sum', 'fu', 14)} / nullif({_roll('sum', 'fu', 14)} + {_roll('sum', 'fd', 14)}, 0)", "MFI_14", 4),
        ],
        "t2",
    ),
    "ta_flags": f"{_FIRST} "
    + _select(
        [
            'coalesce((close > lag(close) OVER w)::INTEGER, 0) AS "INC_1"', 'coalesce((close < lag(close) OVER w)::INTEGER, 0) AS "DEC_1"', f'coalesce((abs(close - open) < 0.1::DOUBLE * {_roll("avg", "(high - low)", 10)})::INTEGER, 0) AS "CDL_DOJI"',
            'coalesce((high < lag(high) OVER w AND low > lag(low) OVER w)::INTEGER, 0) AS "CDL_INSIDE"', 'CASE WHEN close >= open THEN 1 ELSE -1 END AS "COLOR"',
        ]
    ),
    "ta_pivots": f"""{_FIRST}, {_PIVOT}
SELECT b.symbol, b.ts, {_r("(h + l + c) / 3", "PIVOT")}, {_r("2 * ((h + l + c) / 3) - l", "R1")}, {_r("(h + l + c) / 3 + (h - l)", "R2")}, {_r("2 * ((h + l + c) / 3) - h", "S1")}, {_r("(h + l + c) / 3 - (h - l)", "S2")}
FROM bars b LEFT JOIN q ON q.symbol = b.symbol AND q.m = date_trunc('month', b.ts)""",
    "ta_ema": _recursive(_recursive(_recursive(_REC, "bars", [("e1", "close", 2 / 11, 10, "sma"), ("r1", "close", 0.1, 10, "first")], "a"), "a", [("e2", "e1", 2 / 11, 10, "sma")], "b"), "b", [("e3", "e2", 2 / 11, 10, "sma")], "d")
    + f" SELECT symbol, ts, {_r('e1', 'EMA_10')}, {_r('r1', 'RMA_10')}, {_r('2 * e1 - e2', 'DEMA_10')}, {_r('3 * (e1 - e2) + e3', 'TEMA_10')} FROM d",
    "ta_macd": _recursive(
        _recursive(_REC, "bars", [("f", "close", 2 / 13, 12, "sma"), ("s", "close", 2 / 27, 26, "sma")], "a")
        + """, b AS (SELECT *, f - s AS line, count(f - s) OVER u AS n_, avg(f - s) OVER u AS a_ FROM a WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b2 AS (SELECT * EXCLUDE (n_, a_), CASE WHEN n_ = 9 THEN a_ WHEN n_ > 9 THEN line END AS x FROM b)""",
        "b2", [("sig", "x", 0.2, 1, "first")], "d",
    )
    + f" SELECT symbol, ts, {_r('line', 'MACD_12_26_9')}, {_r('sig', 'MACDs_12_26_9')}, {_r('line - sig', 'MACDh_12_26_9')} FROM d",
    "ta_rsi": _recursive(
        f"{_REC}, g AS (SELECT *, close - lag(close) OVER w AS d FROM bars {_W}), h AS (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0::DOUBLE END AS dn FROM g)",
        "h", [("ru", "up", 1 / 14, 14, "first"), ("rd", "dn", 1 / 14, 14, "first")], "a",
    )
    + f" SELECT symbol, ts, {_r('100 * ru / nullif(ru + rd, 0)', 'RSI_14')} FROM a",
    "ta_atr": _atr(14) + f" SELECT symbol, ts, {_r('atr', 'ATRr_14')}, {_r('100 * atr / close', 'NATR_14')} FROM a",
    "ta_adx": _recursive(
        _recursive(
            _atr(14)
            + f""", g AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM a {_W}),
g2 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0.0::DOUBLE END AS p, CASE WHEN dn > up AND dn > 0 THEN dn WHEN up IS NOT NULL THEN 0.0::DOUBLE END AS q FROM g)""",
            "g2", [("rp", "p", 1 / 14, 14, "first"), ("rq", "q", 1 / 14, 14, "first")], "b",
        )
        + ", b2 AS (SELECT *, 100 * rp / atr AS dmp, 100 * rq / atr AS dmn FROM b), b3 AS (SELECT *, 100 * abs(dmp - dmn) / nullif(dmp + dmn, 0) AS dx FROM b2)",
        "b3", [("adx", "dx", 1 / 14, 14, "first")], "d",
    )
    + f" SELECT symbol, ts, {_r('dmp', 'DMP_14')}, {_r('dmn', 'DMN_14')}, {_r('adx', 'ADX_14')} FROM d",
    "ta_keltner": _recursive(f"{_REC}, {_TR}", "tr", [("b", "close", 2 / 21, 20, "sma"), ("wd", "tr", 2 / 21, 20, "sma")], "a") + f" SELECT symbol, ts, {_r('b - 2 * wd', 'KCL_20')}, {_r('b', 'KCB_20')}, {_r('b + 2 * wd', 'KCU_20')} FROM a",
    "ta_heikin_ashi": f"""{_REC}, n AS MATERIALIZED (SELECT *, (open + high + low + close) / 4 AS hc, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
r AS (SELECT symbol, i, (open + close) / 2 AS ho, hc FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, (r.ho + r.hc) / 2, n.hc FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
SELECT n.symbol, ts, {_r("n.hc", "HA_close")}, {_r("ho", "HA_open")}, {_r("greatest(ho, n.hc, high)", "HA_high")}, {_r("least(ho, n.hc, low)", "HA_low")} FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i""",
    "ta_kama": f"""{_REC}, d AS (SELECT *, abs(close - lag(close) OVER w) AS d, abs(close - {_lag("close", 10)}) AS move, row_number() OVER w AS i FROM bars {_W}),
n AS MATERIALIZED (SELECT *, (coalesce(move / nullif({_roll("sum", "d", 10)}, 0), 0.0::DOUBLE) * ({2 / 3!r}::DOUBLE - {2 / 31!r}::DOUBLE) + {2 / 31!r}::DOUBLE) ** 2 AS sc FROM d),
r AS (SELECT symbol, i, close AS k FROM n WHERE i = 10 UNION ALL SELECT n.symbol, n.i, n.sc * n.close + (1 - n.sc) * r.k FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
SELECT n.symbol, ts, {_r("k", "KAMA_10")} FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i""",
    "ta_supertrend": _atr(7)
    + f""", n AS MATERIALIZED (SELECT symbol, ts, close, (high + low) / 2 AS mid, atr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM a),
r AS (
  SELECT symbol, i, mid - 3 * atr AS lo, mid + 3 * atr AS up, 1 AS side FROM n WHERE i = 8
  UNION ALL
  SELECT symbol, i, CASE WHEN kept AND side > 0 THEN greatest(lo, plo) ELSE lo END, CASE WHEN kept AND side < 0 THEN least(up, pup) ELSE up END, side
  FROM (SELECT n.symbol, n.i, n.mid - 3 * n.atr AS lo, n.mid + 3 * n.atr AS up, r.lo AS plo, r.up AS pup, CASE WHEN n.close > r.up THEN 1 WHEN n.close < r.lo THEN -1 ELSE r.side END AS side, n.close BETWEEN r.lo AND r.up AS kept
        FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1))
SELECT n.symbol, n.ts, {_r("CASE WHEN side > 0 THEN lo ELSE up END", "SUPERT_7")}, side::BIGINT AS "SUPERTd_7" FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i""",
    "ta_cycles": f"""{_FIRST}, t AS (
  SELECT *, {", ".join(f"100 * (close - {_lag('close', n)}) / {_lag('close', n)} AS r{k}" for k, n in enumerate((10, 15, 20, 30)))}, {_kernel("(close - open)", [1.0, 2.0, 2.0, 1.0])} AS vb, {_kernel("(high - low)", [1.0, 2.0, 2.0, 1.0])} AS vr,
         CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(0.0::DOUBLE, close - lag(close) OVER w) END AS up, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(0.0::DOUBLE, lag(close) OVER w - close) END AS dn, {_TRUE} AS tr FROM bars {_W}),
t2 AS (SELECT *, {" + ".join(f"{k + 1} * {_roll('avg', f'r{k}', n)}" for k, n in enumerate((10, 10, 10, 15)))} AS kst, {_roll("sum", "vb", 14)} / nullif({_roll("sum", "vr", 14)}, 0) AS rv, {_roll("sum", "tr", 14)} / nullif({_roll("max", "high", 14)} - {_roll("min", "low", 14)}, 0) AS ch FROM t) """
    + _select(
        [
            f'CASE WHEN close > {_roll("avg", "((high + low) / 2)", 6)} THEN 1 WHEN {_roll("avg", "((high + low) / 2)", 6)} IS NOT NULL THEN -1 END AS "TTM_TRND_6"', _r("kst", "KST"), _r(_roll("avg", "kst", 9), "KSTs"), _r("rv", "RVGI_14"), _r(_kernel("rv", [1.0, 2.0, 2.0, 1.0]), "RVGIs_14"),
            _r(f"100 * ({_roll('sum', 'up', 14)} - {_roll('sum', 'dn', 14)}) / nullif({_roll('sum', 'up', 14)} + {_roll('sum', 'dn', 14)}, 0)", "CMO_14"), _r(f"CASE WHEN ch > 0 THEN 100 * log10(ch) / {math.log10(14)!r}::DOUBLE END", "CHOP_14"),
        ],
        "t2",
    ),
    "ta_volume_ewm": _recursive(
        f"{_REC}, t0 AS (SELECT *, (close - lag(close) OVER w) * volume AS f, {_SHARE} * volume AS av FROM bars {_W}), t AS (SELECT *, {_DAY1.format(x='av')} AS ad FROM t0)",
        "t", [("efi", "f", 2 / 14, 13, "sma"), ("a3", "ad", 2 / 4, 3, "sma"), ("a10", "ad", 2 / 11, 10, "sma"), ("v12", "volume", 2 / 13, 12, "sma"), ("v26", "volume", 2 / 27, 26, "sma")], "d",
    )
    + f" SELECT symbol, ts, {_r('efi', 'EFI_13', 2)}, {_r('a3 - a10', 'ADOSC_3_10', 2)}, {_r('100 * (v12 - v26) / v26', 'PVO_12_26', 2)} FROM d",
    "ta_trix": _recursive(_recursive(_recursive(_REC, "bars", [("e1", "close", 2 / 19, 18, "sma")], "a"), "a", [("e2", "e1", 2 / 19, 18, "sma")], "b"), "b", [("e3", "e2", 2 / 19, 18, "sma")], "d")
    + f" SELECT symbol, ts, {_r('100 * (e3 / nullif(lag(e3) OVER w, 0) - 1)', 'TRIX_18')} FROM d {_W}",
    "ta_mass_index": _recursive(_recursive(f"{_REC}, g AS (SELECT *, high - low AS g FROM bars)", "g", [("e1", "g", 0.2, 9, "sma")], "a"), "a", [("e2", "e1", 0.2, 9, "sma")], "b")
    + f", d AS (SELECT *, e1 / nullif(e2, 0) AS q FROM b) SELECT symbol, ts, {_r(_roll('sum', 'q', 25), 'MASSI_9_25')} FROM d",
    "ta_psar": f"""{_REC}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
r AS (
  SELECT symbol, i, 1 AS side, low AS stop, high AS best, 0.02::DOUBLE AS speed, high AS h1, low AS l1, low AS shown, 1 AS shown_side FROM n WHERE i = 1
  UNION ALL
  SELECT symbol, i, CASE WHEN flip THEN -side ELSE side END, CASE WHEN flip THEN best ELSE s END,
         CASE WHEN flip THEN CASE WHEN side > 0 THEN low ELSE high END WHEN side > 0 THEN greatest(best, high) ELSE least(best, low) END,
         CASE WHEN flip THEN 0.02::DOUBLE WHEN (side > 0 AND high > best) OR (side < 0 AND low < best) THEN least(0.2::DOUBLE, speed + 0.02::DOUBLE) ELSE speed END,
         high, low, CASE WHEN flip THEN best ELSE s END, CASE WHEN flip THEN -side ELSE side END
  FROM (SELECT *, CASE WHEN side > 0 THEN low < s ELSE high > s END AS flip
        FROM (SELECT n.symbol, n.i, n.high, n.low, r.side, r.best, r.speed, CASE WHEN r.side > 0 THEN least(r.stop + r.speed * (r.best - r.stop), r.l1) ELSE greatest(r.stop + r.speed * (r.best - r.stop), r.h1) END AS s
              FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)))
SELECT n.symbol, n.ts, {_r("shown", "PSAR")}, shown_side::BIGINT AS "PSARd" FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i""",
}
