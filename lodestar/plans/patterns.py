"""Queries of the pattern statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import patterns as p
from lodestar.plans.common import rounded, settle
from lodestar.plans.indicators import _recursive
from lodestar.sources.bridge import BARS_SQL, TICKS_SQL, bars, ticks


def _daily(fn, **options):
    return lambda spark, sf_dir: rounded(fn(bars(spark, sf_dir), **options))


def _ticks(fn, **options):
    return lambda spark, sf_dir: rounded(fn(ticks(spark, sf_dir), **options))


def _tick_frame(spark, sf_dir):
    return ticks(spark, sf_dir).withColumnRenamed("price", "close").selectExpr("symbol", "ts", "close", "close as high", "close as low")


QUERIES = {
    "calendar_dow": _daily(p.day_of_week),
    "calendar_month_offset": _daily(p.month_offset),
    "calendar_month": _daily(p.month_seasonality),
    "calendar_time_of_day": lambda s, d: rounded(p.time_of_day(_tick_frame(s, d))),
    "calendar_events": _daily(p.event_days),
    "gap_detail": _daily(p.session_gaps),
    "gap_summary": _daily(p.gap_summary),
    "gap_quintiles": _daily(p.gap_quintiles),
    "momentum_autocorr": _daily(p.autocorrelation),
    "momentum_ljung_box": _daily(p.ljung_box),
    "momentum_rules": _daily(p.momentum_rules),
    "momentum_best_rule": _daily(p.best_rule),
    "momentum_hourly": _ticks(p.hourly_reversal),
    "volatility_regimes": _daily(p.atr_regimes),
    "volatility_narrow_range": _daily(p.narrow_range),
    "volatility_clustering": _daily(p.autocorrelation, absolute=True),
    "volatility_expansion": _daily(p.range_expansion),
    "volatility_quartiles": _daily(p.vol_quartiles),
    "volatility_arch_lm": _daily(p.arch_lm),
    "range_zones": _daily(p.range_zones),
    "stationarity_hurst": _daily(p.hurst),
    "stationarity_rolling_hurst": _daily(p.rolling_hurst),
    "stationarity_variance_ratio": _daily(p.variance_ratio),
    "stationarity_unit_root": _daily(p.unit_root),
    "overnight_split": _daily(p.overnight_split),
    "opening_range": _ticks(p.opening_range),
    "opening_rates": _ticks(p.opening_rates),
    "volume_quintiles": _daily(p.volume_quintiles),
    "runs_test": _daily(p.runs_test),
    "streaks": _daily(p.streak_stats),
    "vwap_deviation": _ticks(p.vwap_deviation),
    "drawdown": lambda s, d: p.drawdowns(bars(s, d)).withColumn("dd_log", settle(F.col("dd_log"))),
}

_RET = f"""WITH {BARS_SQL},
r AS (
  SELECT *, high - low AS range, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lag(close) OVER w AS prev, row_number() OVER w AS i
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
_TICK = f"""WITH {TICKS_SQL},
r AS (SELECT *, price / nullif(lag(price) OVER w, 0) - 1 AS ret FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def _stats(x: str = "ret", periods: int = 252) -> str:
    return (
        f"count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE WHEN {x} IS NOT NULL THEN 0.0::DOUBLE END), 6) AS win_rate, "
        f"round(avg({x}) / nullif(stddev_samp({x}), 0) * sqrt({periods}.0::DOUBLE), 6) AS sharpe"
    )


def _bins(col: str, q: int, by: str = "symbol") -> str:
    points = ", ".join(f"{i}.0::DOUBLE / {q}" for i in range(q + 1))
    return f"""edges AS (SELECT {by}, list_sort(list_distinct(quantile_cont({col}, [{points}]))) AS e FROM x GROUP BY {by}),
b AS (SELECT x.*, len(list_filter(e[2:len(e) - 1], lambda v: v < {col})) AS bin FROM x JOIN edges USING ({by}))"""


_RULES = f"""{_RET},
s AS (
  SELECT symbol, ret, {", ".join(f"CASE WHEN count(ret) OVER w{n} = {n} THEN sum(ret) OVER w{n} END AS m{n}" for n in (1, 2, 3, 5, 10))}
  FROM r WINDOW {", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (1, 2, 3, 5, 10))}),
u AS ({" UNION ALL ".join(f"SELECT symbol, {n} AS lookback, ret FROM s WHERE m{n} > 0 AND ret IS NOT NULL" for n in (1, 2, 3, 5, 10))}),
q AS (
  SELECT symbol, lookback, {_stats()},
         round(sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END), 0), 6) AS profit_factor, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0::DOUBLE) AS raw
  FROM u GROUP BY symbol, lookback)"""


def _autocorr(x: str) -> str:
    lags = range(1, 11)
    return f"""{_RET}, x AS (SELECT symbol, ts, {x} AS x FROM r),
l AS (SELECT symbol, x, {", ".join(f"lag(x, {k}) OVER w AS x{k}" for k in lags)} FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts))
{" UNION ALL ".join(f"SELECT symbol, {k} AS lag, round(corr(x, x{k}), 6) AS r FROM l GROUP BY symbol" for k in lags)}"""


def _orthogonal(k: int) -> str:
    """CTEs that end in ``fit`` with n, R squared and the last t value of the regression of y on x1 ... xk in ``src``, by making the x orthogonal one after another."""
    names = [f"x{j}" for j in range(1, k + 1)]
    sql = [f"o0 AS (SELECT * FROM src WHERE y IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in names)})"]
    for j in range(1, k):
        part = "OVER (PARTITION BY k)"
        rest = ", ".join(f"{x} - avg({x}) {part} - coalesce(regr_slope({x}, x{j}) {part}, 0) * (x{j} - avg(x{j}) {part}) AS {x}" for x in names[j:])
        sql.append(f"o{j} AS (SELECT * EXCLUDE ({', '.join(names[j:])}), {rest} FROM o{j - 1})")
    r2 = " + ".join(f"corr(y, {x}) ** 2" for x in names)
    sql.append(f"ft AS (SELECT k, count(*) AS n, {r2} AS r2, regr_slope(y, x{k}) AS b, regr_sxx(y, x{k}) AS sxx, regr_syy(y, x{k}) AS syy FROM o{k - 1} GROUP BY k)")
    sql.append(f"fit AS (SELECT k, n, r2, b / sqrt(syy * (1 - r2) / (n - {k + 1}) / sxx) AS t FROM ft)")
    return ",\n".join(sql)


def _ranges(source: str, by: str, most: int) -> str:
    """CTEs that end in ``m`` with the mean rescaled range of each size of pieces of ``source``."""
    return f"""nn AS (SELECT {by}, count(*) AS n, least({most}, count(*) // 2)::DOUBLE AS top FROM {source} GROUP BY 1),
sz AS (SELECT DISTINCT {by}, floor(pow(10.0::DOUBLE, 1.0::DOUBLE + k * ((log10(top) - 1.0::DOUBLE) / 19)) + 1e-9)::BIGINT AS s FROM nn, generate_series(0, 19) g(k) WHERE top > 10),
c AS (SELECT {by}, s, i // s AS piece, i, ret FROM {source} JOIN sz USING ({by})),
d AS (SELECT *, ret - avg(ret) OVER p AS d, count(*) OVER p AS n FROM c WINDOW p AS (PARTITION BY {by}, s, piece)),
k AS (SELECT *, sum(d) OVER (PARTITION BY {by}, s, piece ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM d WHERE n = s),
rs AS (SELECT {by}, s, piece, (max(k) - min(k)) / nullif(stddev_samp(ret), 0) AS rs FROM k GROUP BY 1, 2, 3),
m AS (SELECT {by}, s, avg(rs) AS rs FROM rs GROUP BY 1, 2)"""


def _streak_side(direction: str, test: str) -> str:
    return f"""{direction} AS (
  SELECT symbol, ts, fwd, ({test}) AS on_, sum(CASE WHEN {test} THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM f),
{direction}_n AS (SELECT symbol, fwd, sum(CASE WHEN on_ THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run ORDER BY ts) AS k FROM {direction})"""


ORACLE_SQL = {
    "calendar_dow": f"""{_RET}
SELECT symbol, (isodow(ts) - 1)::INTEGER AS dow, {_stats(periods=52)}, round(quantile_cont(ret, 0.5), 6) AS median, round(avg(range), 6) AS avg_range, round(avg(abs(ret)), 6) AS mean_abs
FROM r WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(ret) >= 5""",
    "calendar_month_offset": f"""{_RET},
o AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, year(ts), month(ts) ORDER BY ts) - count(*) OVER (PARTITION BY symbol, year(ts), month(ts)) AS off FROM r)
SELECT symbol, off AS "offset", {_stats()} FROM o WHERE off >= -5 AND ret IS NOT NULL GROUP BY 1, 2""",
    "calendar_month": f"""{_RET} SELECT symbol, month(ts)::INTEGER AS month, {_stats()} FROM r WHERE ret IS NOT NULL GROUP BY 1, 2""",
    "calendar_time_of_day": f"""{_TICK}
SELECT (isodow(ts) - 1)::INTEGER AS dow, ((hour(ts) * 60 + minute(ts)) // 30 * 30)::BIGINT AS minute, {_stats()} FROM r WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(ret) >= 10""",
    "calendar_events": f"""{_RET},
e AS (
  SELECT ret, isodow(ts) = 5 AND day(ts) BETWEEN 15 AND 21 AS expiry,
         coalesce(month(lead(ts) OVER w) <> month(ts), true) AND month(ts) % 3 = 0 AS quarter_end,
         month(ts) = 1 AND row_number() OVER (PARTITION BY symbol, year(ts) ORDER BY ts) <= 5 AS january
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
u AS (SELECT ret, 'expiry' AS event, expiry AS is_event FROM e UNION ALL SELECT ret, 'quarter_end', quarter_end FROM e UNION ALL SELECT ret, 'january', january FROM e)
SELECT event, is_event, {_stats()} FROM u WHERE ret IS NOT NULL GROUP BY 1, 2""",
    "gap_detail": f"""{_RET}
SELECT symbol, ts, round(open / nullif(prev, 0) - 1, 6) AS gap, CASE WHEN open / nullif(prev, 0) - 1 > 0 THEN 'up' ELSE 'down' END AS direction,
       CASE WHEN open / nullif(prev, 0) - 1 > 0 THEN low <= prev ELSE high >= prev END AS filled, (isodow(ts) - 1)::INTEGER AS dow
FROM r WHERE abs(open / nullif(prev, 0) - 1) >= 0.01""",
    "gap_summary": f"""{_RET},
g AS (
  SELECT open / nullif(prev, 0) - 1 AS gap, CASE WHEN open / nullif(prev, 0) - 1 > 0 THEN 'up' ELSE 'down' END AS direction,
         CASE WHEN open / nullif(prev, 0) - 1 > 0 THEN low <= prev ELSE high >= prev END AS filled, (isodow(ts) - 1)::INTEGER AS dow
  FROM r WHERE abs(open / nullif(prev, 0) - 1) >= 0.01)
SELECT direction, dow, count(*) AS n, round(avg(filled::INTEGER::DOUBLE), 6) AS fill_rate, round(quantile_cont(abs(gap), 0.5), 6) AS median_gap
FROM g GROUP BY GROUPING SETS ((direction), (dow), ())""",
    "gap_quintiles": f"""{_RET},
x AS (
  SELECT symbol, lead(close) OVER w / nullif(close, 0) - 1 AS next_ret, abs(open / nullif(prev, 0) - 1) AS size FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts) QUALIFY size IS NOT NULL),
{_bins("size", 5)}
SELECT symbol, bin::INTEGER AS bin, count(*) AS n, round(avg(next_ret), 6) AS next_mean, round(avg(size), 6) AS mean_gap FROM b GROUP BY 1, 2""",
    "momentum_autocorr": _autocorr("ret"),
    "volatility_clustering": _autocorr("abs(ret)"),
    "momentum_ljung_box": f"""{_RET},
d AS (SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS e FROM r WHERE ret IS NOT NULL),
l AS (SELECT symbol, e, {", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, 6))} FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, count(*) AS n, sum(e * e) AS ss, sum((e - e1) * (e - e1)) AS dd, {", ".join(f"sum(e * e{k}) AS s{k}" for k in range(1, 6))} FROM l GROUP BY symbol)
SELECT symbol, n, round(n * (n + 2) * ({" + ".join(f"(s{k} / ss) * (s{k} / ss) / (n - {k})" for k in range(1, 6))}), 6) AS q, round(dd / ss, 6) AS durbin_watson FROM s""",
    "momentum_rules": f"{_RULES} SELECT symbol, lookback, n, mean, std, win_rate, sharpe, profit_factor FROM q",
    "momentum_best_rule": f"{_RULES} SELECT symbol, arg_max(lookback, row(raw, -lookback)) AS lookback, round(max(raw), 6) AS sharpe FROM q GROUP BY symbol",
    "momentum_hourly": f"""{_TICK},
h AS (SELECT symbol, hour(ts)::INTEGER AS hour, ret, lag(ret) OVER (PARTITION BY symbol, hour(ts) ORDER BY ts) AS before FROM r WHERE ret IS NOT NULL),
c AS (SELECT symbol, hour, count(*) AS n, corr(ret, before) AS r FROM h GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT symbol, hour, n, round(r, 6) AS r, CASE WHEN r > 0.05 THEN 'momentum' WHEN r < -0.05 THEN 'reversion' ELSE 'neutral' END AS label FROM c""",
    "volatility_regimes": _recursive(_RET.replace("WITH ", "WITH RECURSIVE ", 1), "r", [("atr", "range", 2 / 15, 1, "first")], "ra")
    + f""", a AS (SELECT *, {", ".join(f"lead(close, {k}) OVER w / nullif(close, 0) - 1 AS f{k}" for k in (1, 2, 3, 5))} FROM ra WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT symbol, quantile_cont(atr, 0.33::DOUBLE) AS lo, quantile_cont(atr, 0.67::DOUBLE) AS hi FROM a GROUP BY symbol)
SELECT symbol, CASE WHEN atr >= hi THEN 'high' WHEN atr <= lo THEN 'low' ELSE 'mid' END AS regime, {_stats(periods=1)}, round(avg(atr), 6) AS avg_atr,
       {", ".join(f"round(avg(f{k}), 6) AS mean_fwd_{k}, round(avg(CASE WHEN f{k} > 0 THEN 1.0::DOUBLE WHEN f{k} IS NOT NULL THEN 0.0::DOUBLE END), 6) AS win_fwd_{k}" for k in (1, 2, 3, 5))}
FROM a JOIN e USING (symbol) GROUP BY 1, 2 HAVING count(ret) >= 10""",
    "volatility_narrow_range": f"""{_RET},
a AS (
  SELECT symbol, lead(close) OVER w / nullif(close, 0) - 1 AS fwd, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction,
         count(range) OVER w4 = 4 AND range = min(range) OVER w4 AS nr4, count(range) OVER w7 = 7 AND range = min(range) OVER w7 AS nr7
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts), w4 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w7 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
u AS (SELECT symbol, 4 AS size, direction, fwd FROM a WHERE nr4 UNION ALL SELECT symbol, 7, direction, fwd FROM a WHERE nr7)
SELECT symbol, size, direction, {_stats("fwd")} FROM u WHERE fwd IS NOT NULL GROUP BY 1, 2, 3""",
    "volatility_expansion": f"""{_RET},
a AS (
  SELECT symbol, range, count(range) OVER w7 = 7 AND range = min(range) OVER w7 AS nr, {", ".join(f"lead(range, {k}) OVER w AS f{k}" for k in range(1, 6))}
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts), w7 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
{" UNION ALL ".join(f"SELECT symbol, {k} AS ahead, round(avg(CASE WHEN nr THEN f{k} END) / nullif(avg(range), 0), 6) AS expansion FROM a GROUP BY symbol" for k in range(1, 6))}""",
    "volatility_quartiles": f"""{_RET},
x AS (
  SELECT symbol, CASE WHEN count(ret) OVER w21 = 21 THEN stddev_samp(ret) OVER w21 END AS vol, lead(ret) OVER w AS fwd FROM r
  WINDOW w AS (PARTITION BY symbol ORDER BY ts), w21 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) QUALIFY vol IS NOT NULL AND fwd IS NOT NULL),
{_bins("vol", 4)}
SELECT symbol, bin::INTEGER AS bin, {_stats("fwd")} FROM b GROUP BY 1, 2""",
    "volatility_arch_lm": f"""{_RET}, q0 AS (SELECT symbol, ts, ret * ret AS y FROM r WHERE ret IS NOT NULL),
src AS (SELECT symbol AS k, ts, y, {", ".join(f"lag(y, {k}) OVER w AS x{k}" for k in range(1, 6))} FROM q0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)), c1 AS (SELECT k, corr(y, x1) AS r FROM src GROUP BY k),
{_orthogonal(5)}
SELECT k AS symbol, n, round(n * r2, 6) AS lm, round(r, 6) AS r, n * r2 > 11.07 AS clustered FROM fit JOIN c1 USING (k)""",
    "range_zones": f"""{_RET},
a AS (
  SELECT symbol, range / nullif(CASE WHEN count(range) OVER w14 = 14 THEN avg(range) OVER w14 END, 0) AS rel, lead(ret) OVER w AS fwd
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts), w14 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, CASE WHEN rel <= 0.7 THEN 'narrow' WHEN rel <= 1.3 THEN 'normal' ELSE 'wide' END AS zone, {_stats("fwd")} FROM a WHERE rel IS NOT NULL AND fwd IS NOT NULL GROUP BY 1, 2""",
    "stationarity_hurst": f"""{_RET},
i AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM r WHERE ret IS NOT NULL),
{_ranges("i", "symbol", 500)}
SELECT symbol, round(regr_slope(log10(rs), log10(s)), 6) AS hurst, count(*) AS sizes FROM m WHERE rs > 0 GROUP BY symbol""",
    "stationarity_rolling_hurst": f"""{_RET},
i AS (SELECT symbol, ts, ret, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
wn AS (SELECT symbol, unnest(generate_series(0, (n - 252) // 21)) AS wd FROM (SELECT DISTINCT symbol, n FROM i WHERE n >= 252)),
j AS (SELECT symbol || ' ' || wd::VARCHAR AS g, symbol, wd, ts, ret, i - wd * 21 AS i FROM i JOIN wn USING (symbol) WHERE i >= wd * 21 AND i < wd * 21 + 252), en AS (SELECT g, first(symbol) AS symbol, max(ts) AS ts FROM j GROUP BY g),
{_ranges("j", "g", 126)}
SELECT symbol, ts, round(h, 6) AS hurst FROM (SELECT g, regr_slope(log10(rs), log10(s)) AS h FROM m WHERE rs > 0 GROUP BY g) JOIN en USING (g)""",
    "stationarity_variance_ratio": f"""{_RET},
g AS (SELECT symbol, ts, ln(close / nullif(prev, 0)) AS g FROM r WHERE prev IS NOT NULL),
s AS (
  SELECT symbol, g, {", ".join(f"CASE WHEN count(g) OVER w{q} = {q} THEN sum(g) OVER w{q} END AS s{q}" for q in (2, 4, 8, 16))} FROM g
  WINDOW {", ".join(f"w{q} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {q - 1} PRECEDING AND CURRENT ROW)" for q in (2, 4, 8, 16))}),
u AS ({" UNION ALL ".join(f"SELECT symbol, {q} AS q, var_samp(s{q}) / ({q} * var_samp(g)) AS vr FROM s GROUP BY symbol" for q in (2, 4, 8, 16))})
SELECT symbol, q, round(vr, 6) AS vr, CASE WHEN vr > 1.05 THEN 'trending' WHEN vr < 0.95 THEN 'reverting' ELSE 'random' END AS label FROM u""",
    "stationarity_unit_root": f"""{_RET}, z AS (SELECT symbol || ' level' AS k, symbol, 'level' AS series, ts, close AS x FROM r UNION ALL SELECT symbol || ' return', symbol, 'return', ts, ret FROM r WHERE ret IS NOT NULL),
z1 AS (SELECT *, x - lag(x) OVER w AS y, lag(x) OVER w AS before FROM z WINDOW w AS (PARTITION BY k ORDER BY ts)),
src AS (SELECT k, ts, y, {", ".join(f"lag(y, {k}) OVER w AS x{k}" for k in range(1, 5))}, before AS x5 FROM z1 WINDOW w AS (PARTITION BY k ORDER BY ts)),
{_orthogonal(5)}
SELECT string_split(k, ' ')[1] AS symbol, string_split(k, ' ')[2] AS series, n, round(t, 6) AS t, t < -2.86 AS stationary FROM fit""",
    "overnight_split": f"""{_RET}
SELECT symbol, (isodow(ts) - 1)::INTEGER AS dow, count(*) AS n, round(avg(open / nullif(prev, 0) - 1), 6) AS overnight, round(avg(close / nullif(open, 0) - 1), 6) AS intraday FROM r WHERE prev IS NOT NULL GROUP BY 1, 2""",
    "opening_range": f"""WITH {TICKS_SQL},
o AS (
  SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, max(price) FILTER (WHERE hour(ts) < 1) AS or_high, min(price) FILTER (WHERE hour(ts) < 1) AS or_low,
         max(price) FILTER (WHERE hour(ts) >= 1) AS high, min(price) FILTER (WHERE hour(ts) >= 1) AS low FROM ticks GROUP BY 1, 2)
SELECT symbol, day, round(or_high, 6) AS or_high, round(or_low, 6) AS or_low, round(high, 6) AS high, round(low, 6) AS low, high > or_high AS broke_up, low < or_low AS broke_down, high >= 2 * or_high - or_low AS went_on
FROM o WHERE or_high IS NOT NULL AND high IS NOT NULL""",
    "opening_rates": f"""WITH {TICKS_SQL},
o AS (
  SELECT symbol, date_trunc('day', ts) AS day, max(price) FILTER (WHERE hour(ts) < 1) AS or_high, min(price) FILTER (WHERE hour(ts) < 1) AS or_low,
         max(price) FILTER (WHERE hour(ts) >= 1) AS high, min(price) FILTER (WHERE hour(ts) >= 1) AS low FROM ticks GROUP BY 1, 2)
SELECT symbol, count(*) AS days, round(avg((high > or_high)::INTEGER::DOUBLE), 6) AS up_rate, round(avg((low < or_low)::INTEGER::DOUBLE), 6) AS down_rate,
       round(avg(CASE WHEN high > or_high THEN (high >= 2 * or_high - or_low)::INTEGER::DOUBLE END), 6) AS continuation
FROM o WHERE or_high IS NOT NULL AND high IS NOT NULL GROUP BY symbol""",
    "volume_quintiles": f"""{_RET},
x AS (SELECT symbol, volume, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS fwd FROM r QUALIFY fwd IS NOT NULL),
{_bins("volume", 5)}
SELECT symbol, bin::INTEGER AS bin, {_stats("fwd")} FROM b GROUP BY 1, 2 HAVING count(fwd) >= 20""",
    "runs_test": f"""{_RET},
u AS (SELECT symbol, ret > 0 AS up, coalesce((ret > 0) <> lag(ret > 0) OVER (PARTITION BY symbol ORDER BY ts), true) AS fresh FROM r WHERE ret <> 0),
s AS (SELECT symbol, sum(fresh::INTEGER)::BIGINT AS runs, sum(up::INTEGER)::DOUBLE AS a, sum((NOT up)::INTEGER)::DOUBLE AS b FROM u GROUP BY symbol)
SELECT symbol, runs, round(2 * a * b / (a + b) + 1, 6) AS expected,
       round((runs - (2 * a * b / (a + b) + 1)) / sqrt(2 * a * b * (2 * a * b - (a + b)) / ((a + b) * (a + b) * (a + b - 1))), 6) AS z FROM s""",
    "streaks": f"""{_RET},
f AS (SELECT symbol, ts, ret, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS fwd FROM r),
{_streak_side("up", "coalesce(ret > 0, false)")},
{_streak_side("down", "coalesce(ret < 0, false)")},
a AS (SELECT symbol, fwd, 'up' AS direction, k AS n FROM up_n UNION ALL SELECT symbol, fwd, 'down', k FROM down_n)
SELECT symbol, direction, v.k AS k, {_stats("fwd")} FROM a JOIN (VALUES (1), (2), (3), (4)) v(k) ON a.n >= v.k WHERE fwd IS NOT NULL GROUP BY 1, 2, 3""",
    "vwap_deviation": f"""{_TICK},
x AS (
  SELECT symbol, price / nullif(sum(price * volume) OVER d / nullif(sum(volume) OVER d, 0), 0) - 1 AS dev, CASE WHEN count(ret) OVER n = 30 THEN sum(ret) OVER n END AS fwd FROM r
  WINDOW d AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)
  QUALIFY dev IS NOT NULL AND fwd IS NOT NULL),
{_bins("dev", 5)}
SELECT symbol, bin::INTEGER AS bin, count(*) AS n, round(avg(fwd), 6) AS fwd_mean, round(avg(dev), 6) AS dev_mean FROM b GROUP BY 1, 2""",
    "drawdown": f"""WITH {BARS_SQL}, t AS (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM bars)
SELECT symbol, ts, top - close AS dd, 1 - close / top AS dd_pct, round(ln(top) - ln(close), 6) AS dd_log FROM t""",
}
