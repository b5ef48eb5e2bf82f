"""Queries of sessions, day types and the signal screener, and their SQL."""

from __future__ import annotations

from lodestar.operators import patterns as p
from lodestar.operators import resample as rs
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _W, _recursive, _roll
from lodestar.plans.patterns import _RET, _bins, _daily, _stats
from lodestar.plans.rules import _BARS30, _half_hours
from lodestar.sources.bridge import ticks

_SPLIT = {"train_end": "1998-12-31", "test_start": "1999-01-01"}


def _minutes(s, d):
    return rs.tick_bars(ticks(s, d), {"1m": 60}).drop("frame")


#: The session of the half-hour bars: all day, so that sparse ticks fill it.
_DAY = {"opens": 0, "closes": 1410}

QUERIES = {
    "session_gap_detail": lambda s, d: rounded(p.session_gap_detail(_half_hours(s, d), **_DAY)),
    "session_gap_summary": lambda s, d: rounded(p.session_gap_summary(_half_hours(s, d), **_DAY)),
    "gap_fills": _daily(p.gap_fills),
    "day_types": _daily(p.day_types),
    "day_signal_lift": lambda s, d: rounded(p.signal_lift(p.day_types(_bars(s, d)))),
    "session_buckets": lambda s, d: rounded(p.session_buckets(_minutes(s, d))),
    "session_segments": lambda s, d: rounded(p.session_segments(_minutes(s, d))),
    "session_open_drive": lambda s, d: rounded(p.open_drive(_minutes(s, d))),
    "screener": _daily(p.screen, **_SPLIT),
    "screener_blend": _daily(p.blend),
    "screener_curves": lambda s, d: rounded(p.equity_curves(_bars(s, d))),
    "runs_test_p": lambda s, d: rounded(p.runs_p_value(p.runs_test(_bars(s, d))).select("symbol", "z", "p", "label")),
}


def _bars(s, d):
    from lodestar.sources.bridge import bars

    return bars(s, d)


_GAPS = f"""WITH {_BARS30}, m AS (SELECT *, hour(ts) * 60 + minute(ts) AS mi, date_trunc('day', ts)::TIMESTAMP AS day FROM bars),
dd AS (SELECT symbol, day, min(open) FILTER (WHERE mi = 0) AS so, max(close) FILTER (WHERE mi = 1410) AS sc FROM m WHERE mi BETWEEN 0 AND 1410 GROUP BY 1, 2),
pc AS (SELECT *, lag(sc) OVER (PARTITION BY symbol ORDER BY day) AS prior_close FROM dd WHERE so IS NOT NULL),
gp AS (SELECT *, 100 * (so / nullif(prior_close, 0) - 1) AS gap_pct FROM pc WHERE prior_close IS NOT NULL),
fl AS (SELECT g.symbol, g.day, min(CASE WHEN CASE WHEN gap_pct > 0 THEN low <= prior_close ELSE high >= prior_close END THEN mi END) AS fill FROM gp g JOIN m ON m.symbol = g.symbol AND m.day = g.day WHERE mi BETWEEN 0 AND 1410 GROUP BY 1, 2),
gd AS (
  SELECT symbol, day, isodow(day) = 1 AS weekend, prior_close, so AS session_open, gap_pct, CASE WHEN gap_pct > 0 THEN 'up' ELSE 'down' END AS direction,
         CASE WHEN abs(gap_pct) < 0.1 THEN '< 0.1%' WHEN abs(gap_pct) < 0.25 THEN '< 0.25%' WHEN abs(gap_pct) < 0.5 THEN '< 0.5%' WHEN abs(gap_pct) < 1.0 THEN '< 1.0%' ELSE '>= 1.0%' END AS bucket, fill IS NOT NULL AS filled, fill::INTEGER AS fill_minutes
  FROM gp JOIN fl USING (symbol, day) WHERE abs(gap_pct) >= 0.01)"""
_RANGE_EWM = _recursive(_RET.replace("WITH ", "WITH RECURSIVE ", 1), "r", [("atr", "range", 2 / 15, 1, "first")], "ra")
_TYPES = f"""{_RANGE_EWM}, t0 AS (SELECT *, range / nullif(atr, 0) AS rel, lag(low) OVER w AS l1, lag(range) OVER w AS r1 FROM ra {_W}),
t1 AS (SELECT *, abs((open - prev) / nullif(prev, 0)) AS gap_size, (prev - l1) / nullif(r1, 0) AS close_rank, CASE WHEN count(r1) OVER v >= 4 THEN min(r1) OVER v END AS m1 FROM t0 WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
ed AS (SELECT symbol, quantile_cont(gap_size, 0.6::DOUBLE) AS edge FROM t1 GROUP BY symbol),
ty AS (
  SELECT symbol, ts, CASE WHEN rel > 1.2 THEN 'trend' WHEN rel < 0.8 THEN 'chop' ELSE 'neutral' END AS day_type, gap_size, close_rank, coalesce(gap_size > edge, false)::INTEGER::DOUBLE AS sig_gap,
         coalesce(close_rank > 0.7 OR close_rank < 0.3, false)::INTEGER::DOUBLE AS sig_close_rank, coalesce(r1 = m1, false)::INTEGER::DOUBLE AS sig_narrow, (isodow(ts) IN (2, 3))::INTEGER::DOUBLE AS sig_dow
  FROM t1 JOIN ed USING (symbol))"""
_MINUTES = _BARS30.replace("/ 1800) * 1800", "/ 60) * 60") + ", mr AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, hour(ts) * 60 + minute(ts) AS mi, date_trunc('day', ts) AS day FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
_SEGMENT = "CASE " + " ".join(f"WHEN mi BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in p.SEGMENTS) + " END"
_RULES = f"""{_RANGE_EWM}, qe AS (SELECT symbol, quantile_cont(atr, 0.33::DOUBLE) AS lo, quantile_cont(atr, 0.67::DOUBLE) AS hi FROM ra GROUP BY symbol),
s0 AS (
  SELECT ra.*, lo, hi, row_number() OVER (PARTITION BY symbol, year(ts), month(ts) ORDER BY ts) - count(*) OVER (PARTITION BY symbol, year(ts), month(ts)) AS off, close / nullif(lag(close, 5) OVER w, 0) - 1 AS g5, close / nullif(lag(close, 3) OVER w, 0) - 1 AS g3,
         range = {_roll("min", "range", 7)} AND close >= open AS nr, lead(ret) OVER w AS fwd FROM ra JOIN qe USING (symbol) {_W}),
s1 AS (
  SELECT symbol, ts, fwd, 1 AS always_long, (off IN (-2, -1, 1))::INTEGER AS eom_momentum, (isodow(ts) IN (2, 3, 4))::INTEGER AS dow_filter, coalesce(g5 > 0, false)::INTEGER AS momentum_5d, coalesce(g3 > 0, false)::INTEGER AS momentum_3d,
         (atr <= lo)::INTEGER AS low_vol, (atr > lo AND atr <= hi)::INTEGER AS mid_vol, coalesce(lag(nr) OVER w, false)::INTEGER AS nr7_up FROM s0 {_W})"""
_LONG = " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS signal, {n} * fwd AS x, {n} AS on_ FROM s1 WHERE fwd IS NOT NULL" for n in p.RULES)
_PART = "OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

ORACLE_SQL = {
    "session_gap_detail": f"{_GAPS} SELECT symbol, day, weekend, round(prior_close, 6) AS prior_close, round(session_open, 6) AS session_open, round(gap_pct, 6) AS gap_pct, direction, bucket, filled, fill_minutes FROM gd",
    "session_gap_summary": f"{_GAPS}, gg AS (SELECT *, (isodow(day) - 1)::INTEGER AS dow FROM gd) SELECT bucket, direction, weekend, dow, count(*) AS n, round(avg(filled::INTEGER::DOUBLE), 6) AS fill_rate, round(quantile_cont(fill_minutes, 0.5)::DOUBLE, 6) AS median_minutes FROM gg GROUP BY GROUPING SETS ((bucket), (direction), (weekend), (dow), ())",
    "gap_fills": f"""{_RET}, x AS (SELECT symbol, abs(open / nullif(prev, 0) - 1) AS size, (CASE WHEN open / nullif(prev, 0) - 1 > 0 THEN low <= prev ELSE high >= prev END)::INTEGER::DOUBLE AS hit, lead(close) OVER w / nullif(close, 0) - 1 AS nr FROM r {_W} QUALIFY size IS NOT NULL),
{_bins("size", 5)} SELECT symbol, bin::INTEGER AS bin, count(*) AS n, round(avg(hit), 6) AS fill_rate, round(avg(nr), 6) AS next_mean, round(avg(CASE WHEN nr > 0 THEN 1.0::DOUBLE WHEN nr IS NOT NULL THEN 0.0::DOUBLE END), 6) AS next_win FROM b GROUP BY 1, 2""",
    "day_types": f"{_TYPES} SELECT symbol, ts, day_type, round(gap_size, 6) AS gap_size, round(close_rank, 6) AS close_rank, sig_gap, sig_close_rank, sig_narrow, sig_dow, sig_gap + sig_close_rank + sig_narrow + sig_dow AS score FROM ty",
    "day_signal_lift": f"""{_TYPES}, lf AS ({" UNION ALL ".join(f"SELECT symbol, '{n}' AS signal, (day_type = 'trend')::INTEGER::DOUBLE AS hit, sig_{n} = 1 AS on_ FROM ty WHERE day_type IN ('trend', 'chop')" for n in ("gap", "close_rank", "narrow", "dow"))}),
ls AS (SELECT symbol, signal, count(*) AS n, sum(on_::INTEGER)::BIGINT AS fired, avg(hit) AS b, avg(hit) FILTER (WHERE on_) AS f, avg(hit) FILTER (WHERE NOT on_) AS o FROM lf GROUP BY 1, 2)
SELECT symbol, signal, n, fired, round(b, 6) AS base_rate, round(f, 6) AS rate_fired, round(o, 6) AS rate_not, round(f / nullif(b, 0), 6) AS lift FROM ls WHERE n >= 20 AND fired >= 5 AND n - fired >= 5""",
    "session_buckets": f"WITH {_MINUTES} SELECT symbol, (mi - 570) // 30 * 30 + 570 AS bucket, {_stats()}, round(avg(abs(ret)), 6) AS mean_abs, round(avg(volume), 6) AS avg_volume FROM mr WHERE mi BETWEEN 570 AND 959 AND ret IS NOT NULL GROUP BY 1, 2",
    "session_segments": f"""WITH {_MINUTES}, sd AS (SELECT symbol, day, {_SEGMENT} AS segment, arg_max(close, ts) / nullif(arg_min(open, ts), 0) - 1 AS ret, (max(high) - min(low)) / nullif(arg_min(open, ts), 0) AS span FROM mr WHERE {_SEGMENT} IS NOT NULL GROUP BY 1, 2, 3)
SELECT symbol, segment, {_stats()}, round(avg(span), 6) AS avg_range FROM sd GROUP BY 1, 2""",
    "session_open_drive": f"""WITH {_MINUTES}, od AS (SELECT symbol, day, arg_max(close, ts) FILTER (WHERE mi < 600) / nullif(arg_min(open, ts) FILTER (WHERE mi < 600), 0) - 1 AS drive, arg_max(close, ts) FILTER (WHERE mi >= 600) / nullif(arg_min(open, ts) FILTER (WHERE mi >= 600), 0) - 1 AS rest FROM mr WHERE mi BETWEEN 570 AND 959 GROUP BY 1, 2)
SELECT symbol, count(*) AS days, round(covar_pop(drive, rest) / nullif(stddev_pop(drive) * stddev_pop(rest), 0), 6) AS corr, round(avg((sign(drive) = sign(rest))::INTEGER::DOUBLE), 6) AS same_sign FROM od WHERE drive IS NOT NULL AND rest IS NOT NULL GROUP BY 1""",
    "screener": f"""{_RULES}, lg AS ({_LONG}), sp AS (SELECT *, CASE WHEN ts::DATE <= DATE '1998-12-31' THEN 'is' WHEN ts::DATE >= DATE '1999-01-01' THEN 'oos' END AS split FROM lg WHERE on_ = 1),
cu AS (SELECT *, sum(ln(1 + x)) {_PART.format(by="symbol, signal, split")} AS c FROM sp), dn AS (SELECT *, exp(c - max(c) {_PART.format(by="symbol, signal, split")}) - 1 AS d FROM cu),
st AS (SELECT symbol, signal, split, count(x) AS n, avg(x) / nullif(stddev_samp(x), 0) * sqrt(252.0::DOUBLE) AS sharpe, avg((x > 0)::INTEGER::DOUBLE) AS win_rate, sum(x) FILTER (WHERE x > 0) / nullif(-sum(x) FILTER (WHERE x < 0), 0) AS profit_factor, min(d) AS max_drawdown FROM dn GROUP BY 1, 2, 3 HAVING count(x) >= 20),
bo AS (SELECT a.symbol, a.signal, {", ".join(f"{t}.{x} AS {k}_{x}" for t, k in (("a", "is"), ("b", "oos")) for x in ("n", "sharpe", "win_rate", "profit_factor", "max_drawdown"))}, (a.sharpe - b.sharpe) / nullif(abs(a.sharpe), 0) * 100 AS decay FROM st a JOIN st b ON a.symbol = b.symbol AND a.signal = b.signal AND a.split = 'is' AND b.split = 'oos' WHERE a.sharpe IS NOT NULL AND b.sharpe IS NOT NULL)
SELECT symbol, signal, {", ".join(f"{k}_n, " + ", ".join(f"round({k}_{x}, 6) AS {k}_{x}" for x in ("sharpe", "win_rate", "profit_factor", "max_drawdown")) for k in ("is", "oos"))}, round(decay, 6) AS decay_pct, oos_sharpe >= 0.3 AND coalesce(decay <= 50, true) AS passes, (row_number() OVER (PARTITION BY symbol ORDER BY oos_sharpe DESC, signal))::INTEGER AS rank FROM bo""",
    "screener_blend": f"""{_RULES}, lg AS ({_LONG} UNION ALL SELECT symbol, ts, 'blend', ({" + ".join(p.RULES)}) * fwd / {len(p.RULES)}, 1 FROM s1 WHERE fwd IS NOT NULL),
cu AS (SELECT *, sum(ln(1 + x)) {_PART.format(by="symbol, signal")} AS c FROM lg), dn AS (SELECT *, exp(c - max(c) {_PART.format(by="symbol, signal")}) - 1 AS d FROM cu)
SELECT symbol, signal, count(*) AS days, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252.0::DOUBLE), 6) AS sharpe, round(min(d), 6) AS max_drawdown, round(sum(ln(1 + x)), 6) AS log_value FROM dn GROUP BY 1, 2""",
    "screener_curves": f"{_RULES}, lg AS ({_LONG}) SELECT symbol, signal, ts, round(sum(ln(1 + x)) {_PART.format(by='symbol, signal')}, 6) AS log_value FROM lg",
    "runs_test_p": f"""{_RET}, u AS (SELECT symbol, ret > 0 AS up, coalesce((ret > 0) <> lag(ret > 0) OVER (PARTITION BY symbol ORDER BY ts), true) AS fresh FROM r WHERE ret <> 0),
s AS (SELECT symbol, sum(fresh::INTEGER)::DOUBLE AS runs, sum(up::INTEGER)::DOUBLE AS a, sum((NOT up)::INTEGER)::DOUBLE AS b FROM u GROUP BY symbol),
z AS (SELECT symbol, (runs - (2 * a * b / (a + b) + 1)) / sqrt(2 * a * b * (2 * a * b - (a + b)) / ((a + b) * (a + b) * (a + b - 1))) AS z FROM s), t AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z),
p AS (SELECT *, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x) AS p FROM t)
SELECT symbol, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN p >= 0.05 THEN 'random' WHEN z < 0 THEN 'trending' ELSE 'reverting' END AS label FROM p""",
}
