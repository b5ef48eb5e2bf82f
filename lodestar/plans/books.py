"""Queries of portfolios, searches, regimes and series metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import backtest as b
from lodestar.operators import metrics as m
from lodestar.operators import resample as rs
from lodestar.operators import strategy as st
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _W, _roll
from lodestar.plans.strategies import _CUM, _FIRST, _KEEP, _NET, _POINTS, _RUN, _TRADES, _grid_sql, _net, _run, _turtle
from lodestar.sources.bridge import BARS_SQL, TICKS_SQL, bars, ticks, trades

_SEARCH_3 = b.random_points(_POINTS, 3, 42)
_JOBS = [("slow", "turtle", {"entry": 55, "leave": 20}, None), ("quick", "turtle", {"entry": 20, "leave": 10}, ["S00", "S01", "S02"])]


def _equity(s, d):
    return b.portfolio(b.grid_returns(bars(s, d), "turtle", _POINTS), ("param_id",))


def _turtle_bars(s, d):
    return st.turtle(bars(s, d))


def _positions(s, d):
    return trades(s, d).groupBy("symbol").agg((F.sum("volume") % 7 - 3).cast("bigint").alias("quantity")).where("quantity <> 0")


QUERIES = {
    "backtest_trailing_stop": lambda s, d: b.trailing_stop(st.turtle(bars(s, d), exit_mode="hold")).select(*_KEEP),
    "backtest_frames": lambda s, d: rounded(b.frame_metrics(rs.tick_bars(ticks(s, d), {"30m": 1800, "1h": 3600, "D": 86400}))),
    "monte_carlo_summary": lambda s, d: rounded(b.monte_carlo_summary(b.monte_carlo(_net(s, d)))),
    "monte_carlo_trades": lambda s, d: rounded(b.monte_carlo_summary(b.monte_carlo(b.trade_returns(_run(s, d))))),
    "random_search": lambda s, d: rounded(b.grid_search(bars(s, d), "turtle", _SEARCH_3)),
    "walk_forward_returns": lambda s, d: rounded(b.walk_forward_returns(bars(s, d), "turtle", _POINTS)),
    "select_symbols": lambda s, d: rounded(b.passing_symbols(b.metrics(_run(s, d)), -0.5).select("symbol", "sharpe")),
    "grid_top": lambda s, d: rounded(b.top_points(b.grid_search(bars(s, d), "turtle", _POINTS))),
    "grid_heat_map": lambda s, d: rounded(b.heat_map(b.grid_search(bars(s, d), "turtle", _POINTS), _POINTS, "entry", "leave")),
    "batch_runs": lambda s, d: rounded(b.batch(bars(s, d), _JOBS)),
    "compare_runs": lambda s, d: rounded(b.compare_runs(_equity(s, d))),
    "compare_curves": lambda s, d: rounded(b.rebased_curves(_equity(s, d))),
    "backtest_targets": lambda s, d: rounded(b.targets(_run(s, d))),
    "backtest_orders": lambda s, d: rounded(b.orders(b.targets(_run(s, d)), _positions(s, d), 1_000_000.0)),
    "backtest_event_costs": lambda s, d: rounded(b.event_costs(_turtle_bars(s, d)).select("symbol", "ts", "events", "gross_ret", "net_ret")),
    "backtest_split_metrics": lambda s, d: rounded(b.split_metrics(b.event_costs(_turtle_bars(s, d)), "1999-01-01")),
    "backtest_next_open": lambda s, d: rounded(b.next_open(_turtle_bars(s, d)).select("symbol", "ts", F.col("active").cast("int").alias("active"), "raw_ret", "net_ret")),
    "regime_ar_filter": lambda s, d: rounded(b.ar_filter(bars(s, d)).select("symbol", "ts", "phi", "phi_t", "vol", "high_vol", "regime", "score"), 4),
    "regime_garch_fit": lambda s, d: rounded(b.garch_fit(bars(s, d)), 4),
    "regime_garch": lambda s, d: rounded(b.garch_regimes(bars(s, d)), 4),
    "weights_sweep": lambda s, d: rounded(b.weight_sweep(bars(s, d))),
    "series_metrics": lambda s, d: rounded(m.series_metrics(bars(s, d)), 4),
    "series_alpha": lambda s, d: rounded(m.jensens_alpha(bars(s, d), "S00")),
    "series_to_date": lambda s, d: rounded(m.to_date_returns(bars(s, d), "1998-08-20")),
    "series_correlations": lambda s, d: rounded(m.column_correlations(bars(s, d), ["open", "high", "low", "close", "volume"], ("symbol",))),
}

_UP = "(PARTITION BY {by} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PATHS = """rp AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, ret FROM port), nr AS (SELECT count(*) AS n FROM rp),
dr AS (SELECT sim, t, ('0x' || substr(md5('42:' || sim::VARCHAR || ':' || t::VARCHAR), 1, 8))::BIGINT % n AS i FROM nr, generate_series(0, 99) a(sim), generate_series(0, (SELECT n - 1 FROM nr)) b(t)),
pc AS (SELECT sim, t, ret, sum(ret) OVER (PARTITION BY sim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM dr JOIN rp USING (i)),
pd AS (SELECT sim, ret, exp(c - greatest(0.0::DOUBLE, max(c) OVER (PARTITION BY sim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) - 1 AS d FROM pc),
pt AS (SELECT sim, exp(sum(ret)) AS e, min(d) AS d FROM pd GROUP BY sim)
SELECT count(*) AS simulations, round(avg(d), 6) AS avg_drawdown, round(min(d), 6) AS worst_drawdown, round(quantile_cont(e, 0.5), 6) AS median_end_value, round(avg((d < -0.5)::INTEGER::DOUBLE), 6) AS ruin_share FROM pt"""
_SEARCHED = f"""{_grid_sql()}, c AS (SELECT *, sum(ret) {_CUM.format(by="param_id")} AS c FROM port), d AS (SELECT *, exp(c - max(c) {_CUM.format(by="param_id")}) - 1 AS d FROM c),
gs AS (SELECT param_id, sum(ret) AS log_return, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0::DOUBLE) AS sharpe, min(d) AS max_drawdown FROM d GROUP BY param_id)"""
_COMPARED = "round(sum(ret), 6) AS log_return, round(sum(ret) * 365.0::DOUBLE / nullif(max(ts)::DATE - min(ts)::DATE, 0), 6) AS annual_log, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0::DOUBLE), 6) AS sharpe, round(min(d), 6) AS max_drawdown"


def _job(k: int, name: str, params: dict, symbols: list[str] | None) -> str:
    sql = _turtle(params["entry"], params["leave"], out=f"j{k}")
    for x in ("t", "e0", "e1"):
        sql = sql.replace(f"{x} AS (", f"{x}_{k} AS (").replace(f"FROM {x})", f"FROM {x}_{k})").replace(f"FROM {x} ", f"FROM {x}_{k} ")
    if symbols:
        sql = sql.replace("FROM bars)", "FROM (SELECT * FROM bars WHERE symbol IN (" + ", ".join(f"'{x}'" for x in symbols) + ")))")
    return f"""{sql}, r{k} AS (SELECT *, coalesce(lag(signal::DOUBLE) OVER w, 0.0::DOUBLE) AS position, ln(close / nullif(lag(close) OVER w, 0)) AS lr FROM j{k} {_W}),
n{k} AS (SELECT *, position * lr - coalesce(abs(position - lag(position) OVER w), 0.0::DOUBLE) * 0.001::DOUBLE AS net FROM r{k} {_W}),
p{k} AS (SELECT '{name}' AS job_id, 'turtle' AS strategy, ts, ln(1 + sum(coalesce(exp(net) - 1, 0.0::DOUBLE)) / (SELECT count(DISTINCT symbol) FROM n{k})) AS ret FROM n{k} GROUP BY ts)"""


_TARGETS = f"""{_RUN}, la AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), tt AS (SELECT sum(abs(size)) AS total FROM la),
tg AS (
  SELECT symbol, ts, close, signal::INTEGER AS signal, CASE WHEN size > 0 AND position <= 0 THEN 'BUY' WHEN size < 0 AND position >= 0 THEN 'SELL_SHORT' WHEN size = 0 AND position <> 0 THEN 'CLOSE'
         WHEN ((size > 0 AND position > 0) OR (size < 0 AND position < 0)) AND abs(size - position) > 0.1 THEN 'REBALANCE' ELSE 'HOLD' END AS action, position AS holds, CASE WHEN total > 1 THEN size / total ELSE size END AS target FROM la, tt)"""
_EVENTS = f"""{_FIRST}, {_turtle(20, 10)}, ch AS (SELECT *, lag(signal) OVER w AS s1, lag(close) OVER w AS c1 FROM sig {_W}),
ev AS (SELECT *, (signal IS DISTINCT FROM s1 AND signal <> 0)::INTEGER + (signal IS DISTINCT FROM s1 AND coalesce(s1 <> 0, true))::INTEGER AS events, coalesce(signal * (close / nullif(c1, 0) - 1), 0) AS gross_ret FROM ch),
en AS (SELECT *, gross_ret - events * 7.0::DOUBLE / 10000 AS net_ret FROM ev)"""
_AR = f"""{_FIRST}, a0 AS (SELECT *, ln(close / nullif(lag(close) OVER w, 0)) AS ret FROM bars {_W}), a1 AS (SELECT *, lag(ret) OVER w AS x FROM a0 {_W}),
a2 AS (SELECT *, CASE WHEN count(x) OVER v = 60 THEN var_samp(x) OVER v END AS vx, CASE WHEN count(x) OVER v = 60 THEN avg(ret) OVER v END AS my, CASE WHEN count(x) OVER v = 60 THEN avg(x) OVER v END AS mx, CASE WHEN count(x) OVER v = 60 THEN covar_samp(x, ret) OVER v END AS cv
  FROM a1 WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
a3 AS (SELECT *, cv / nullif(vx + {{eps}}, 0) AS phi FROM a2), a4 AS (SELECT *, (ret - (my - phi * mx) - phi * x) ** 2 AS e2 FROM a3),
a5 AS (SELECT *, phi / nullif(sqrt({_roll("sum", "e2", 60)} / 58 / nullif(59 * vx, 0)), 0) AS phi_t, {_roll("stddev_samp", "ret", 60)} AS vol FROM a4),
a6 AS (SELECT *, coalesce(vol > CASE WHEN count(vol) OVER q >= 60 THEN quantile_cont(vol, 0.8) OVER q END, false) AS high_vol FROM a5 WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
ar AS (SELECT *, CASE WHEN abs(phi_t) >= 2 AND phi > 0.05 THEN 'momentum' WHEN abs(phi_t) >= 2 AND phi < -0.05 THEN 'mean_reversion' ELSE 'neutral' END AS regime, greatest(-10, least(10, phi * abs(phi_t))) AS score FROM a6)"""
_GRID = ", ".join(f"({k}, {p!r}::DOUBLE, {a!r}::DOUBLE, {bb!r}::DOUBLE)" for k, (p, a, bb) in enumerate(b.GARCH_GRID))
_FIT = f"""g1 AS (SELECT symbol, ts, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM a0 WHERE ret IS NOT NULL QUALIFY k <= 756),
g2 AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu, lag(ret) OVER w AS r1 FROM g1 {_W}),
g3 AS (SELECT g2.*, pt, p, al, be, ret - mu - p * coalesce(r1, 0) AS e FROM g2, (VALUES {_GRID}) v(pt, p, al, be)),
g4 AS MATERIALIZED (SELECT *, var_pop(e) OVER (PARTITION BY symbol, pt) AS va, lag(e) OVER (PARTITION BY symbol, pt ORDER BY ts) AS e1, row_number() OVER (PARTITION BY symbol, pt ORDER BY ts) AS i FROM g3),
gh AS (SELECT symbol, pt, i, va AS h FROM g4 WHERE i = 1 UNION ALL SELECT g4.symbol, g4.pt, g4.i, va * (1 - al - be) + al * e1 * e1 + be * gh.h FROM gh JOIN g4 ON g4.symbol = gh.symbol AND g4.pt = gh.pt AND g4.i = gh.i + 1),
gl AS (SELECT symbol, pt, sum(-0.5::DOUBLE * (ln(2 * pi()) + ln(h) + e * e / h)) AS ll, first(mu) AS mu, first(p) AS p, first(va * (1 - al - be)) AS om, first(al) AS al, first(be) AS be FROM g4 JOIN gh USING (symbol, pt, i) GROUP BY 1, 2),
gf AS (SELECT * FROM gl QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(ll, 6) DESC, pt) = 1)"""
_AR_PLAIN, _AR_EPS = _AR.format(eps="0"), _AR.format(eps="1e-12::DOUBLE").replace("WITH ", "WITH RECURSIVE ", 1)

ORACLE_SQL = {
    "backtest_trailing_stop": f"""{_FIRST}, {_turtle(20, 10, "hold")}, n AS (SELECT symbol, ts, high, low, close, signal, coalesce(signal <> lag(signal) OVER w, true)::INTEGER AS new_ FROM sig {_W}), m AS (SELECT *, sum(new_) {_CUM.format(by="symbol")} AS run_ FROM n),
h AS (SELECT *, CASE WHEN (signal > 0 AND low <= max(close) OVER v * (1 - 0.05::DOUBLE)) OR (signal < 0 AND high >= min(close) OVER v * (1 + 0.05::DOUBLE)) THEN 1 ELSE 0 END AS hit FROM m WINDOW v AS (PARTITION BY symbol, run_ ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, (CASE WHEN max(hit) {_CUM.format(by="symbol, run_")} = 1 THEN 0 ELSE signal END)::INTEGER AS signal FROM h""",
    "backtest_frames": f"""WITH {TICKS_SQL}, fb AS (SELECT symbol, frame, to_timestamp(floor(epoch(ts) / s) * s)::TIMESTAMP AS b, last(price ORDER BY ts, seq) AS close FROM ticks, (VALUES ('30m', 1800, 3276), ('1h', 3600, 1764), ('D', 86400, 252)) f(frame, s, x) GROUP BY 1, 2, 3),
r AS (SELECT symbol, frame, CASE frame WHEN '30m' THEN 3276 WHEN '1h' THEN 1764 ELSE 252 END AS factor, ln(close / nullif(lag(close) OVER (PARTITION BY symbol, frame ORDER BY b), 0)) AS r FROM fb)
SELECT symbol, frame, count(r) AS n, factor, round(avg(r) * factor, 6) AS annual_log, round(stddev_samp(r) * sqrt(factor), 6) AS volatility, round(avg(r) * factor / nullif(stddev_samp(r) * sqrt(factor), 0), 6) AS sharpe FROM r GROUP BY symbol, frame, factor""",
    "monte_carlo_summary": f"{_NET}, {_PATHS}",
    "monte_carlo_trades": f"{_TRADES}, port AS (SELECT row_number() OVER (ORDER BY opened, symbol) AS ts, ln(1 + greatest(ret, -0.9999::DOUBLE)) AS ret FROM tr), {_PATHS}",
    "random_search": f"{_SEARCHED}, pk AS (SELECT param_id FROM gs ORDER BY md5('42:' || param_id::VARCHAR) LIMIT 3) SELECT (row_number() OVER (ORDER BY param_id) - 1)::INTEGER AS param_id, round(log_return, 6) AS log_return, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM gs JOIN pk USING (param_id)",
    "walk_forward_returns": f"""{_grid_sql()}, dy AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM port)), wn AS (SELECT unnest(generate_series(0, greatest(0, ((SELECT max(i) FROM dy) - 252) // 63)))::INTEGER AS wd),
rw AS (SELECT wd, param_id, ts, ret, i < wd * 63 + 252 AS tr FROM port JOIN dy USING (ts) JOIN wn ON i >= wd * 63 AND i < wd * 63 + 315),
s AS (SELECT wd, param_id, avg(CASE WHEN tr THEN ret END) / nullif(stddev_samp(CASE WHEN tr THEN ret END), 0) AS sh, count(CASE WHEN NOT tr THEN 1 END) AS n FROM rw GROUP BY 1, 2),
bs AS (SELECT wd, param_id FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY wd ORDER BY sh DESC, param_id) = 1)
SELECT ts, wd AS "window", param_id, round(ret, 6) AS ret, round(sum(ret) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS log_equity FROM rw JOIN bs USING (wd, param_id) WHERE NOT tr""",
    "select_symbols": f"{_RUN} SELECT symbol, round((exp(avg(net) * 252) - 1) / nullif(stddev_samp(net) * sqrt(252.0::DOUBLE), 0), 6) AS sharpe FROM run WHERE net IS NOT NULL GROUP BY symbol HAVING (exp(avg(net) * 252) - 1) / nullif(stddev_samp(net) * sqrt(252.0::DOUBLE), 0) >= -0.5",
    "grid_top": f"{_SEARCHED} SELECT param_id, round(log_return, 6) AS log_return, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM gs ORDER BY gs.sharpe DESC, param_id LIMIT 5",
    "grid_heat_map": f"{_SEARCHED}, pp(param_id, en, leave) AS (VALUES {', '.join(f'({k}, {p["entry"]}, {float(p["leave"])!r}::DOUBLE)' for k, p in enumerate(_POINTS))}) SELECT leave, "
    + ", ".join(f"round(avg(sharpe) FILTER (WHERE en = {x}), 6) AS entry_{x}" for x in sorted({p["entry"] for p in _POINTS}))
    + " FROM gs JOIN pp USING (param_id) GROUP BY leave",
    "batch_runs": f"""{_FIRST}, {", ".join(_job(k, name, params, symbols) for k, (name, _, params, symbols) in enumerate(_JOBS))}, port AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1),
c AS (SELECT *, sum(ret) OVER {_UP.format(by="job_id")} AS c FROM port), d AS (SELECT *, exp(c - max(c) OVER {_UP.format(by="job_id")}) - 1 AS d FROM c) SELECT job_id, strategy, {_COMPARED} FROM d GROUP BY 1, 2""",
    "compare_runs": f"{_grid_sql()}, c AS (SELECT *, sum(ret) OVER {_UP.format(by='param_id')} AS c FROM port), d AS (SELECT *, exp(c - max(c) OVER {_UP.format(by='param_id')}) - 1 AS d FROM c) SELECT param_id, {_COMPARED} FROM d GROUP BY 1",
    "compare_curves": f"{_grid_sql()}, c AS (SELECT *, sum(ret) OVER {_UP.format(by='param_id')} AS c FROM port) SELECT param_id, ts, round(c - first_value(c) OVER {_UP.format(by='param_id')}, 6) AS log_equity FROM c",
    "backtest_targets": f"{_TARGETS} SELECT symbol, ts, round(close, 6) AS close, signal, action, round(holds, 6) AS holds, round(target, 6) AS target FROM tg",
    "backtest_orders": f"""{_TARGETS}, po AS (SELECT symbol, (sum(volume) % 7 - 3)::BIGINT AS quantity FROM trades GROUP BY symbol), od AS (SELECT symbol, (sign(target) * floor(abs(1000000.0::DOUBLE * target / nullif(close, 0))))::BIGINT AS target_shares, coalesce(quantity, 0)::BIGINT AS held FROM tg LEFT JOIN po USING (symbol))
SELECT symbol, target_shares, held, CASE WHEN target_shares > held THEN 'buy' ELSE 'sell' END AS side, abs(target_shares - held) AS quantity FROM od WHERE target_shares <> held""",
    "backtest_event_costs": f"{_EVENTS} SELECT symbol, ts, events, round(gross_ret, 6) AS gross_ret, round(net_ret, 6) AS net_ret FROM en",
    "backtest_split_metrics": f"""{_EVENTS}, sp AS (SELECT *, CASE WHEN ts::DATE < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS dataset FROM en), c AS (SELECT *, sum(ln(1 + greatest(net_ret, -0.9999::DOUBLE))) OVER {_UP.format(by="symbol, dataset")} AS c FROM sp),
d AS (SELECT *, exp(c - max(c) OVER {_UP.format(by="symbol, dataset")}) - 1 AS d FROM c), g AS (SELECT symbol, dataset, exp(sum(ln(1 + greatest(net_ret, -0.9999::DOUBLE))) * 365 / greatest(1, max(ts)::DATE - min(ts)::DATE)::DOUBLE) - 1 AS cagr, avg(net_ret) * 252 AS mu, stddev_samp(net_ret) * sqrt(252.0::DOUBLE) AS sd,
  stddev_samp(CASE WHEN net_ret < 0 THEN net_ret END) * sqrt(252.0::DOUBLE) AS dn, min(d) AS md, avg(CASE WHEN net_ret <> 0 THEN (net_ret > 0)::INTEGER::DOUBLE END) AS wr, sum(events)::BIGINT AS events FROM d GROUP BY 1, 2)
SELECT symbol, dataset, round(cagr, 6) AS cagr, round(mu / nullif(sd, 0), 6) AS sharpe, round(mu / nullif(dn, 0), 6) AS sortino, round(md, 6) AS max_drawdown, round(abs(cagr / nullif(md, 0)), 6) AS calmar, round(wr, 6) AS win_rate, events FROM g""",
    "backtest_next_open": f"""{_FIRST}, {_turtle(20, 10)}, ac AS (SELECT *, coalesce(lag(signal) OVER w, 0) AS active, lag(close) OVER w AS c1 FROM sig {_W}), ae AS (SELECT *, lag(active) OVER w AS a1 FROM ac {_W}),
af AS (SELECT *, active <> 0 AND active IS DISTINCT FROM a1 AS enters, active = 0 AND NOT coalesce(a1 = 0, false) AS leaves FROM ae),
ag AS (SELECT *, CASE WHEN enters THEN close / nullif(open, 0) - 1 WHEN leaves THEN open / nullif(c1, 0) - 1 WHEN active <> 0 THEN close / nullif(c1, 0) - 1 ELSE 0 END AS raw FROM af)
SELECT symbol, ts, active::INTEGER AS active, round(raw, 6) AS raw_ret, round(raw * active - (enters OR leaves)::INTEGER * 5.0::DOUBLE / 10000, 6) AS net_ret FROM ag""",
    "regime_ar_filter": f"{_AR_PLAIN} SELECT symbol, ts, round(phi, 4) AS phi, round(phi_t, 4) AS phi_t, round(vol, 4) AS vol, high_vol, regime, round(score, 4) AS score FROM ar",
    "regime_garch_fit": f"{_FIRST.replace('WITH ', 'WITH RECURSIVE ', 1)}, a0 AS (SELECT *, ln(close / nullif(lag(close) OVER w, 0)) AS ret FROM bars {_W}), {_FIT} SELECT symbol, round(mu, 4) AS mu, round(p, 4) AS phi, round(om, 4) AS omega, round(al, 4) AS alpha, round(be, 4) AS beta, round(ll, 4) AS loglik, round(al + be, 4) AS persistence FROM gf",
    "regime_garch": f"""{_AR_EPS}, {_FIT}, s1 AS (SELECT ar.*, mu, om, al, be, ret - mu - p * coalesce(lag(ret) OVER w, 0) AS e FROM ar JOIN gf USING (symbol) WINDOW w AS (PARTITION BY ar.symbol ORDER BY ts)),
s2 AS MATERIALIZED (SELECT *, lag(e) OVER w AS e1, row_number() OVER w AS i FROM s1 {_W}), sh AS (SELECT symbol, i, NULL::DOUBLE AS h FROM s2 WHERE i = 1
  UNION ALL SELECT s2.symbol, s2.i, CASE WHEN e1 IS NULL THEN om / (1 - al - be) ELSE om + al * e1 * e1 + be * sh.h END FROM sh JOIN s2 ON s2.symbol = sh.symbol AND s2.i = sh.i + 1),
s3 AS (SELECT s2.*, sqrt(h) AS cond_vol FROM s2 JOIN sh USING (symbol, i)), s4 AS (SELECT *, CASE WHEN count(cond_vol) OVER q >= 84 THEN quantile_cont(cond_vol, 0.8) OVER q END AS lim FROM s3 WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
s5 AS (SELECT *, CASE WHEN cond_vol IS NULL THEN 'unknown' WHEN coalesce(cond_vol > lim, false) THEN 'high_vol' ELSE 'normal_vol' END AS vol_regime FROM s4)
SELECT symbol, ts, round(cond_vol, 4) AS cond_vol, round(e / (cond_vol + 1e-12::DOUBLE), 4) AS z, vol_regime, regime,
       CASE WHEN vol_regime = 'high_vol' AND coalesce(abs(score) < 1, true) THEN 'risk_off' WHEN regime = 'momentum' AND vol_regime = 'normal_vol' THEN 'trend_ok' WHEN regime = 'mean_reversion' THEN 'mean_reversion_risk' ELSE 'neutral' END AS combined FROM s5""",
    "weights_sweep": f"""{_FIRST}, r AS (SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars {_W}), cv AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM r a JOIN r b ON a.ts = b.ts AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2),
mn AS (SELECT symbol, avg(ret) * 252 AS mu, row_number() OVER (ORDER BY symbol) - 1 AS i, count(*) OVER () AS n FROM r WHERE ret IS NOT NULL GROUP BY symbol),
ea AS (SELECT k, symbol, mu, CASE WHEN k = 0 THEN 1.0::DOUBLE WHEN k < 0 THEN (i = -k - 1)::INTEGER::DOUBLE ELSE -ln((('0x' || substr(md5('42:' || k::VARCHAR || ':' || i::VARCHAR), 1, 8))::BIGINT + 1)::DOUBLE / 4294967297.0::DOUBLE) END AS w0 FROM mn, generate_series(-100, 200) g(k) WHERE k >= -n),
eb AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY k) AS wt FROM ea), va AS (SELECT x.k, sum(x.wt * y.wt * cov) AS v FROM eb x JOIN eb y ON x.k = y.k JOIN cv ON cv.a = x.symbol AND cv.b = y.symbol GROUP BY 1),
fo AS (SELECT k, round(v, 9) AS v, round(mu / nullif(sqrt(v), 0), 9) AS s FROM va JOIN (SELECT k, sum(wt * mu) AS mu FROM eb GROUP BY k) USING (k)),
bs AS (SELECT 'min_variance' AS kind, (SELECT k FROM fo ORDER BY v, k LIMIT 1) AS k UNION ALL SELECT 'max_sharpe', (SELECT k FROM fo ORDER BY s DESC, k LIMIT 1) UNION ALL SELECT 'equal', 0)
SELECT kind, symbol, round(wt, 6) AS weight FROM eb JOIN bs USING (k)""",
    "series_metrics": f"""{_FIRST}, a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, max(close) OVER u AS top, row_number() OVER w - 1 AS i, max(ts) OVER (PARTITION BY symbol) AS en FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, epoch(ts) > epoch(en) - 94672800 AS late FROM a), c AS (SELECT *, CASE WHEN late THEN 1 - close / max(CASE WHEN late THEN close END) OVER u END AS ld FROM b WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, count(*) AS n, arg_min(close, ts) AS x0, arg_max(close, ts) AS x1, avg(r) AS m, stddev_samp(r) AS sd, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS dn, max(top - close) AS dd, max(1 - close / top) AS dp, max(ln(top) - ln(close)) AS dl,
  arg_min(close, ts) FILTER (WHERE late) AS y0, floor((epoch(max(ts)) - epoch(min(ts) FILTER (WHERE late))) / 86400) / {m.YEAR_DAYS!r}::DOUBLE AS ly, max(ld) AS ld, corr(i, close) AS st, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / {m.YEAR_DAYS!r}::DOUBLE AS years FROM c GROUP BY symbol),
h AS (SELECT *, pow(x1 / x0, 1 / years) - 1 AS cagr, sqrt(dn / (n - 1)) * sqrt(n / years) AS down FROM g)
SELECT symbol, round(years, 4) AS years, round(cagr, 4) AS cagr, round(sqrt(n / years) * sd, 4) AS volatility, round(252 * m / (sqrt(252.0::DOUBLE) * sd), 4) AS sharpe, round(down, 4) AS downside, round(cagr / down, 4) AS sortino, round((pow(x1 / y0, 1 / ly) - 1) / ld, 4) AS calmar,
       round(dd, 4) AS drawdown, round(dp, 4) AS drawdown_pct, round(dl, 4) AS drawdown_log, round(ln(x1) - ln(x0) - dl, 4) AS log_max_drawdown, round(252 * m / (252 * sd * sd), 4) AS optimal_leverage, round(st * cagr, 4) AS pure_profit FROM h""",
    "series_alpha": f"""{_FIRST}, r AS (SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars {_W}), g AS (SELECT a.symbol, count(*) AS n, regr_intercept(a.ret, b.ret) AS a, regr_slope(a.ret, b.ret) AS b, corr(a.ret, b.ret) AS r FROM r a JOIN r b ON a.ts = b.ts AND b.symbol = 'S00' AND a.symbol <> 'S00' AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1)
SELECT symbol, n, round(a, 6) AS a, round(b, 6) AS b, round(r, 6) AS r, round(r * sqrt(n - 2) / nullif(sqrt(1 - r * r), 0), 6) AS t FROM g""",
    "series_to_date": f"{_FIRST} SELECT symbol, " + ", ".join(f"round(arg_max(close, ts) FILTER (WHERE {on}) / nullif(arg_min(close, ts) FILTER (WHERE {on}), 0) - 1, 6) AS \"{u}\", count(*) FILTER (WHERE {on}) AS {u}_bars" for u in ("month", "quarter", "year") for on in [f"ts >= date_trunc('{u}', TIMESTAMP '1998-08-20') AND ts <= TIMESTAMP '1998-08-20'"]) + " FROM bars GROUP BY symbol",
    "series_correlations": f"{_FIRST} " + " UNION ALL ".join(f"SELECT symbol, '{x}' AS a, '{y}' AS b, round(corr({min(x, y)}, {max(x, y)}), 6) AS corr FROM bars GROUP BY symbol" for x in ("open", "high", "low", "close", "volume") for y in ("open", "high", "low", "close", "volume")),
}
