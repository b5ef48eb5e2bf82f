"""Queries of entity tables, screens, seasons and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import backtest as b
from lodestar.operators import pairs as pr
from lodestar.operators import records as rec
from lodestar.operators import strategy as st
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _W, _roll
from lodestar.plans.markets import _GRID, _all_rows, _packed, _rows
from lodestar.plans.strategies import _FIRST, _NET, _net, _run, _turtle
from lodestar.sources.bridge import BARS_SQL, TRADES_SQL, bars, table, trades


def _screens(s, d):
    t = trades(s, d)
    cheap = t.where("price < 1500").groupBy("symbol").agg(F.avg("price").alias("price"), F.count("*").alias("n"))
    busy = t.where("volume > 40 and symbol <> 'S03'").groupBy("symbol").agg(F.avg("price").alias("price"), F.sum("volume").alias("volume"))
    return cheap.where("symbol <> 'S01'"), busy


def _entities(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal", "s_nationkey")


def _events(s, d):
    n = table(s, d, "supplier").count()
    rows = table(s, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % (n + 3) + 1).alias("other")).agg(F.count("*").alias("meetings"))
    return rec.with_both_entities(rows, _entities(s, d), "l_suppkey", "other", "key").withColumn("gap", F.col("s_acctbal_1") - F.col("s_acctbal_2"))


def _games(s, d):
    return trades(s, d).select(F.col("symbol").alias("team"), F.year("ts").alias("year"), "price", "volume").where("not (team = 'S02' and year = 1998) and not (team = 'S04' and year >= 1999)")


def _wanted(s, d):
    return trades(s, d).select(F.col("symbol").alias("team")).distinct().withColumn("year", F.explode(F.array(*map(F.lit, (1998, 1999, 2000)))))


def _enter(s, d):
    return bars(s, d).withColumn("enter", F.coalesce((F.col("close") > F.lag("close").over(rec.by_time())).cast("int"), F.lit(0)))


def _report(s, d, rows=_rows, lags=5):
    rows = rows(s, d)
    packed = _packed(rows, s, d, lags)
    wide = pr.correlations(packed)
    return rec.pair_report(pr.best_lags(packed, wide, lags), pr.spreads(rows, wide), 0.05)


QUERIES = {
    "screen_union": lambda s, d: rounded(rec.union_screens(*_screens(s, d))),
    "screen_merge": lambda s, d: rounded(rec.merge_on(*_screens(s, d))),
    "screen_price_filter": lambda s, d: rounded(rec.price_filter(rec.merge_on(*_screens(s, d)), 500.0, 2000.0)),
    "entity_pairs": lambda s, d: rounded(_events(s, d)),
    "entity_numbers": lambda s, d: rec.plain_numbers(table(s, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" cm")).alias("size"), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("price"), F.col("p_brand").alias("brand")), ["size", "price", "brand"]),
    "entity_age": lambda s, d: rounded(table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("born")).select("o_custkey", rec.age(F.col("born"), "2010-01-01").alias("age"))),
    "season_averages": lambda s, d: rounded(rec.season_averages(_games(s, d), _wanted(s, d), ["price", "volume"])),
    "last_bars": lambda s, d: rec.last_bars(bars(s, d)),
    "trade_overlay": lambda s, d: rounded(rec.overlay(_net(s, d).withColumn("log_equity", F.sum("ret").over(rec.Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(rec.Window.unboundedPreceding, 0))), b.transactions(_run(s, d)).select("symbol", "ts", "action", "quantity"))),
    "benchmark_alignment": lambda s, d: rounded(rec.against_benchmark(_net(s, d), bars(s, d).where("symbol = 'S00'"))),
    "entry_simulation": lambda s, d: rounded(rec.simulate_entries(_enter(s, d))),
    "pair_report": lambda s, d: rounded(_report(s, d)),
    "pair_report_summary": lambda s, d: rounded(rec.report_summary(_report(s, d))),
    "pair_report_whole": lambda s, d: rounded(_report(s, d, _all_rows, 20)),
    "pair_report_summary_whole": lambda s, d: rounded(rec.report_summary(_report(s, d, _all_rows, 20))),
    "pair_coverage": lambda s, d: rounded(rec.covered(bars(s, d), 1000, 0.2)),
    "factor_horizons": lambda s, d: rounded(rec.union_screens(*(pr.factor_quantiles(bars(s, d), k).withColumn("ahead", F.lit(k)) for k in (1, 5, 10)))),
    "calendar_month_edge": lambda s, d: rounded(rec.month_end_edge(bars(s, d))),
    "profile_times": lambda s, d: rec.time_ranges(table(s, d, "orders")),
    "profile_common": lambda s, d: rec.common_values(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]),
    "renko_range": lambda s, d: rounded(rec.renko_by_range(bars(s, d), volume="equal"), 4),
}

_SCREENS = f"""WITH {TRADES_SQL}, ch AS (SELECT symbol, avg(price) AS price, count(*) AS n FROM trades WHERE price < 1500 AND symbol <> 'S01' GROUP BY 1), bu AS (SELECT symbol, avg(price) AS price, sum(volume) AS volume FROM trades WHERE volume > 40 AND symbol <> 'S03' GROUP BY 1),
me AS (SELECT coalesce(ch.symbol, bu.symbol) AS symbol, coalesce(ch.price, bu.price) AS price, n, volume FROM ch FULL JOIN bu ON bu.symbol = ch.symbol)"""
_REPORT = f"""{_GRID}, lg AS (SELECT a.symbol AS a, b.symbol AS b, l.lag, corr(a.ret, b.ret) AS corr, count(*) AS n FROM rt a, (SELECT unnest(generate_series(-5, 5))::INTEGER AS lag) l, rt b WHERE b.i = a.i + l.lag AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) >= 30),
bl AS (SELECT a, b, lag, corr, CASE WHEN lag > 0 THEN a WHEN lag < 0 THEN b END AS leader FROM lg QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(corr), 9) DESC, lag) = 1),
lp AS (SELECT a.symbol AS a, b.symbol AS b, a.i, ln(a.close) AS la, ln(b.close) AS lb FROM rt a JOIN rt b ON a.i = b.i AND a.symbol < b.symbol),
ft AS (SELECT a, b, regr_slope(la, lb) AS beta, regr_intercept(la, lb) AS alpha FROM lp GROUP BY 1, 2), sp AS (SELECT lp.a, lp.b, i, alpha, beta, la - alpha - beta * lb AS s FROM lp JOIN ft ON ft.a = lp.a AND ft.b = lp.b),
dd AS (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY i) AS s1 FROM sp), g AS (SELECT a, b, first(alpha) AS alpha, first(beta) AS beta, count(*) AS n, regr_slope(s - s1, s1) AS k, regr_sxx(s - s1, s1) AS sxx, regr_syy(s - s1, s1) AS syy FROM dd WHERE s1 IS NOT NULL GROUP BY 1, 2),
rp AS (SELECT bl.*, alpha, beta, CASE WHEN k < 0 THEN -ln(2.0::DOUBLE) / k END AS half_life, k / sqrt((syy - k * k * sxx) / (n - 2) / sxx) AS t FROM bl JOIN g ON g.a = bl.a AND g.b = bl.b),
rs AS (SELECT *, abs(corr) * greatest(0, least(1, t / -3.34::DOUBLE)) AS score, abs(corr) >= 0.05 AND t <= -3.34 AS shortlisted FROM rp)"""

ORACLE_SQL = {
    "screen_union": f"{_SCREENS} SELECT symbol, round(price, 6) AS price, n, NULL::DOUBLE AS volume FROM ch UNION ALL SELECT symbol, round(price, 6) AS price, NULL, volume FROM bu",
    "screen_merge": f"{_SCREENS} SELECT symbol, round(price, 6) AS price, n, volume FROM me",
    "screen_price_filter": f"{_SCREENS} SELECT symbol, round(price, 6) AS price, n, volume FROM me WHERE price IS NULL OR price BETWEEN 500 AND 2000",
    "entity_pairs": """WITH ev AS (SELECT l_suppkey, l_partkey % ((SELECT count(*) FROM supplier) + 3) + 1 AS other, count(*) AS meetings FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, other, meetings, round(a.s_acctbal, 6) AS s_acctbal_1, a.s_nationkey AS s_nationkey_1, round(b.s_acctbal, 6) AS s_acctbal_2, b.s_nationkey AS s_nationkey_2, round(a.s_acctbal - b.s_acctbal, 6) AS gap FROM ev LEFT JOIN supplier a ON a.s_suppkey = l_suppkey LEFT JOIN supplier b ON b.s_suppkey = other""",
    "entity_numbers": "SELECT p_partkey, p_size::DOUBLE AS size, round(p_retailprice, 2)::DECIMAL(18, 2)::DOUBLE AS price, coalesce(try_cast(regexp_replace(p_brand, '[^0-9.]', '', 'g') AS DOUBLE), 0.0::DOUBLE) AS brand FROM part",
    "entity_age": "SELECT o_custkey, round((DATE '2010-01-01' - min(o_orderdate)::DATE) / 365.25::DOUBLE, 6) AS age FROM orders GROUP BY 1",
    "season_averages": f"""WITH {TRADES_SQL}, gm AS (SELECT symbol AS team, year(ts)::INTEGER AS year, price, volume FROM trades WHERE NOT (symbol = 'S02' AND year(ts) = 1998) AND NOT (symbol = 'S04' AND year(ts) >= 1999)),
wa AS (SELECT team, y::INTEGER AS year FROM (SELECT DISTINCT symbol AS team FROM trades), (VALUES (1998), (1999), (2000)) v(y)), ya AS (SELECT team, year, avg(price) AS p, avg(volume) AS v FROM gm GROUP BY 1, 2), ta AS (SELECT team, avg(price) AS p, avg(volume) AS v FROM gm GROUP BY 1)
SELECT wa.team, wa.year, round(CASE WHEN o.team IS NOT NULL THEN o.p WHEN l.team IS NOT NULL THEN l.p ELSE ta.p END, 6) AS price, round(CASE WHEN o.team IS NOT NULL THEN o.v WHEN l.team IS NOT NULL THEN l.v ELSE ta.v END, 6) AS volume,
       CASE WHEN o.team IS NOT NULL THEN 'season' WHEN l.team IS NOT NULL THEN 'season before' ELSE 'all' END AS basis FROM wa LEFT JOIN ya o ON o.team = wa.team AND o.year = wa.year LEFT JOIN ya l ON l.team = wa.team AND l.year = wa.year - 1 LEFT JOIN ta ON ta.team = wa.team""",
    "last_bars": f"WITH {BARS_SQL} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60",
    "trade_overlay": f"""{_NET}, eq AS (SELECT ts, sum(ret) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM port), ch AS (SELECT symbol, ts, position - coalesce(lag(position) OVER w, 0.0::DOUBLE) AS quantity FROM run {_W})
SELECT symbol, ts, CASE WHEN quantity > 0 THEN 'BUY' ELSE 'SELL' END AS action, round(quantity, 6) AS quantity, round(e, 6) AS log_equity FROM ch JOIN eq USING (ts) WHERE quantity <> 0""",
    "benchmark_alignment": f"{_NET} SELECT p.ts, round(ret, 6) AS ret, round(b.close, 6) AS asof_close FROM port p ASOF LEFT JOIN (SELECT ts, close FROM bars WHERE symbol = 'S00') b ON b.ts <= p.ts",
    "entry_simulation": f"""{_FIRST.replace("WITH ", "WITH RECURSIVE ", 1)}, en AS MATERIALIZED (SELECT symbol, ts, close, coalesce(close > lag(close) OVER w, false) AS en, row_number() OVER w AS i, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1 AS last FROM bars {_W}),
si AS (SELECT symbol, 0::BIGINT AS i, 1.0::DOUBLE AS cap, 0.0::DOUBLE AS units, 0.0::DOUBLE AS price, 0 AS held, NULL::DOUBLE AS sold, NULL::DOUBLE AS profit FROM en WHERE i = 1
  UNION ALL
  SELECT symbol, i, CASE WHEN closes THEN c1 + u1 * out * (1 - 0.005::DOUBLE / 100) ELSE c1 END, CASE WHEN closes THEN 0.0::DOUBLE ELSE u1 END, p1, h1, CASE WHEN closes THEN out END, CASE WHEN closes THEN (out - p1) * u1 - u1 * out * 0.005::DOUBLE / 100 END FROM (
    SELECT *, u1 > 0 AND ((u0 > 0 AND (NOT en OR h1 >= 10)) OR last) AS closes, CASE WHEN u0 > 0 AND (NOT en OR h1 >= 10) THEN close * (1 - 0.01::DOUBLE / 100) ELSE close END AS out FROM (
      SELECT en.symbol, en.i, en.close, en.en, en.last, s.units AS u0, CASE WHEN s.units = 0 AND en.en THEN s.cap * 0.1::DOUBLE / (en.close * (1 + 0.01::DOUBLE / 100)) ELSE s.units END AS u1, CASE WHEN s.units = 0 AND en.en THEN en.close * (1 + 0.01::DOUBLE / 100) ELSE s.price END AS p1,
        CASE WHEN s.units = 0 AND en.en THEN s.cap - s.cap * 0.1::DOUBLE - s.cap * 0.1::DOUBLE * 0.005::DOUBLE / 100 ELSE s.cap END AS c1, CASE WHEN s.units = 0 AND en.en THEN 0 WHEN s.units > 0 THEN s.held + 1 ELSE s.held END AS h1
      FROM si s JOIN en ON en.symbol = s.symbol AND en.i = s.i + 1)))
SELECT si.symbol, ts, round(price, 6) AS entry, round(sold, 6) AS exit, round(profit, 6) AS profit, round(cap, 6) AS capital, CASE WHEN profit > 0 THEN 'Win' WHEN profit < 0 THEN 'Loss' ELSE 'Break Even' END AS outcome FROM si JOIN en USING (symbol, i) WHERE sold IS NOT NULL""",
    "pair_report": f"{_REPORT} SELECT a, b, lag, round(corr, 6) AS corr, leader, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(half_life, 6) AS half_life, round(t, 6) AS t, round(score, 6) AS score, shortlisted, (row_number() OVER (ORDER BY round(score, 9) DESC, a, b))::INTEGER AS rank FROM rs",
    "pair_report_summary": f"{_REPORT} SELECT count(*) AS pairs, sum(shortlisted::INTEGER)::BIGINT AS shortlisted, round(avg(abs(corr)), 6) AS mean_corr, round(max(score), 6) AS best_score FROM rs",
    "pair_coverage": f"WITH {BARS_SQL}, tm AS (SELECT DISTINCT ts FROM bars ORDER BY ts DESC LIMIT 1000), cv AS (SELECT symbol, count(*)::DOUBLE / (SELECT count(*) FROM tm) AS c FROM bars WHERE ts IN (SELECT ts FROM tm) GROUP BY 1) SELECT symbol, round(c, 6) AS coverage FROM cv WHERE c >= 0.2",
    "factor_horizons": f"WITH {BARS_SQL}, " + ", ".join(f"f{k} AS (SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS f, lead(close, {k}) OVER w / nullif(close, 0) - 1 AS fwd FROM bars {_W}), n{k} AS (SELECT *, ntile(2) OVER (PARTITION BY ts ORDER BY f, symbol) AS bin FROM f{k} WHERE f IS NOT NULL AND fwd IS NOT NULL)" for k in (1, 5, 10))
    + " " + " UNION ALL ".join(f"SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(fwd), 6) AS fwd_mean, {k} AS ahead FROM n{k} GROUP BY 1" for k in (1, 5, 10)),
    "calendar_month_edge": f"""{_FIRST}, r AS (SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER m AS st, row_number() OVER m - count(*) OVER (PARTITION BY symbol, year(ts), month(ts)) AS off FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), m AS (PARTITION BY symbol, year(ts), month(ts) ORDER BY ts)),
q AS (SELECT * FROM r WHERE ret IS NOT NULL), md AS (SELECT symbol, avg(ret) AS mid FROM q WHERE off < -5 GROUP BY 1), u AS (SELECT symbol, 'end' AS side, off AS k, ret FROM q WHERE off >= -5 UNION ALL SELECT symbol, 'start', st, ret FROM q WHERE st <= 5)
SELECT symbol, side, k AS "offset", count(*) AS n, round(avg(ret), 6) AS mean, round(mid, 6) AS mid_mean, round(avg(ret) - mid, 6) AS edge FROM u LEFT JOIN md USING (symbol) GROUP BY symbol, side, k, mid""",
    "profile_times": "SELECT 'o_orderdate' AS \"column\", min(o_orderdate)::TIMESTAMP AS first, max(o_orderdate)::TIMESTAMP AS last FROM orders",
    "profile_common": """WITH l AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders), n AS (SELECT c, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2), k AS (SELECT c, count(*) AS d FROM n GROUP BY 1),
t AS (SELECT c, v, n, d, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r FROM n JOIN k USING (c) WHERE d <= 50)
SELECT c AS "column", v AS value, n, d AS "distinct", r::INTEGER AS rank FROM t WHERE r <= 5 UNION ALL SELECT c, '(too many)', NULL, d, 1 FROM k WHERE d > 50""",
    "renko_range": f"""WITH RECURSIVE {BARS_SQL}, s0 AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS t FROM bars {_W}), n AS MATERIALIZED (SELECT *, {_roll("avg", "t", 14)} AS wd, row_number() OVER w AS i FROM s0 {_W}),
r AS (SELECT symbol, i, close AS before, 0::BIGINT AS m, close AS base FROM n WHERE i = 1
  UNION ALL SELECT symbol, i, base, m, base + m * coalesce(wd, 0) FROM (SELECT n.symbol, n.i, r.base, n.wd, CASE WHEN n.wd > 0 THEN (sign(n.close - r.base) * floor(abs(n.close - r.base) / n.wd))::BIGINT ELSE 0 END AS m FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)),
b AS (SELECT n.symbol, n.ts, before, wd, volume, m, sign(m) AS s, unnest(generate_series(1, abs(m))) AS k FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i WHERE m <> 0)
SELECT symbol, ts, k, round(before + s * (k - 1) * wd, 4) AS open, round(before + s * k * wd, 4) AS close, round(volume / abs(m), 4) AS volume FROM b""",
}
