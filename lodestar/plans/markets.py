"""Queries of pair scans, odds and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import models
from lodestar.operators import odds as o
from lodestar.operators import pages as pg
from lodestar.operators import pairs as pr
from lodestar.operators import tiles
from lodestar.plans.common import rounded
from lodestar.sources.bridge import BARS_SQL, bars, table


def _rows(s, d):
    return pr.grid_returns(bars(s, d), 500)


def _all_rows(s, d):
    return pr.grid_returns(bars(s, d), None)


def _packed(rows, s, d, lags=0):
    return tiles.pack(rows, lags, bars(s, d).select("symbol").distinct().count())


def _lags(rows, s, d, lags):
    packed = _packed(rows, s, d, lags)
    return pr.best_lags(packed, pr.correlations(packed), lags)


def _matches(s, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "W").when(F.col("o_orderstatus") == "O", "L").otherwise("T")
    location = F.when(F.col("o_custkey") % 2 == 0, "").otherwise("@")
    week = F.when(F.col("o_orderkey") % 11 != 0, F.weekofyear("o_orderdate"))  # some games have none
    return table(s, d, "orders").select(F.col("o_orderkey").alias("game"), F.col("o_orderdate").alias("date"), location.alias("location"), outcome.alias("outcome"), week.alias("week"), F.col("o_totalprice").alias("points"))


def odds_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as nested JSON events: game by order, book by supplier, market by line, team by part."""
    t = table(spark, sf_dir, "lineitem")
    rows = t.select(
        (F.col("l_orderkey") % 500).alias("g"), F.concat(F.lit("book"), (F.col("l_suppkey") % 6).cast("string")).alias("title"),
        F.element_at(F.array(*map(F.lit, ("h2h", "spreads", "totals"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("key"),
        F.concat(F.lit("T"), (F.col("l_orderkey") % 500).cast("string"), F.when(F.col("l_partkey") % 2 == 0, "h").otherwise("a")).alias("name"),
        (1.2 + F.col("l_discount") * 20).alias("price"), (F.col("l_quantity") % 7).cast("double").alias("point"),
    ).groupBy("g", "title", "key", "name").agg(F.max("price").alias("price"), F.min("point").alias("point"))
    markets = rows.groupBy("g", "title", "key").agg(F.collect_list(F.struct("name", "price", "point")).alias("outcomes"))
    books = markets.groupBy("g", "title").agg(F.collect_list(F.struct("key", "outcomes")).alias("markets"))
    events = books.groupBy("g").agg(F.collect_list(F.struct("title", "markets")).alias("bookmakers"))
    g = F.col("g").cast("string")
    return events.select(F.to_json(F.struct(F.concat(F.lit("T"), g, F.lit("h")).alias("home_team"), F.concat(F.lit("T"), g, F.lit("a")).alias("away_team"), F.lit("2024-01-01 12:00:00").alias("commence_time"), "bookmakers")).alias("json"))


def _odds(s, d):
    return o.flatten(odds_events(s, d))


QUERIES = {
    "pair_correlations": lambda s, d: rounded(pr.correlations(_packed(_rows(s, d), s, d))),
    "pair_lags": lambda s, d: rounded(_lags(_rows(s, d), s, d, 5)),
    "pair_spreads": lambda s, d: rounded(pr.spreads(r := _rows(s, d), pr.correlations(_packed(r, s, d)))),
    "pair_clusters": lambda s, d: pr.clusters(pr.correlations(_packed(r := _rows(s, d), s, d)), r.select("symbol").distinct(), 0.05),
    # over all times and lags from -20 to 20
    "pair_correlations_whole": lambda s, d: rounded(pr.correlations(_packed(_all_rows(s, d), s, d))),
    "pair_lags_whole": lambda s, d: rounded(_lags(_all_rows(s, d), s, d, 20)),
    "pair_spreads_whole": lambda s, d: rounded(pr.spreads(r := _all_rows(s, d), pr.correlations(_packed(r, s, d)))),
    "pair_clusters_whole": lambda s, d: pr.clusters(pr.correlations(_packed(r := _all_rows(s, d), s, d)), r.select("symbol").distinct(), 0.05),
    "factor_quantiles": lambda s, d: rounded(pr.factor_quantiles(bars(s, d))),
    "odds_flat": lambda s, d: rounded(_odds(s, d)),
    "odds_by_book": lambda s, d: rounded(o.by_book(_odds(s, d), [f"book{k}" for k in range(6)])),
    "odds_best": lambda s, d: rounded(o.best_prices(_odds(s, d))),
    "odds_snapshot": lambda s, d: rounded(o.snapshot(o.quoted_by(_odds(s, d), "book3"))),
    "odds_favourites": lambda s, d: rounded(o.favourites(_odds(s, d), "book3")),
    "match_features": lambda s, d: rounded(models.match_features(_matches(s, d), ["week", "points"], "game")),
    "page_links": lambda s, d: pg.links(table(s, d, "pages")),
    "page_routes": lambda s, d: pg.route(table(s, d, "pages")),
    "page_text": lambda s, d: pg.to_text(table(s, d, "pages")).select("page_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest")),
    "page_freshness": lambda s, d: pg.freshness(table(s, d, "pages"), "2024-06-30"),
}

_GRID = f"""WITH RECURSIVE {BARS_SQL}, tm AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM bars ORDER BY ts DESC LIMIT 500)),
fl AS (SELECT s.symbol, tm.ts, tm.i, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY tm.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN tm LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = tm.ts),
rt AS (SELECT * FROM (SELECT *, ln(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS ret FROM fl) WHERE ret IS NOT NULL),
co AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS corr, count(*) AS n FROM rt a JOIN rt b ON a.i = b.i AND a.symbol < b.symbol GROUP BY 1, 2)"""
_ODDS = """WITH base AS (
  SELECT l_orderkey % 500 AS g, 'book' || (l_suppkey % 6)::VARCHAR AS book, CASE l_linenumber % 3 WHEN 0 THEN 'h2h' WHEN 1 THEN 'spreads' ELSE 'totals' END AS market,
         'T' || (l_orderkey % 500)::VARCHAR || CASE WHEN l_partkey % 2 = 0 THEN 'h' ELSE 'a' END AS name, max(1.2::DOUBLE + l_discount * 20) AS price, min(l_quantity % 7)::DOUBLE AS point FROM lineitem GROUP BY 1, 2, 3, 4),
od AS (SELECT 'T' || g::VARCHAR || 'a @ T' || g::VARCHAR || 'h' AS game, TIMESTAMP '2024-01-01 12:00:00' AS start, book, market, CASE WHEN market <> 'h2h' THEN name || ' ' || point::VARCHAR ELSE name END AS team, price, 1 / price AS implied FROM base)"""

#: The same over all times.
_ALL = _GRID.replace(" ORDER BY ts DESC LIMIT 500", "")

ORACLE_SQL = {
    "pair_correlations": f"{_GRID} SELECT a, b, round(corr, 6) AS corr, n FROM co WHERE abs(corr) >= 0",
    "pair_correlations_whole": f"{_ALL} SELECT a, b, round(corr, 6) AS corr, n FROM co WHERE abs(corr) >= 0",
    "odds_favourites": f"""{_ODDS}, mn AS (SELECT game, market, team, avg(price) AS avg_price, count(*) AS quotes FROM od GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY game, market ORDER BY round(avg_price, 9), team)::INTEGER AS rank FROM mn)
SELECT game, market, team, start, book, round(price, 6) AS price, round(implied, 6) AS implied, round(avg_price, 6) AS avg_price, quotes, rank, 'favourite' AS role FROM od JOIN rk USING (game, market, team) WHERE rank = 1 AND game IN (SELECT game FROM od WHERE book = 'book3')""",
    "match_features": """WITH gm AS (SELECT o_orderkey AS game, o_orderdate AS date, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '@' END AS location, CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'O' THEN 'L' ELSE 'T' END AS outcome, CASE WHEN o_orderkey % 11 <> 0 THEN week(o_orderdate)::INTEGER END AS week, o_totalprice AS points FROM orders)
SELECT game, date, location, outcome, week, round(points, 6) AS points, month(date)::INTEGER AS month, (isodow(date) - 1)::INTEGER AS day_of_week, (location = '')::INTEGER AS is_home, (CASE WHEN location = '' THEN outcome = 'W' ELSE outcome = 'L' END)::INTEGER AS home_win,
  round(0.1::DOUBLE + 0.9::DOUBLE * (row_number() OVER (ORDER BY date, game) - 1) / (count(*) OVER () - 1), 6) AS weight FROM gm WHERE week IS NOT NULL AND points IS NOT NULL AND date IS NOT NULL""",
    "pair_lags": f"""{_GRID}, lg AS (SELECT a.symbol AS a, b.symbol AS b, l.lag, corr(a.ret, b.ret) AS corr, count(*) AS n FROM rt a, (SELECT unnest(generate_series(-5, 5))::INTEGER AS lag) l, rt b WHERE b.i = a.i + l.lag AND a.symbol < b.symbol GROUP BY 1, 2, 3 HAVING count(*) >= 30)
SELECT a, b, lag, round(corr, 6) AS corr, CASE WHEN lag > 0 THEN a WHEN lag < 0 THEN b END AS leader FROM lg QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(corr), 9) DESC, lag) = 1""",
    "pair_spreads": f"""{_GRID}, lp AS (SELECT a.symbol AS a, b.symbol AS b, a.i, ln(a.close) AS la, ln(b.close) AS lb FROM rt a JOIN rt b ON a.i = b.i AND a.symbol < b.symbol),
ft AS (SELECT a, b, regr_slope(la, lb) AS beta, regr_intercept(la, lb) AS alpha FROM lp GROUP BY 1, 2), sp AS (SELECT lp.a, lp.b, i, alpha, beta, la - alpha - beta * lb AS s FROM lp JOIN ft ON ft.a = lp.a AND ft.b = lp.b),
dd AS (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY i) AS s1 FROM sp), g AS (SELECT a, b, first(alpha) AS alpha, first(beta) AS beta, count(*) AS n, regr_slope(s - s1, s1) AS k, regr_sxx(s - s1, s1) AS sxx, regr_syy(s - s1, s1) AS syy FROM dd WHERE s1 IS NOT NULL GROUP BY 1, 2)
SELECT a, b, round(alpha, 6) AS alpha, round(beta, 6) AS beta, n, round(CASE WHEN k < 0 THEN -ln(2.0::DOUBLE) / k END, 6) AS half_life, round(k / sqrt((syy - k * k * sxx) / (n - 2) / sxx), 6) AS t, k / sqrt((syy - k * k * sxx) / (n - 2) / sxx) < -3.34 AS cointegrated FROM g""",
    "pair_clusters": f"""{_GRID}, ed AS (SELECT a, b FROM co WHERE corr > 0.05 UNION SELECT b, a FROM co WHERE corr > 0.05),
rc(symbol, other) AS (SELECT DISTINCT symbol, symbol FROM rt UNION SELECT rc.symbol, ed.b FROM rc JOIN ed ON ed.a = rc.other), m AS (SELECT symbol, min(other) AS cluster FROM rc GROUP BY symbol)
SELECT symbol, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM m""",
    "factor_quantiles": f"""WITH {BARS_SQL}, f AS (SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS f, lead(close, 5) OVER w / nullif(close, 0) - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
n AS (SELECT *, ntile(2) OVER (PARTITION BY ts ORDER BY f, symbol) AS bin FROM f WHERE f IS NOT NULL AND fwd IS NOT NULL) SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(fwd), 6) AS fwd_mean FROM n GROUP BY 1""",
    "odds_flat": f"{_ODDS} SELECT game, start, book, market, team, round(price, 6) AS price, round(implied, 6) AS implied FROM od",
    "odds_by_book": f"{_ODDS} SELECT game, team, market, " + ", ".join(f"round(avg(price) FILTER (WHERE book = 'book{k}'), 6) AS book{k}" for k in range(6)) + " FROM od GROUP BY 1, 2, 3",
    "odds_best": f"{_ODDS}, tp AS (SELECT game, market, team, max(price) AS price FROM od GROUP BY 1, 2, 3) SELECT game, market, team, round(price, 6) AS price, min(book) AS book FROM od JOIN tp USING (game, market, team, price) GROUP BY game, market, team, price",
    "odds_snapshot": f"""{_ODDS}, gm AS (SELECT DISTINCT game FROM od WHERE book = 'book3'), av AS (SELECT game, market, team, avg(price) AS p, count(*) AS quotes FROM od WHERE game IN (SELECT game FROM gm) GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY game, market ORDER BY round(p, 9), team) AS rank FROM av) SELECT game, market, team, round(p, 6) AS avg_price, quotes, rank::INTEGER AS rank, CASE WHEN rank = 1 THEN 'favourite' ELSE 'underdog' END AS role FROM rk""",
    "page_links": r"""WITH h AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#?]*)', 1) AS hs FROM pages), u AS (SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) AS pos FROM h),
l AS (SELECT page_id, pos, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href
  WHEN NOT regexp_matches(href, '^[a-zA-Z]+:') AND href <> '' THEN regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || href END AS link FROM u),
g AS (SELECT page_id, link, min(pos) AS pos FROM l WHERE link IS NOT NULL GROUP BY 1, 2) SELECT page_id, link, (row_number() OVER (PARTITION BY page_id ORDER BY pos, link))::INTEGER AS rank FROM g QUALIFY rank <= 200""",
    "page_routes": r"""SELECT page_id, regexp_extract(url, '^[a-z]+://(?:www\.)?([^/?#:]+)', 1) AS domain,
regexp_replace(regexp_replace(lower(regexp_replace(url, '^[a-z]+://', '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '.html' AS file FROM pages""",
    "page_freshness": r"""WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, list_transform(regexp_extract_all(t, '\b\d{4}-\d{2}-\d{2}\b'), lambda x: try_strptime(x, '%Y-%m-%d')::DATE)
  || list_transform(regexp_extract_all(t, '\b\d{1,2}/\d{1,2}/\d{4}\b'), lambda x: coalesce(try_strptime(x, '%m/%d/%Y'), try_strptime(x, '%d/%m/%Y'))::DATE)
  || list_transform(regexp_extract_all(t, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}\b'), lambda x: try_strptime(regexp_replace(x, '^(...)\S*', '\1'), '%b %d, %Y')::DATE)
  || list_transform(regexp_extract_all(t, '(?i)\b\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4}\b'), lambda x: try_strptime(regexp_replace(x, '^(\d+ ...)\S*', '\1'), '%d %b %Y')::DATE)
  || list_transform(regexp_extract_all(t, '\b\d{4}\b'), lambda x: try_strptime(x || '-06-30', '%Y-%m-%d')::DATE) AS ds FROM t),
n AS (SELECT page_id, list_max(list_filter(ds, lambda x: x > DATE '2024-06-30' - 1825 AND x <= DATE '2024-06-30')) AS newest FROM d)
SELECT page_id, newest, coalesce(newest >= DATE '2024-06-30' - 180, true) AS fresh FROM n""",
}
