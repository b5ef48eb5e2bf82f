"""Queries of quality checks, profiles, contracts and resampling, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import quality as q
from lodestar.operators import resample, roll
from lodestar.plans.common import rounded
from lodestar.plans.indicators import _recursive
from lodestar.sources.bridge import BARS_SQL, TICKS_SQL, TRADES_SQL, bars, table, ticks, trades


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as one-trade bars with faults planted by the row's keys."""
    t = trades(spark, sf_dir)
    k = F.col("seq.l_orderkey") * 7 + F.col("seq.l_partkey") * 3 + F.col("seq.l_linenumber")
    p = F.when(k % 97 == 0, None).when(k % 101 == 0, -F.col("price")).when(k % 89 == 0, F.col("price") * 50).otherwise(F.col("price"))
    rows = t.select("symbol", F.when(k % 113 == 0, None).otherwise(F.col("ts")).alias("ts"), F.concat_ws("-", *(F.lpad(F.col(f"seq.{c}").cast("string"), 10, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("seq"), p.alias("open"), "volume", k.alias("k"))
    o = F.col("open")
    return rows.select("symbol", "ts", "seq", "open", F.when(F.col("k") % 103 == 0, o * 0.5).when(F.col("k") % 2 == 0, o * 1.01).otherwise(o).alias("high"), F.when(F.col("k") % 2 == 0, o * 0.99).otherwise(o).alias("low"), o.alias("close"), "volume")


def contract_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades dealt to quarterly contracts of four roots; every third order trades the next one."""
    t = table(spark, sf_dir, "lineitem")
    d = F.when(F.col("l_orderkey") % 3 == 0, F.add_months("l_shipdate", 3)).when((F.col("l_orderkey") % 3 == 1) & (F.dayofmonth("l_shipdate") + 31 * ((F.month("l_shipdate") - 1) % 3) > 70), F.add_months("l_shipdate", 3)).otherwise(F.to_date("l_shipdate"))
    month = (F.floor((F.month(d) - 1) / 3) * 3 + 3).cast("int")
    code = F.element_at(F.create_map(*(F.lit(x) for x in (3, "H", 6, "M", 9, "U", 12, "Z"))), month)
    root = F.concat(F.lit("R"), F.char(F.col("l_suppkey") % 4 + 65))
    rows = t.select(F.concat(root, code, F.lpad((F.year(d) % 100).cast("string"), 2, "0")).alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    return roll.classify(resample.daily(rows)).withColumnRenamed("symbol", "contract").drop("kind")


def _checked(spark, sf_dir):
    return q.qc_checks(dirty(spark, sf_dir))


def _merge(spark, sf_dir):
    raw = dirty(spark, sf_dir).where("ts is not null and open is not null")
    filtered = q.drop_spikes(raw)
    return roll.merge_report(raw, filtered, q.keep_last(filtered))


_FRAMES = {"5m": 300, "1h": 3600, "D": 86400}

QUERIES = {
    "qc_summary": lambda s, d: rounded(q.qc_summary(_checked(s, d))),
    "qc_counts": lambda s, d: rounded(q.qc_counts(_checked(s, d))),
    "qc_detail": lambda s, d: q.qc_detail(_checked(s, d)),
    "qc_daily": lambda s, d: q.qc_daily(_checked(s, d)),
    "qc_clean_strict": lambda s, d: q.clean(_checked(s, d), "warning").groupBy("symbol").agg(F.count("*").alias("bars"), F.max("seq").alias("last_seq")),
    "qc_clean": lambda s, d: q.clean(_checked(s, d)).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("seq").alias("last_seq")),
    "merge_report": _merge,
    "profile_orders": lambda s, d: rounded(q.profile(table(s, d, "orders")).select("rows", "column", "missing", "missing_pct", "least", "greatest", "mean", "zeros", "negatives"), 2),
    "profile_top_values": lambda s, d: q.top_values(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    "profile_duplicates": lambda s, d: q.duplicate_rows(table(s, d, "lineitem").select("l_orderkey", "l_linenumber")),
    "coverage": lambda s, d: rounded(q.coverage(bars(s, d))),
    "bar_size": lambda s, d: rounded(q.bar_size(ticks(s, d))),
    "contract_rolls": lambda s, d: roll.roll_dates(contract_bars(s, d)),
    "contract_continuous": lambda s, d: roll.continuous(b := contract_bars(s, d), roll.roll_dates(b)),
    "daily_bars": bars,
    "tick_bars": lambda s, d: resample.tick_bars(ticks(s, d), _FRAMES),
    "resample_derived": lambda s, d: rounded(resample.derive(resample.resample(resample.tick_bars(ticks(s, d), {"5m": 300}).drop("frame"), {"1h": 3600, "4h": 14400}))),
    "asof_join": lambda s, d: resample.asof(ticks(s, d).select("symbol", "ts", "seq", "price"), resample.tick_bars(ticks(s, d), {"4h": 14400}), ["open", "close"]),
    "renko": lambda s, d: rounded(resample.renko(bars(s, d), 500.0), 4),
    "spread_instrument": lambda s, d: resample.spread(bars(s, d), "S00", "S01"),
}

_DIRTY = f"""WITH {TRADES_SQL},
d0 AS (SELECT *, l_orderkey * 7 + l_partkey * 3 + l_linenumber AS k, concat_ws('-', lpad(l_orderkey::VARCHAR, 10, '0'), lpad(l_linenumber::VARCHAR, 10, '0'), lpad(l_partkey::VARCHAR, 10, '0'), lpad(l_suppkey::VARCHAR, 10, '0')) AS seq FROM trades),
d1 AS (SELECT symbol, CASE WHEN k % 113 = 0 THEN NULL ELSE ts END AS ts, seq, k, volume, CASE WHEN k % 97 = 0 THEN NULL WHEN k % 101 = 0 THEN -price WHEN k % 89 = 0 THEN price * 50 ELSE price END AS open FROM d0),
dirty AS (
  SELECT symbol, ts, seq, open, CASE WHEN k % 103 = 0 THEN open * 0.5::DOUBLE WHEN k % 2 = 0 THEN open * 1.01::DOUBLE ELSE open END AS high, CASE WHEN k % 2 = 0 THEN open * 0.99::DOUBLE ELSE open END AS low, open AS close, volume FROM d1)"""


def _robust(source: str, x: str, out: str, scale: str = "1.4826") -> str:
    w = "PARTITION BY symbol ORDER BY ts NULLS FIRST, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW"
    return f"""z1 AS (SELECT *, {x} AS x FROM {source} WINDOW v AS (PARTITION BY symbol ORDER BY ts NULLS FIRST, seq)),
z2 AS (SELECT *, CASE WHEN count(x) OVER w >= 30 THEN quantile_cont(x, 0.5) OVER w END AS m FROM z1 WINDOW w AS ({w})),
z3 AS (SELECT *, abs(x - m) AS dv FROM z2),
{out} AS (SELECT * EXCLUDE (x, m, dv), dv / nullif({scale}::DOUBLE * CASE WHEN count(dv) OVER w >= 30 THEN quantile_cont(dv, 0.5) OVER w END, 0) AS z FROM z3 WINDOW w AS ({w}))"""


_CHECKED = f"""{_DIRTY}, {_robust("dirty", "abs(close / nullif(lag(close) OVER v, 0) - 1)", "zz")},
checked AS (
  SELECT *, ts IS NULL AS invalid_datetime, open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL AS missing_ohlc, coalesce(least(open, high, low, close) <= 0, false) AS non_positive_ohlc,
         coalesce(open IS NOT NULL AND (high < greatest(open, close, low) OR low > least(open, close, high)), false) AS ohlc_structure_violation, coalesce(open = high AND high = low AND low = close, false) AS flat_bar,
         ts IS NOT NULL AND count(*) OVER (PARTITION BY symbol, ts) > 1 AS duplicate_datetime, coalesce(z > 8, false) AS outlier_return
  FROM zz)"""
_SEV = "(invalid_datetime OR missing_ohlc OR non_positive_ohlc OR ohlc_structure_violation OR duplicate_datetime)"
_WARN = "(outlier_return OR flat_bar)"
_NAMES = (*q.SEVERE, *q.WARNING, *q.INFO)
_SEVERITY = {n: s for s, names in (("severe", q.SEVERE), ("warning", q.WARNING), ("info", q.INFO)) for n in names}
_DETAIL = " UNION ALL ".join(f"SELECT symbol, ts, seq, '{n}' AS issue, '{_SEVERITY[n]}' AS severity FROM checked WHERE {n}" for n in _NAMES)
_CONTRACTS = """c0 AS (
  SELECT *, CASE WHEN l_orderkey % 3 = 0 OR (l_orderkey % 3 = 1 AND day(l_shipdate) + 31 * ((month(l_shipdate) - 1) % 3) > 70) THEN l_shipdate + INTERVAL 3 MONTH ELSE l_shipdate END AS d FROM lineitem),
c1 AS (SELECT *, ((month(d) - 1) // 3 * 3 + 3)::INTEGER AS exp_month, year(d)::INTEGER AS exp_year, 'R' || chr((65 + l_suppkey % 4)::INTEGER) AS root FROM c0),
cb AS (
  SELECT root || CASE exp_month WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || lpad((exp_year % 100)::VARCHAR, 2, '0') AS contract, root, exp_year, exp_month, l_shipdate AS ts,
         first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(l_quantity) AS volume
  FROM c1 GROUP BY 1, 2, 3, 4, 5),
ck AS (SELECT *, row_number() OVER o AS rank, lead(contract) OVER o AS next, lead(exp_year) OVER o AS ny, lead(exp_month) OVER o AS nm FROM (SELECT DISTINCT root, contract, exp_year, exp_month FROM cb) WINDOW o AS (PARTITION BY root ORDER BY exp_year, exp_month, contract)),
dv AS (SELECT root, contract, ts::DATE AS day, sum(volume) AS v FROM cb GROUP BY 1, 2, 3),
ov AS (SELECT a.root, a.contract, a.day, b.v > a.v AS on_ FROM ck JOIN dv a ON a.root = ck.root AND a.contract = ck.contract JOIN dv b ON b.root = ck.root AND b.contract = ck.next AND b.day = a.day),
og AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY root, contract ORDER BY day) AS g FROM ov),
ol AS (SELECT *, sum(on_::INTEGER) OVER (PARTITION BY root, contract, g ORDER BY day) AS n FROM og),
os AS (SELECT root, contract, count(*) AS overlap, min(CASE WHEN n >= 2 THEN day - 1 END) AS crossed FROM ol GROUP BY 1, 2),
rolls AS (
  SELECT ck.root, ck.contract, exp_year, exp_month, next, coalesce(CASE WHEN overlap >= 3 THEN crossed END, make_date(ny, nm, 1) + ((12 - isodow(make_date(ny, nm, 1))::INTEGER) % 7) + 14 - 7)::DATE AS roll,
         CASE WHEN overlap >= 3 AND crossed IS NOT NULL THEN 'volume' ELSE 'calendar' END AS method
  FROM ck LEFT JOIN os ON os.root = ck.root AND os.contract = ck.contract WHERE next IS NOT NULL)"""
_TICKBARS = f"""{TICKS_SQL},
tb AS (
  SELECT symbol, frame, to_timestamp((epoch(ts)::BIGINT // s) * s)::TIMESTAMP AS b, ts, seq, price, volume FROM (SELECT *, floor(epoch(ts)) AS e FROM ticks), (VALUES ('5m', 300), ('1h', 3600), ('4h', 14400), ('D', 86400)) f(frame, s)),
fb AS (SELECT symbol, frame, b AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(volume) AS volume FROM tb GROUP BY 1, 2, 3)""".replace("(epoch(ts)::BIGINT // s) * s", "floor(e / s) * s")

ORACLE_SQL = {
    "qc_summary": f"{_CHECKED} SELECT symbol, count(*) AS rows, {', '.join(f"sum(({x})::INTEGER)::BIGINT AS {k}, round(100.0::DOUBLE * sum(({x})::INTEGER) / count(*), 6) AS {k}_pct" for k, x in (("flagged", f"{_SEV} OR {_WARN}"), ("severe_rows", _SEV), ("warning_rows", _WARN)))}, {', '.join(f'sum({n}::INTEGER)::BIGINT AS {n}' for n in _NAMES)} FROM checked GROUP BY symbol",
    "qc_counts": f'{_CHECKED}, t AS (SELECT count(*) AS rows, {", ".join(f"sum({n}::INTEGER)::BIGINT AS {n}" for n in _NAMES)} FROM checked) ' + " UNION ALL ".join(f"SELECT rows, '{n}' AS \"check\", {n} AS n, round(100.0::DOUBLE * {n} / rows, 6) AS pct FROM t" for n in _NAMES),
    "qc_detail": f"{_CHECKED} {_DETAIL}",
    "qc_daily": f"{_CHECKED}, det AS ({_DETAIL}) SELECT symbol, issue, severity, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM det GROUP BY 1, 2, 3, 4",
    "qc_clean_strict": f"{_CHECKED} SELECT symbol, count(*) AS bars, max(seq) AS last_seq FROM checked WHERE NOT ({_SEV} OR {_WARN}) GROUP BY symbol",
    "qc_clean": f"{_CHECKED} SELECT symbol, count(*) AS bars, max(seq) AS last_seq FROM checked WHERE NOT {_SEV} GROUP BY symbol",
    "merge_report": f"""{_DIRTY}, raw AS (SELECT * FROM dirty WHERE ts IS NOT NULL AND open IS NOT NULL), {_robust("raw", "open", "zz", "1.1")},
kept AS (SELECT * FROM zz WHERE coalesce(z <= 8, true)), one AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) = 1)
SELECT r.symbol, r.n AS read, r.n - coalesce(k.n, 0) AS spikes, coalesce(k.n, 0) - coalesce(o.n, 0) AS duplicates, coalesce(o.n, 0) AS written
FROM (SELECT symbol, count(*) AS n FROM raw GROUP BY 1) r LEFT JOIN (SELECT symbol, count(*) AS n FROM kept GROUP BY 1) k USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM one GROUP BY 1) o USING (symbol)""",
    "profile_orders": " UNION ALL ".join(
        f"SELECT count(*) AS rows, '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct, "
        + (f"round(min({c})::DOUBLE, 2) AS least, round(max({c})::DOUBLE, 2) AS greatest, round(avg({c}), 2) AS mean, sum(({c} = 0)::INTEGER)::BIGINT AS zeros, sum(({c} < 0)::INTEGER)::BIGINT AS negatives" if number else "NULL::DOUBLE AS least, NULL::DOUBLE AS greatest, NULL::DOUBLE AS mean, NULL::BIGINT AS zeros, NULL::BIGINT AS negatives")
        + " FROM orders"
        for c, number in (("o_orderkey", 1), ("o_custkey", 1), ("o_orderstatus", 0), ("o_totalprice", 1), ("o_orderdate", 0), ("o_orderpriority", 0))
    ),
    "profile_top_values": """WITH l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value))::INTEGER AS rank FROM c QUALIFY rank <= 5""",
    "profile_duplicates": "WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT sum(c)::BIGINT AS rows, (sum(c) - count(*))::BIGINT AS duplicates FROM g",
    "coverage": f"WITH {BARS_SQL}, t AS (SELECT DISTINCT ts FROM bars ORDER BY ts DESC LIMIT 250) SELECT symbol, round(count(DISTINCT ts) / 250.0::DOUBLE, 6) AS coverage FROM bars WHERE ts IN (SELECT ts FROM t) GROUP BY symbol",
    "bar_size": f"""WITH {TICKS_SQL}, s AS (SELECT symbol, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) AS step FROM ticks), m AS (SELECT symbol, quantile_cont(step, 0.5) AS s FROM s WHERE step IS NOT NULL GROUP BY symbol)
SELECT symbol, round(s, 6) AS seconds, CASE WHEN s < 300 THEN '1m' WHEN s < 900 THEN '5m' WHEN s < 1800 THEN '15m' WHEN s < 3600 THEN '30m' WHEN s < 14400 THEN '1h' WHEN s < 86400 THEN '4h' ELSE 'D' END AS label,
       round(252.0::DOUBLE * CASE WHEN s >= 86400 THEN 1.0::DOUBLE ELSE 23400.0::DOUBLE / s END, 6) AS per_year FROM m""",
    "contract_rolls": f"WITH {_CONTRACTS} SELECT root, contract, exp_year, exp_month, next, roll, method FROM rolls",
    "contract_continuous": f"""WITH {_CONTRACTS},
sp AS (SELECT ck.root, ck.contract, ck.rank, b.roll AS begin_, e.roll AS end_ FROM ck LEFT JOIN rolls b ON b.root = ck.root AND b.next = ck.contract LEFT JOIN rolls e ON e.root = ck.root AND e.contract = ck.contract)
SELECT cb.root, cb.ts, cb.contract, open, high, low, close, volume FROM cb JOIN sp ON sp.root = cb.root AND sp.contract = cb.contract
WHERE (begin_ IS NULL OR ts::DATE >= begin_) AND (end_ IS NULL OR ts::DATE < end_) QUALIFY row_number() OVER (PARTITION BY cb.root, cb.ts ORDER BY rank DESC) = 1""",
    "daily_bars": f"WITH {BARS_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars",
    "tick_bars": f"WITH {_TICKBARS} SELECT symbol, frame, ts, open, high, low, close, volume FROM fb WHERE frame <> '4h'",
    "resample_derived": _recursive(f"""WITH RECURSIVE {_TICKBARS},
g0 AS (
  SELECT symbol, frame, to_timestamp(floor(epoch(ts) / s) * s)::TIMESTAMP AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
  FROM (SELECT symbol, ts, open, high, low, close, volume FROM fb WHERE frame = '5m'), (VALUES ('1h', 3600), ('4h', 14400)) f(frame, s) GROUP BY 1, 2, 3 HAVING sum(volume) <> 0),
g AS (SELECT symbol || ' ' || frame AS symbol, symbol AS name, frame, ts, open, high, low, close, volume, high - low AS range FROM g0)""", "g", [("atr14", "range", 2 / 15, 1, "first")], "ga")
    + """ SELECT name AS symbol, frame, ts, round(atr14, 6) AS atr14, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, round(close / nullif(lag(close) OVER w, 0) - 1, 6) AS ret, round(ln(close / nullif(lag(close) OVER w, 0)), 6) AS log_ret, round(high - low, 6) AS range, round(close - open, 6) AS body
FROM ga WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "asof_join": f"""WITH {_TICKBARS}, c AS (SELECT symbol, ts, open, close FROM fb WHERE frame = '4h')
SELECT t.symbol, t.ts, t.seq, t.price, c.open AS asof_open, c.close AS asof_close FROM ticks t ASOF LEFT JOIN c ON c.symbol = t.symbol AND c.ts <= t.ts""",
    "renko": f"""WITH RECURSIVE {BARS_SQL}, n AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars),
r AS (SELECT symbol, i, close AS before, 0::BIGINT AS m, close AS base FROM n WHERE i = 1
  UNION ALL SELECT symbol, i, base, m, base + m * 500.0::DOUBLE FROM (SELECT n.symbol, n.i, r.base, (sign(n.close - r.base) * floor(abs(n.close - r.base) / 500.0::DOUBLE))::BIGINT AS m FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)),
b AS (SELECT n.symbol, n.ts, before, sign(m) AS s, unnest(generate_series(1, abs(m))) AS k FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i WHERE m <> 0)
SELECT symbol, ts, k, round(before + s * (k - 1) * 500.0::DOUBLE, 4) AS open, round(before + s * k * 500.0::DOUBLE, 4) AS close FROM b""",
    "spread_instrument": f"""WITH {BARS_SQL}, j AS (SELECT a.ts, a.open - b.open AS o, a.close - b.close AS c FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol = 'S00' AND b.symbol = 'S01')
SELECT 'S00-S01' AS symbol, ts, o AS open, greatest(o, c) AS high, least(o, c) AS low, c AS close, 0.0::DOUBLE AS volume FROM j""",
}
