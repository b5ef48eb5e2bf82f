"""Windows, scans, bins and files against pandas and literal rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scan import ewm, linear_scan, scan_state
from lodestar.functions.windows import quantile_bins, streak
from lodestar.operators import backtest, pages, quality, resample, roll
from lodestar.operators.indicators import indicators
from lodestar.sources import files

DAY = dt.datetime(2023, 1, 1)


def series(spark, values, symbols=("A", "B")):
    rows = [(s, DAY + dt.timedelta(days=i), None if v is None else float(v)) for s in symbols for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double")


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_linear_scan_is_the_same_for_any_batch(spark, chunk):
    x = list(np.random.default_rng(1).normal(size=23))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    got = linear_scan(series(spark, x), {"y": (F.lit(0.9), F.col("x")), "z": (F.lit(1.0), F.col("x"))}).orderBy("symbol", "ts").toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    y, want = 0.0, []
    for v in x:
        y = 0.9 * y + v
        want.append(y)
    assert np.allclose(got.y, want * 2) and np.allclose(got.z, list(np.cumsum(x)) * 2)


def test_ewm_equals_pandas(spark):
    x = list(np.random.default_rng(2).normal(size=40))
    df = ewm(series(spark, x), [("first", "x", 0.2, 5, "first"), ("sma", "x", 2 / 6, 5, "sma")]).where("symbol = 'B'").orderBy("ts").toPandas()
    want = pd.Series(x).ewm(alpha=0.2, adjust=False, min_periods=5).mean()
    assert np.allclose(df["first"].to_numpy(float), want, equal_nan=True)
    seeded = pd.Series([np.nan] * 4 + [np.mean(x[:5]), *x[5:]]).ewm(alpha=2 / 6, adjust=False).mean()
    assert np.allclose(df["sma"].to_numpy(float), seeded, equal_nan=True)


def test_ewm_of_a_late_start(spark):
    df = ewm(series(spark, [None, None, 1.0, 2.0, None, 4.0], ("A",)), [("y", "x", 0.5, 1, "first")]).orderBy("ts").toPandas()
    assert np.allclose(df.y.to_numpy(float), [np.nan, np.nan, 1, 1.5, 1.5, 2.75], equal_nan=True)


def test_scan_state_keeps_keys_apart(spark):
    made = T.StructType([T.StructField("n", T.LongType())])
    got = scan_state(series(spark, [1.0, 2.0, 3.0]), lambda: 0, lambda s, row: (s + 1, (s + 1,)), ["x"], made).orderBy("symbol", "ts").toPandas()
    assert list(got.n) == [1, 2, 3, 1, 2, 3]


def test_quantile_bins_drop_equal_edges(spark):
    df = quantile_bins(series(spark, [1.0] * 6 + [2.0, 3.0, None], ("A",)), "x", 5, "bin").orderBy("x").toPandas()
    cut = pd.qcut(pd.Series([1.0] * 6 + [2.0, 3.0]), 5, labels=False, duplicates="drop")
    assert [b for b in df.bin if not pd.isna(b)] == list(cut)


def test_streak_counts_runs(spark):
    df = streak(series(spark, [1.0, 1.0, -1.0, 1.0, None, 1.0], ("A",)), F.col("x") > 0, "n").orderBy("ts").toPandas()
    assert list(df.n) == [1, 2, 0, 1, 0, 1]


def test_indicators_share_one_shuffle(spark):
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), 1.0, 2.0, 0.5, 1.5 + i % 3, 10.0) for i in range(40)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    study = indicators(bars, ["sma", "bbands", "stoch", "cmf", ("zscore", {"length": 5})])
    plan = study._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    executed = study._jdf.queryExecution().sparkPlan().toString()
    assert executed.count("Exchange") <= 1
    assert study.count() == 40


def test_renko_free_round_trip_of_files(spark, tmp_path):
    vendor = tmp_path / "v.csv"
    vendor.write_text("TS_Event,Symbol,O,High,LOW,close,Volume\n2023-01-01 00:00:00,ESH3,1,2,0.5,1.5,10\nbad,ESH3,1,2,0.5,1.5,10\n2023-01-01 00:01:00,,1,x,0.5,1.5,10\n2023-01-01 00:02:00,,1,2,0.5,1.5,\n")
    rows = files.read_vendor(spark, str(vendor)).orderBy("ts").collect()
    assert [(r.symbol, r.volume) for r in rows] == [("ESH3", 10.0), ("UNKNOWN", 0.0)]
    bar = tmp_path / "ESM3.csv"
    bar.write_text("Date,Time,Open,High,Low,Close,TickVol,Vol,Spread\n2023.01.01,00:05,1,2,0.5,1.5,1,2,0\n2023.01.01,xx,1,2,0.5,1.5,1,2,0\n")
    got = files.read_bars(spark, str(bar)).collect()
    assert [(r.symbol, r.ts, r.close) for r in got] == [("ESM3", dt.datetime(2023, 1, 1, 0, 5), 1.5)]
    assert files.file_kind(spark, str(vendor)) == "vendor"
    with pytest.raises(ValueError, match="missing columns: high, close"):
        files.resolve(["time", "open", "low"])


def test_merge_keeps_the_new_row(spark):
    old = spark.createDataFrame([("A", DAY, 1.0), ("A", DAY + dt.timedelta(1), 2.0)], "symbol string, ts timestamp, close double")
    new = spark.createDataFrame([("A", DAY, 9.0), ("B", DAY, 3.0)], "symbol string, ts timestamp, close double")
    assert sorted((r.symbol, r.close) for r in files.merge_keep_last(old, new).collect()) == [("A", 2.0), ("A", 9.0), ("B", 3.0)]
    parts = files.missing_ranges(old, "2022-12-01", "2023-02-01").collect()
    assert {(r.symbol, r.part) for r in parts} == {("A", "head"), ("A", "tail")}


def test_volume_roll_and_calendar_roll(spark):
    rows = [("R", c, 2023, m, DAY + dt.timedelta(days=d), v) for c, m, vols in (("RH23", 3, [9, 1, 9, 1, 1, 1]), ("RM23", 6, [1, 5, 1, 5, 5, 5])) for d, v in enumerate(vols)]
    rows.append(("R", "RU23", 2023, 9, DAY + dt.timedelta(days=200), 1))
    bars = spark.createDataFrame([(*r, 1.0, 1.0, 1.0, 1.0) for r in rows], "root string, contract string, exp_year int, exp_month int, ts timestamp, volume long, open double, high double, low double, close double")
    rolls = {r.contract: (r.roll, r.method) for r in roll.roll_dates(bars).collect()}
    assert rolls == {"RH23": (dt.date(2023, 1, 4), "volume"), "RM23": (dt.date(2023, 9, 8), "calendar")}
    series_ = [r.contract for r in roll.continuous(bars, roll.roll_dates(bars)).orderBy("ts").collect()]
    assert series_ == ["RH23"] * 3 + ["RM23"] * 3 + []


def test_quality_flags_each_fault(spark):
    at = lambda k: DAY + dt.timedelta(minutes=k)
    rows = [(at(0), 1, 1.0, 2.0, 0.5, 1.5), (None, 2, 1.0, 2.0, 0.5, 1.5), (at(1), 3, None, 2.0, 0.5, 1.5), (at(2), 4, -1.0, 2.0, -2.0, 1.5), (at(3), 5, 3.0, 2.0, 0.5, 1.5), (at(4), 6, 1.0, 1.0, 1.0, 1.0), (at(5), 7, 1.0, 2.0, 0.5, 1.5), (at(5), 8, 1.0, 2.0, 0.5, 1.5), (at(5), 9, 1.0, 2.0, 0.5, 1.5)]
    raw = spark.createDataFrame([("A", t, s, o, h, lo, c, 1.0) for t, s, o, h, lo, c in rows], "symbol string, ts timestamp, seq int, open double, high double, low double, close double, volume double")
    counts = {r["check"]: r.n for r in quality.qc_counts(quality.qc_checks(raw)).collect()}
    assert counts == {"invalid_datetime": 1, "missing_ohlc": 1, "non_positive_ohlc": 1, "ohlc_structure_violation": 1, "duplicate_datetime": 3, "flat_bar": 1, "outlier_return": 0}
    assert quality.clean(quality.qc_checks(raw)).count() == 2
    assert [r.seq for r in quality.keep_last(raw.where("ts is not null")).where(F.col("ts") == F.lit(at(5))).collect()] == [9]


def test_trade_runs(spark):
    pos = [0] * 5 + [1] * 3 + [0] * 7 + [1] * 2 + [0] * 13
    rows = [("A", DAY + dt.timedelta(days=i), float(p), 0.01 if 5 <= i < 8 else -0.01 if p else 0.0) for i, p in enumerate(pos)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, position double, gross double")
    assert [round(r.ret, 9) for r in backtest.trades(df).orderBy("opened").collect()] == [round(float(np.exp(0.03) - 1), 9), round(float(np.exp(-0.02) - 1), 9)]


def test_stop_stays_out_until_a_new_signal(spark):
    price = [100.0] * 5 + [110.0] * 5 + [90.0] * 5 + [100.0] * 5
    rows = [("A", DAY + dt.timedelta(days=i), p + 2, p - 2, p, 1) for i, p in enumerate(price)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double, signal int")
    assert [r.signal for r in backtest.stop_loss(df).orderBy("ts").collect()] == [1] * 10 + [0] * 10


def test_costs_lower_returns(spark):
    rows = [("A", DAY + dt.timedelta(days=i), 102.0 + i, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, size double")
    free, dear = (backtest.metrics(backtest.run(df, s, k)).first().total for s, k in ((0.0, 0.0), (0.05, 10.0)))
    assert dear < free


def test_asof_takes_the_latest_at_or_before(spark):
    left = series(spark, [1.0, 2.0, 3.0], ("A",))
    right = spark.createDataFrame([("A", DAY + dt.timedelta(hours=12), 7.0), ("A", DAY + dt.timedelta(days=2), 8.0)], "symbol string, ts timestamp, y double")
    assert [r.asof_y for r in resample.asof(left, right, ["y"]).orderBy("ts").collect()] == [None, 7.0, 8.0]


def test_tables_and_dates_of_pages(spark):
    html = "<p>Seen 2024-03-01 and 5/6/2023, January 2, 2024</p><table id='t'><tr><th data-stat='w'>1</th><td data-stat='pts'>7</td></tr><tr><td data-stat='w'>2</td><td data-stat='pts'>x</td></tr></table><script>var a;</script>"
    df = spark.createDataFrame([(1, "http://a.b/c", html), (2, "http://a.b/d", "")], "page_id bigint, url string, html string")
    rows = pages.table_rows(pages.table_cells(df, "t"), ["w", "pts"])
    assert sorted((r.w, r.pts) for r in pages.fill_with_mean(rows, ["w", "pts"]).collect()) == [(1.0, 7.0), (2.0, 7.0)]
    dated = [(3, "u", "<b>on 2 Sept 2023</b> or 13/12/2023"), (4, "u", "Dec 25, 2022 and 12/13/2023"), (5, "u", "in 1950, 2023-13-45, 2031"), (6, "u", "2023")]
    df = df.union(spark.createDataFrame(dated, df.schema))
    got = {(r.page_id, str(r.newest), r.fresh) for r in pages.freshness(df, "2024-06-29").collect()}
    # a year by itself, also inside a date, stands for the day asked for; what is implausible or undated leaves a page fresh
    assert got == {(1, "2024-06-29", True), (2, "None", True), (3, "2023-12-13", False), (4, "2023-12-13", False), (5, "2023-06-29", False), (6, "2023-06-29", False)}
    assert pages.html_text("<p>a <b>b</b></p><script>x</script>c") == "a b\nc"


def test_round_trips_match_first_in_first_out(spark):
    fills = [("A", 0, 10.0, 1.0), ("A", 1, -4.0, 2.0), ("B", 1, 1.0, 5.0), ("A", 2, -10.0, 3.0), ("B", 2, -1.0, 6.0), ("A", 3, 4.0, 1.0)]
    df = spark.createDataFrame([(s, DAY + dt.timedelta(days=d), q, p) for s, d, q, p in fills], "symbol string, ts timestamp, quantity double, price double")
    got = sorted((r.symbol, r.side, r.opened.day, r.closed.day, r.quantity, r.pnl) for r in backtest.round_trips(df).collect())
    assert got == [("A", "long", 1, 2, 4.0, 4.0), ("A", "long", 1, 3, 6.0, 12.0), ("A", "short", 3, 4, 4.0, 8.0), ("B", "long", 2, 3, 1.0, 1.0)]


def test_renko_bricks(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), v) for i, v in enumerate([10.0, 13.4, None, 11.1, 11.9])], "symbol string, ts timestamp, close double")
    assert [(r.ts.day, r.open, r.close) for r in resample.renko(df, 1.0).orderBy("ts", "k").collect()] == [(2, 10.0, 11.0), (2, 11.0, 12.0), (2, 12.0, 13.0), (4, 13.0, 12.0)]
    with pytest.raises(ValueError, match="larger than 0"):
        resample.renko(df, 0.0)


def test_reports_crosswalk_and_conversion(spark, tmp_path):
    raw = spark.createDataFrame([("A", "2024-01-01", "1", "2", "0.5", "1.5", "9"), ("B", "bad", "1", "2", "0.5", "1.5", "9"), ("B", "2024-01-02", "x", "2", "0.5", "1.5", None)], "raw_symbol string, ts_event string, o string, h string, l string, price string, qty string")
    assert files.conversion_report(raw).first() == (3, 1, 2)
    rows = files.to_bars(raw)
    names = files.crosswalk(spark, {"futures": {"ES": "A"}, "forex": {"EURUSD": "B"}})
    assert [(r.symbol, r.instrument_group) for r in files.with_our_symbols(rows, names).collect()] == [("ES", "futures")]
    assert files.with_our_symbols(rows, names, ["forex"]).count() == 0
    for kind, read in (("csv", lambda p: spark.read.option("header", True).csv(p)), ("json", spark.read.json), ("parquet", spark.read.parquet)):
        path = str(tmp_path / kind)
        files.write_report(files.span_summary(rows), path, kind)
        assert [r.symbol for r in read(path).collect()] == ["A"]
    files.write_report(rows.select("symbol", "close"), str(tmp_path / "plain"), header=False, separator="|")
    assert [r.value for r in spark.read.text(str(tmp_path / "plain")).collect()] == ["A|1.5"]


def test_list_boxes_and_seasons(spark):
    html = "<ul><li><i>Height:</i> 180 cm</li><li class='x'><i> Reach: </i><b>7</b> in</li><li><i></i>no label</li><li>plain</ul><p>x</p>"
    df = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "<li><i>Height</i>  6   ft")], "page_id bigint, url string, html string")
    boxes = pages.list_boxes(df)
    assert sorted(map(tuple, boxes.collect())) == [(1, "Height", "180 cm"), (1, "Reach", "7 in"), (3, "Height", "6 ft")]
    assert sorted((r.page_id, r.Height, r.Reach) for r in pages.box_records(boxes, ["Height", "Reach"]).collect()) == [(1, "180 cm", "7 in"), (3, "6 ft", None)]
    a = spark.createDataFrame([("p", 2020, 3)], "player string, year int, pts int")
    b = spark.createDataFrame([("p", 2020, 7), ("q", 2021, 1)], "player string, year int, yds int")
    assert sorted((r.player, r.year, r.pts, r.yds) for r in pages.merge_seasons([a, b]).collect()) == [("p", 2020, 3, 7), ("q", 2021, None, 1)]


def test_page_text_of_the_given_pages(spark):
    from html import unescape
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in pages.to_text(rows).collect()}
    drop = "|".join(sorted(pages._DROP))
    for r in rows.collect():
        bare = re.sub(rf"(?is)<({drop})\b.*?</\1\s*>", "", re.sub(r"(?s)<!--.*?-->", "", r.html or ""))
        want = "".join(unescape(re.sub(r"(?s)<[^>]+>", "", bare)).split())
        assert "".join(got[r.page_id].split()) == want


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_solve_equals_a_loop(n):
    from lodestar.functions.scan import solve

    draw = np.random.default_rng(n)
    a, b = draw.uniform(-0.2, 1.0, (n, 3)), draw.normal(size=(n, 3))
    y, last = solve(a, b, np.ones(3)), np.ones(3)
    for i in range(n):
        last = a[i] * last + b[i]
        assert np.allclose(y[i], last)


@pytest.mark.parametrize("chunk", [200, 333, 20_000])
def test_robust_z_does_not_hang_on_chunks(spark, chunk):
    draw = np.random.default_rng(1)
    x = np.where(draw.random(1500) < 0.1, np.nan, draw.normal(size=1500))
    rows = [("A", k, k, None if np.isnan(v) else float(v)) for k, v in enumerate(x)] + [("B", k, k, 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "symbol string, ts int, seq int, x double")
    got = quality.robust_z(df, F.col("x"), "z", chunk=chunk).toPandas().sort_values(["symbol", "ts"])
    s = pd.Series(x)
    away = (s - s.rolling(100, min_periods=30).median()).abs()
    spread = 1.4826 * away.rolling(100, min_periods=30).median()
    assert len(got) == 1550 and np.allclose(got.z[got.symbol == "A"].to_numpy(float), away / spread, equal_nan=True) and got.z[got.symbol == "B"].isna().all()
