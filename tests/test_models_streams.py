"""Models on small frames, and streams that give what the batch gives."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import models
from lodestar.operators.resample import tick_bars
from lodestar.sources.bridge import bars, ticks
from lodestar.streaming import jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def tick_stream(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ticks"))
    rows = ticks(spark, SF)
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def test_stream_profile_equals_batch(spark, tick_stream):
    got = drain(jobs.stream_profile(tick_stream), "profile", "complete")
    want = jobs.stream_profile(ticks(spark, SF))
    assert sorted(got.select(*want.columns).drop("volume").collect()) == sorted(want.drop("volume").collect())


def test_stream_bars_are_batch_bars(spark, tick_stream):
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close) for r in drain(jobs.stream_bars(tick_stream, "1 day", "40 days"), "bars").collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close) for r in tick_bars(ticks(spark, SF), {"D": 86400}).collect()}
    assert got.items() <= want.items()  # the last windows stay open within the delay


def test_stream_dedup_and_sessions(spark, tick_stream):
    n = drain(jobs.stream_dedup(tick_stream, "40 days"), "dedup").count()
    assert n == ticks(spark, SF).count()
    drain(jobs.stream_sessions(tick_stream, "30 minutes", "1 minute"), "sessions")


def test_stream_trailing_stop(spark, tick_stream):
    got = drain(jobs.stream_trailing_stop(tick_stream), "stops")
    assert got.count() == ticks(spark, SF).count()
    tops = {r.symbol: r.top for r in got.groupBy("symbol").agg(F.max("top").alias("top")).collect()}
    assert tops == {r.symbol: r.top for r in ticks(spark, SF).groupBy("symbol").agg(F.max("price").alias("top")).collect()}


def test_classifiers_and_regressors(spark):
    rows = models.time_weights(models.split_by_time(models.bar_features(bars(spark, SF)))).persist()
    train, test = rows.where("train"), rows.where("not train")
    model = models.classifier(["ma_gap", "span"], ["symbol"], "weight").fit(train)
    out = models.holdout(model, test).first()
    assert out.n == test.count() and out.accuracy > 0.5
    assert 0 <= rows.agg(F.min("weight")).first()[0] <= 0.11
    fitted = models.regressors(train, ["ma_gap", "span"], ["vol"])
    assert fitted["vol"][1] >= 0
    assert models.boosted(train.limit(300), ["ma_gap", "span"]).transform(test).count() == test.count()


def test_match_features(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    rows = [(1, day(7), "", "W", 1.0), (2, day(1), "@", "L", 1.0), (3, day(1), "@", "W", 1.0), (4, day(9), "", "T", 1.0), (5, day(9), None, None, 1.0), (6, day(3), "", "W", None), (7, None, "", "W", 1.0)]
    games = spark.createDataFrame(rows, "game int, date timestamp, location string, outcome string, x double")
    got = {r.game: r for r in models.match_features(games, ["x"], "game").collect()}
    assert {k: (r.month, r.day_of_week, r.is_home, r.home_win) for k, r in got.items()} == {1: (1, 6, 1, 1), 2: (1, 0, 0, 1), 3: (1, 0, 0, 0), 4: (1, 1, 1, 0), 5: (1, 1, 0, 0)}
    assert [got[k].weight for k in (2, 3, 1, 4, 5)] == pytest.approx([0.1, 0.325, 0.55, 0.775, 1.0])
    assert [r.weight for r in models.match_features(games.where("game = 1"), ["x"], "game").collect()] == [1.0]
    assert models.match_features(games.limit(0), ["x"], "game").count() == 0


def test_match_simulation_follows_the_means(spark):
    games = spark.createDataFrame([(1, 30.0, 5.0, 20.0, 5.0), (2, 20.0, 5.0, 20.0, 5.0)], "game_id bigint, home_mean double, home_std double, away_mean double, away_std double")
    got = {r.game_id: r for r in models.simulate_matches(games, 2000).collect()}
    assert got[1].home_win > 0.88 and 0.45 < got[2].home_win < 0.55 and abs(got[1].home_quartiles[1] - 30) < 0.6


def test_parameter_importance(spark):
    rows = spark.createDataFrame([(float(a), float(b), float(a)) for a in range(10) for b in range(10)], "p double, q double, sharpe double")
    assert models.parameter_importance(rows, ["p", "q"])[0][0] == "p"


def test_stream_renko_equals_batch(spark, tick_stream):
    got = {(r.symbol, r.ts, r.bricks) for r in drain(jobs.stream_renko(tick_stream, 40.0), "renko").where("bricks <> 0").collect()}
    want = set()
    for symbol, rows in ticks(spark, SF).toPandas().sort_values(["ts", "seq"]).groupby("symbol"):
        base = rows.price.iloc[0]
        for ts, price in zip(rows.ts, rows.price, strict=True):
            n = int(abs(price - base) / 40.0) * (1 if price > base else -1)
            base += n * 40.0
            if n:
                want.add((symbol, ts.to_pydatetime(), n))
    assert got == want and len(want) > 50


def test_stream_latest_signal(spark, tick_stream):
    signals = tick_stream.withColumn("signal", (F.col("seq") % 3 - 1).cast("long"))
    got = drain(jobs.stream_latest_signal(signals), "actions")
    for rows in got.toPandas().sort_values("ts").groupby("symbol"):
        before = [0, *rows[1].signal.tolist()[:-1]]
        want = ["CLOSE" if n == 0 and b != 0 else "BUY" if n > 0 >= b else "SELL_SHORT" if n < 0 <= b else "HOLD" for n, b in zip(rows[1].signal, before, strict=True)]
        assert rows[1].action.tolist() == want


def one_symbol(n):
    draw, price, rows = random.Random(3), 100.0, []
    for k in range(n):
        price = max(1.0, price + draw.gauss(0, 1))
        rows.append(("A", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), price, 1.0, k))
    return rows


def walked(rows, brick):
    base, out = rows[0][2], [0]
    for row in rows[1:]:
        n = int(abs(row[2] - base) / brick) * (1 if row[2] > base else -1)
        base += n * brick
        out.append(n)
    return out


TICK = "symbol string, ts timestamp, price double, volume double, seq bigint"


def test_stream_state_is_in_order_across_arrow_batches(spark, tmp_path):
    rows = one_symbol(30_000)
    mixed = random.Random(4).sample(rows, len(rows))
    spark.createDataFrame(mixed, TICK).coalesce(1).write.parquet(str(tmp_path / "t"))
    got = drain(jobs.stream_renko(spark.readStream.schema(TICK).parquet(str(tmp_path / "t")), 2.0), "renko_long").orderBy("ts").collect()
    assert [r.bricks for r in got] == walked(rows, 2.0)


def test_stream_state_waits_for_the_watermark(spark, tmp_path):
    rows = one_symbol(3_000)
    draw = random.Random(5)
    late = sorted(rows, key=lambda r: r[4] + draw.uniform(0, 400))  # out of order across micro-batches, by less than the delay
    for k in range(6):
        spark.createDataFrame(late[k * 500 : (k + 1) * 500], TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = drain(jobs.stream_renko(stream, 2.0, delay="900 seconds"), "renko_late").orderBy("ts").collect()
    want = walked(rows, 2.0)
    assert len(got) == 3_000 - 900 and [r.bricks for r in got] == want[: len(got)]  # the last ones wait within the delay
    assert [r.bricks for r in drain(jobs.stream_renko(stream, 2.0), "renko_early").orderBy("ts").collect()] != want


def test_stream_state_expires(spark, tmp_path):
    day = lambda d, s=0: dt.datetime(2024, 1, d, 0, 0, s)
    for rows in ([("A", day(1), 100.0, 1.0, 1)], [("B", day(3), 5.0, 1.0, 2)], [("B", day(5), 5.0, 1.0, 3)], [("A", day(6), 50.0, 1.0, 4), ("B", day(6), 5.0, 1.0, 5)], [("B", day(9), 5.0, 1.0, 6)]):
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    for expire, top in ((3600, 50.0), (30 * 86400, 100.0)):
        step = lambda state, values: ((max(state[0], values[2]),), (max(state[0], values[2]),))
        made = jobs.stream_state(stream, "top double", "top double", (0.0,), step, delay="1 minute", expire=expire)
        got = {(r.symbol, r.ts): r.top for r in drain(made, f"expiry_{expire}").collect()}
        assert got["A", day(6)] == top and got["B", day(6)] == 5.0
    with pytest.raises(ValueError):
        jobs.stream_state(stream, "top double", "top double", (0.0,), step, expire=5)
