"""Bars from trades and from finer bars, as-of joins, synthetic instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scan import ewm, scan_state
from lodestar.functions.windows import by_time, ratio

#: The time frames and their seconds.
FRAMES = {"5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "D": 86400}


def ohlcv(seq: str | Column = "seq") -> list[Column]:
    """Aggregates of trades to a bar; first and last by ``seq``, so equal times have an order."""
    at = F.struct("ts", seq)
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")]


def daily(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(*ohlcv())


def tick_bars(ticks: DataFrame, frames: dict[str, int]) -> DataFrame:
    """Bars of ticks in many time frames at once: one shuffle, partial aggregates before it."""
    epoch = F.unix_timestamp("ts")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("frame"), F.lit(s).alias("s")) for name, s in frames.items())))
    rows = ticks.select("symbol", "ts", "price", "volume", "seq", each.alias("f"))
    start = F.timestamp_seconds(F.floor(epoch / F.col("f.s")) * F.col("f.s"))
    return rows.groupBy("symbol", F.col("f.frame").alias("frame"), start.alias("start")).agg(*ohlcv()).withColumnRenamed("start", "ts")


def resample(bars: DataFrame, frames: dict[str, int], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars, left-closed and left-labelled; empty buckets and those without volume are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("frame"), F.lit(s).alias("s")) for name, s in frames.items())))
    rows = bars.withColumn("f", each).withColumn("bucket", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / F.col("f.s")) * F.col("f.s")))
    out = rows.groupBy(*keys, F.col("f.frame").alias("frame"), "bucket").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.where("volume <> 0").withColumnRenamed("bucket", "ts")


def derive(bars: DataFrame, keys: tuple[str, ...] = ("symbol", "frame")) -> DataFrame:
    """``ret, log_ret, range, body, atr14`` of bars; the last is the exponential mean of the range over 14 bars."""
    w = Window.partitionBy(*keys).orderBy("ts")
    before = F.lag("close").over(w)
    bars = bars.withColumns({"ret": ratio(F.col("close"), before) - 1, "log_ret": F.ln(ratio(F.col("close"), before)), "range": F.col("high") - F.col("low"), "body": F.col("close") - F.col("open")})
    return ewm(bars, [("atr14", "range", 2 / 15, 1, "first")], keys)


def asof(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` at or before its time, per symbol.

    Both sides are united and filled forward in one window; no join, no loop.
    """
    facts = F.struct(*columns)
    kind = right.select(facts.alias("facts")).schema["facts"].dataType
    a = left.select("symbol", "ts", F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_facts"))
    b = right.select("symbol", "ts", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), facts.alias("_facts"))
    w = Window.partitionBy("symbol").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_facts", F.last("_facts", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", *(F.col("_facts")[c].alias(f"asof_{c}") for c in columns))


def spread(bars: DataFrame, a: str, b: str, kind: str = "diff") -> DataFrame:
    """A synthetic instrument of two symbols: close and open combined, high and low from both, volume 0."""
    x, y = (bars.where(F.col("symbol") == s).select("ts", F.col("open").alias(f"open_{n}"), F.col("close").alias(f"close_{n}")) for s, n in ((a, "a"), (b, "b")))
    put = (lambda p, q: p - q) if kind == "diff" else ratio
    o, c = put(F.col("open_a"), F.col("open_b")), put(F.col("close_a"), F.col("close_b"))
    return x.join(y, "ts").select(F.lit(f"{a}-{b}" if kind == "diff" else f"{a}/{b}").alias("symbol"), "ts", o.alias("open"), F.greatest(o, c).alias("high"), F.least(o, c).alias("low"), c.alias("close"), F.lit(0.0).alias("volume"))


def returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_time())
    return bars.withColumns({"ret": ratio(F.col("close"), before) - 1, "log_ret": F.ln(ratio(F.col("close"), before))})


def renko(bars: DataFrame, brick: float) -> DataFrame:
    """Bricks of a fixed size: ``symbol, ts, k, open, close``; a bar gives as many as whole bricks fit into its move.

    The last brick's close is carried; a null close gives none, the first close is the base.
    """
    if brick <= 0:
        raise ValueError("a brick must be larger than 0")

    def step(base: float | None, row: tuple) -> tuple[float | None, tuple]:
        (close,) = row
        if close is None or close != close:
            return base, (base, 0)
        if base is None:
            return close, (close, 0)
        n = int(abs(close - base) / brick)
        n = n if close > base else -n
        return base + n * brick, (base, n)

    made = T.StructType([T.StructField("base", T.DoubleType()), T.StructField("n", T.LongType())])
    moves = scan_state(bars.select("symbol", "ts", "close"), lambda: None, step, ["close"], made).where("n <> 0")
    bricks = moves.select("symbol", "ts", "base", F.signum("n").alias("s"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("n"))).alias("k"))
    return bricks.select("symbol", "ts", "k", (F.col("base") + F.col("s") * (F.col("k") - 1) * brick).alias("open"), (F.col("base") + F.col("s") * F.col("k") * brick).alias("close"))
