"""Tables of entities, screens and seasons: joins, cleaning of units, averages with fallbacks, trade simulation, pair reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scan import scan_state
from lodestar.functions.windows import by_time, lag, ratio, roll
from lodestar.operators.resample import asof

c = F.col


def union_screens(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of all screens; a column that one lacks is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def merge_on(left: DataFrame, right: DataFrame, key: str = "symbol") -> DataFrame:
    """Outer join of two metric tables; a column that both have is taken from the left, where it has a value."""
    both = [n for n in right.columns if n in left.columns and n != key]
    other = right.withColumnsRenamed({n: f"{n}_y" for n in both})
    joined = left.join(other, key, "full")
    return joined.select(key, *(F.coalesce(n, f"{n}_y").alias(n) if n in both else c(n) for n in left.columns if n != key), *(n for n in right.columns if n not in both and n != key))


def with_both_entities(events: DataFrame, entities: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Events with the attributes of their two entities, suffixed 1 and 2; unknown ones are null."""
    for suffix, col in (("1", first), ("2", second)):
        side = entities.select(*(c(n).alias(f"{n}_{suffix}") for n in entities.columns))
        events = events.join(side, events[col] == side[f"{key}_{suffix}"], "left").drop(f"{key}_{suffix}")
    return events


def plain_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with units as numbers: all but digits and points is left out; what is no number counts as 0."""
    return df.withColumns({n: F.coalesce(F.regexp_replace(c(n).cast("string"), r"[^0-9.]", "").try_cast("double"), F.lit(0.0)) for n in columns})


def age(born: Column, as_of: str) -> Column:
    return F.datediff(F.to_date(F.lit(as_of)), born) / 365.25


def season_averages(games: DataFrame, wanted: DataFrame, stats: list[str]) -> DataFrame:
    """For each wanted ``team, year`` the team's averages of that year, else of the year before, else of all its years; ``basis`` tells which."""
    mean = lambda *by: games.groupBy(*by).agg(*(F.avg(s).alias(s) for s in stats))
    year, every = mean("team", "year"), mean("team")
    own = year.select("team", "year", *(c(s).alias(f"{s}_own") for s in stats), F.lit(1).alias("_own"))
    last = year.select("team", (c("year") + 1).alias("year"), *(c(s).alias(f"{s}_last") for s in stats), F.lit(1).alias("_last"))
    rows = wanted.join(own, ["team", "year"], "left").join(last, ["team", "year"], "left").join(every, "team", "left")
    basis = F.when(c("_own") == 1, "season").when(c("_last") == 1, "season before").otherwise("all")
    pick = lambda s: F.when(c("_own") == 1, c(f"{s}_own")).when(c("_last") == 1, c(f"{s}_last")).otherwise(c(s)).alias(s)
    return rows.select("team", "year", *map(pick, stats), basis.alias("basis"))


def price_filter(screen: DataFrame, low: float = 10.0, high: float = 100.0, price: str = "price") -> DataFrame:
    """Rows whose price is within the limits, or not known."""
    return screen.where(c(price).isNull() | c(price).between(low, high))


def last_bars(bars: DataFrame, n: int = 60) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_i", F.row_number().over(w)).where(c("_i") <= n).drop("_i")


def overlay(curve: DataFrame, fills: DataFrame) -> DataFrame:
    """Fills with the equity of their time; a fill at a time without equity is left out."""
    return fills.join(curve.select("ts", "log_equity"), "ts")


def against_benchmark(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Portfolio values with the benchmark's last close at or before each time."""
    left = portfolio.withColumn("symbol", F.lit("benchmark"))
    return asof(left, benchmark.select(F.lit("benchmark").alias("symbol"), "ts", "close"), ["close"]).drop("symbol")


def simulate_entries(df: DataFrame, slippage: float = 0.01, commission: float = 0.005, share: float = 0.1, window: int = 10) -> DataFrame:
    """Closed trades of a long-only rule ``enter`` (1 or 0): prices with slippage, profit with commission (both in percent), and the capital after, as a share of the first.

    A trade invests a share of the capital and ends where the rule is 0 or after ``window`` bars; an open one at a symbol's last bar ends there without slippage.
    """
    df = df.withColumn("_last", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))) == 1).withColumn("_l", c("_last").cast("int"))

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        close, enter, last = row
        capital, units, price, held = state
        out = (None, None, None, capital)
        if units == 0 and enter == 1:
            price = close * (1 + slippage / 100)
            size = capital * share
            units, capital, held = size / price, capital - size - size * commission / 100, 0
        elif units > 0:
            held += 1
            if enter == 0 or held >= window:
                sold = close * (1 - slippage / 100)
                out = (price, sold, (sold - price) * units - units * sold * commission / 100, None)
                capital, units = capital + units * sold * (1 - commission / 100), 0
        if last and units > 0 and out[0] is None:
            out = (price, close, (close - price) * units - units * close * commission / 100, None)
            capital, units = capital + units * close * (1 - commission / 100), 0
        return (capital, units, price, held), (*out[:3], capital)

    made = T.StructType([T.StructField(n, T.DoubleType()) for n in ("entry", "exit", "profit", "capital")])
    rows = scan_state(df.select("symbol", "ts", "close", "enter", "_l"), lambda: (1.0, 0.0, 0.0, 0), step, ["close", "enter", "_l"], made)
    outcome = F.when(c("profit") > 0, "Win").when(c("profit") < 0, "Loss").otherwise("Break Even")
    return rows.where("entry is not null").select("symbol", "ts", "entry", "exit", "profit", "capital", outcome.alias("outcome"))


def pair_report(lags: DataFrame, fits: DataFrame, least_corr: float = 0.7, critical: float = -3.34) -> DataFrame:
    """Lag, lead and spread of each pair in one row, a score that grows with the correlation and with how far the statistic is under its critical value, and whether it is on the shortlist."""
    rows = lags.join(fits.select("a", "b", "alpha", "beta", "half_life", "t"), ["a", "b"])
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(c("t"), F.lit(critical))))
    rows = rows.withColumn("score", F.abs("corr") * strength).withColumn("shortlisted", (F.abs("corr") >= least_corr) & (c("t") <= critical))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 9)), "a", "b")))  # one row a pair


def report_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("pairs"), F.sum(c("shortlisted").cast("int")).alias("shortlisted"), F.avg(F.abs("corr")).alias("mean_corr"), F.max("score").alias("best_score"))


def covered(bars: DataFrame, last: int = 1000, least: float = 0.85) -> DataFrame:
    """The symbols with a bar at enough of the last times of the universe."""
    times = bars.select("ts").distinct().orderBy(F.desc("ts")).limit(last)
    n = times.agg(F.count("*").alias("n"))
    share = bars.join(F.broadcast(times), "ts", "left_semi").groupBy("symbol").agg(F.countDistinct("ts").alias("k"))
    return share.join(n).select("symbol", (c("k") / c("n")).alias("coverage")).where(c("coverage") >= least)


def month_end_edge(daily: DataFrame, window: int = 5) -> DataFrame:
    """Mean return by offset from the month's last bar against the bars in mid-month, and by offset from its first bar."""
    month = Window.partitionBy("symbol", F.year("ts"), F.month("ts"))
    rows = daily.withColumn("ret", ratio(c("close"), lag("close")) - 1)
    rows = rows.withColumns({"offset": F.row_number().over(month.orderBy("ts")) - F.count("*").over(month), "start": F.row_number().over(month.orderBy("ts"))}).where("ret is not null")
    base = rows.where(c("offset") < -window).groupBy("symbol").agg(F.avg("ret").alias("mid_mean"))
    each = F.explode(F.array(F.struct(F.lit("end").alias("side"), c("offset").alias("k"), (c("offset") >= -window).alias("on")), F.struct(F.lit("start").alias("side"), c("start").alias("k"), (c("start") <= window).alias("on"))))
    rows = rows.select("symbol", "ret", each.alias("e")).where("e.on").groupBy("symbol", c("e.side").alias("side"), c("e.k").alias("offset")).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))
    return rows.join(base, "symbol", "left").withColumn("edge", c("mean") - c("mid_mean"))


#: Parts of names that hint at times and at prices.
TIME_HINTS = ("date", "time", "timestamp", "datetime", "ts")


def time_ranges(df: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    """Least and greatest time of each column whose name hints at one."""
    names = explicit or [f.name for f in df.schema if any(h in f.name.lower() for h in TIME_HINTS)]
    one = lambda n: c(f"`{n}`") if isinstance(df.schema[n].dataType, T.TimestampType | T.DateType) else F.try_to_timestamp(c(f"`{n}`").cast("string"))
    sums = df.agg(*(x for k, n in enumerate(names) for x in (F.min(one(n).cast("timestamp")).alias(f"a{k}"), F.max(one(n).cast("timestamp")).alias(f"b{k}"))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), c(f"a{k}").alias("first"), c(f"b{k}").alias("last")) for k, n in enumerate(names)))).alias("e")).select("e.*")


def common_values(df: DataFrame, columns: list[str], most: int = 50, n: int = 5) -> DataFrame:
    """The n most frequent values of each column with at most ``most`` distinct ones; of the others one row that says so."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in columns))).alias("e")).select("e.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    few = counts.join(kinds.where(c("distinct") <= most), "column").withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)
    many = kinds.where(c("distinct") > most).select("column", F.lit("(too many)").alias("value"), F.lit(None).cast("bigint").alias("n"), "distinct", F.lit(1).alias("rank"))
    return few.select("column", "value", "n", "distinct", "rank").unionByName(many)


def renko_by_range(bars: DataFrame, length: int = 14, volume: str = "last") -> DataFrame:
    """Bricks as wide as the mean true range of the bar: ``symbol, ts, k, open, close, volume``.

    The bar's volume goes to its last brick, to all alike (``equal``) or to none (``zero``).  Bars without a mean range give no bricks.
    """
    before = lag("close")
    span = F.greatest(c("high") - c("low"), F.coalesce(F.abs(c("high") - before), F.lit(0.0)), F.coalesce(F.abs(c("low") - before), F.lit(0.0)))
    df = bars.withColumn("_t", span).withColumn("_w", roll("_t", F.avg, length))

    def step(base: float | None, row: tuple) -> tuple[float | None, tuple]:
        close, wide = row
        if close is None or close != close:
            return base, (base, 0)
        if base is None:
            return close, (close, 0)
        if wide is None or wide != wide or wide <= 0:
            return base, (base, 0)
        n = int(abs(close - base) / wide)
        n = n if close > base else -n
        return base + n * wide, (base, n)

    made = T.StructType([T.StructField("_base", T.DoubleType()), T.StructField("_n", T.LongType())])
    moves = scan_state(df.select("symbol", "ts", "close", "volume", "_w"), lambda: None, step, ["close", "_w"], made).where("_n <> 0")
    rows = moves.select("symbol", "ts", "volume", "_w", "_base", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n"))).alias("k"))
    put = {"last": F.when(c("k") == F.abs("_n"), c("volume")).otherwise(0.0), "equal": c("volume") / F.abs("_n"), "zero": F.lit(0.0)}[volume]
    return rows.select("symbol", "ts", "k", (c("_base") + F.signum("_n") * (c("k") - 1) * c("_w")).alias("open"), (c("_base") + F.signum("_n") * c("k") * c("_w")).alias("close"), put.alias("volume"))
