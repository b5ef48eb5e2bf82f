"""Statistical patterns of bars: calendar, gaps, momentum, volatility, volume and run statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scan import ewm
from lodestar.functions.solve import least_squares
from lodestar.functions.windows import by_time, so_far, diff, pct_change, quantile_bins, ratio, roll, streak

#: The 5 % points of the chi-square distribution by degrees of freedom.
CHI_5 = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.07, 6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919, 10: 18.307}


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"ret": pct_change("close"), "range": F.col("high") - F.col("low")})


def stats(x: str = "ret", periods: float = 252.0) -> list[Column]:
    """Count, mean, deviation, share of gains and annualised Sharpe ratio of ``x``."""
    sharpe = ratio(F.avg(x), F.stddev_samp(x)) * F.lit(periods**0.5)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((F.col(x) > 0).cast("double")).alias("win_rate"), sharpe.alias("sharpe")]


def day_of_week(daily: DataFrame, least: int = 5) -> DataFrame:
    rows = with_returns(daily).where("ret is not null")
    extra = [F.percentile("ret", 0.5).alias("median"), F.avg("range").alias("avg_range"), F.avg(F.abs("ret")).alias("mean_abs")]
    return rows.groupBy("symbol", F.weekday("ts").alias("dow")).agg(*stats(periods=52.0), *extra).where(F.col("n") >= least)


def time_of_day(bars: DataFrame, minutes: int = 30, least: int = 10) -> DataFrame:
    bucket = F.floor((F.hour("ts") * 60 + F.minute("ts")) / minutes) * minutes
    return with_returns(bars).where("ret is not null").groupBy(F.weekday("ts").alias("dow"), bucket.alias("minute")).agg(*stats()).where(F.col("n") >= least)


def month_offset(daily: DataFrame, window: int = 5) -> DataFrame:
    """Return statistics by the bar's offset from the last one of its month (0, -1, ...)."""
    month = Window.partitionBy("symbol", F.year("ts"), F.month("ts"))
    rows = with_returns(daily).withColumn("offset", F.row_number().over(month.orderBy("ts")) - F.count("*").over(month))
    return rows.where((F.col("offset") >= -window) & F.col("ret").isNotNull()).groupBy("symbol", "offset").agg(*stats())


def month_seasonality(daily: DataFrame) -> DataFrame:
    return with_returns(daily).where("ret is not null").groupBy("symbol", F.month("ts").alias("month")).agg(*stats())


def session_gaps(daily: DataFrame, least: float = 0.01) -> DataFrame:
    """Open against the close before: direction, size and whether the same bar fills it."""
    before = F.lag("close").over(by_time())
    rows = daily.withColumn("prev", before).where("prev is not null").withColumn("gap", ratio(F.col("open"), F.col("prev")) - 1)
    filled = F.when(F.col("gap") > 0, F.col("low") <= F.col("prev")).otherwise(F.col("high") >= F.col("prev"))
    return rows.where(F.abs("gap") >= least).select("symbol", "ts", "gap", F.when(F.col("gap") > 0, "up").otherwise("down").alias("direction"), filled.alias("filled"), F.weekday("ts").alias("dow"))


def gap_summary(daily: DataFrame, least: float = 0.01) -> DataFrame:
    """Fill rates in total, by direction and by weekday, as grouping sets in one pass."""
    rows = session_gaps(daily, least).withColumns({"hit": F.col("filled").cast("double"), "size": F.abs("gap")})
    sets = rows.groupingSets([["direction"], ["dow"], []], "direction", "dow")
    return sets.agg(F.count("*").alias("n"), F.avg("hit").alias("fill_rate"), F.percentile("size", 0.5).alias("median_gap"))


def gap_quintiles(daily: DataFrame) -> DataFrame:
    after = F.lead("close").over(by_time())
    rows = daily.withColumn("next_ret", ratio(after, F.col("close")) - 1)
    rows = rows.withColumn("size", F.abs(ratio(F.col("open"), F.lag("close").over(by_time())) - 1)).where("size is not null")
    return quantile_bins(rows, "size", 5, "bin").groupBy("symbol", "bin").agg(F.count("*").alias("n"), F.avg("next_ret").alias("next_mean"), F.avg("size").alias("mean_gap"))


def autocorrelation(daily: DataFrame, lags: int = 10, absolute: bool = False) -> DataFrame:
    """Correlation of the return with itself 1..lags bars before: the lags as columns of one window, one aggregate."""
    rows = with_returns(daily).withColumn("x", F.abs("ret") if absolute else F.col("ret"))
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"x{k}", F.lag("x", k).over(by_time()))
    wide = rows.groupBy("symbol").agg(*(F.corr("x", f"x{k}").alias(f"r{k}") for k in range(1, lags + 1)))
    return wide.select("symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(1, lags + 1)))).alias("e")).select("symbol", "e.lag", "e.r")


def ljung_box(daily: DataFrame, lags: int = 5) -> DataFrame:
    """Ljung-Box Q (autocorrelations about the overall mean) and Durbin-Watson."""
    rows = with_returns(daily).where("ret is not null")
    mean = Window.partitionBy("symbol")
    rows = rows.withColumn("e", F.col("ret") - F.avg("ret").over(mean))
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"e{k}", F.lag("e", k).over(by_time()))
    sums = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ss"), F.sum((F.col("e") - F.col("e1")) ** 2).alias("dd"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    q = sum((ratio(F.col(f"s{k}"), F.col("ss")) ** 2 / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.select("symbol", "n", (F.col("n") * (F.col("n") + 2) * q).alias("q"), ratio(F.col("dd"), F.col("ss")).alias("durbin_watson"))


def momentum_rules(daily: DataFrame, lookbacks: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Long after N bars that rose in sum: trades, win rate, Sharpe ratio and profit factor."""
    rows = with_returns(daily)
    sums = {n: F.when(F.count("ret").over(by_time().rowsBetween(-n, -1)) == n, F.sum("ret").over(by_time().rowsBetween(-n, -1))) for n in lookbacks}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("lookback"), F.col(f"m{n}").alias("m")) for n in lookbacks)))
    rows = rows.withColumns({f"m{n}": c for n, c in sums.items()}).select("symbol", "ts", "ret", each.alias("e")).where("e.m > 0 and ret is not null")
    gain, loss = (F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)), F.sum(F.when(F.col("ret") < 0, -F.col("ret")).otherwise(0.0)))
    return rows.groupBy("symbol", F.col("e.lookback").alias("lookback")).agg(*stats(), ratio(gain, loss).alias("profit_factor"))


def best_rule(daily: DataFrame) -> DataFrame:
    rules = momentum_rules(daily)
    return rules.groupBy("symbol").agg(F.max_by("lookback", F.struct("sharpe", -F.col("lookback"))).alias("lookback"), F.max("sharpe").alias("sharpe"))


def atr_regimes(daily: DataFrame, n: int = 14, low: float = 0.33, high: float = 0.67, ahead: tuple[int, ...] = (1, 2, 3, 5), least: int = 10) -> DataFrame:
    """Statistics of a bar's return and of the returns after it, by regime of the range's exponential mean: low up to one quantile, high from another on."""
    rows = ewm(with_returns(daily), [("atr", "range", 2 / (n + 1), 1, "first")])
    rows = rows.withColumns({f"fwd_{k}": ratio(F.lead("close", k).over(by_time()), F.col("close")) - 1 for k in ahead})
    edges = rows.groupBy("symbol").agg(F.percentile("atr", [low, high]).alias("edges"))
    regime = F.when(F.col("atr") >= F.col("edges")[1], "high").when(F.col("atr") <= F.col("edges")[0], "low").otherwise("mid")
    after = [x for k in ahead for x in (F.avg(f"fwd_{k}").alias(f"mean_fwd_{k}"), F.avg((F.col(f"fwd_{k}") > 0).cast("double")).alias(f"win_fwd_{k}"))]
    return rows.join(edges, "symbol").groupBy("symbol", regime.alias("regime")).agg(*stats(periods=1.0), F.avg("atr").alias("avg_atr"), *after).where(F.col("n") >= least)


def narrow_range(daily: DataFrame, sizes: tuple[int, ...] = (4, 7)) -> DataFrame:
    """Bars whose range is the least of the last n: forward returns by direction of the bar."""
    rows = with_returns(daily).withColumn("fwd", ratio(F.lead("close").over(by_time()), F.col("close")) - 1)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"nr{n}").alias("on")) for n in sizes)))
    rows = rows.withColumns({f"nr{n}": F.col("range") == roll("range", F.min, n) for n in sizes}).select("symbol", "fwd", F.when(F.col("close") >= F.col("open"), "up").otherwise("down").alias("direction"), each.alias("e"))
    return rows.where("e.on and fwd is not null").groupBy("symbol", F.col("e.n").alias("size"), "direction").agg(*stats("fwd"))


def range_expansion(daily: DataFrame, n: int = 7, ahead: int = 5) -> DataFrame:
    """Mean range 1..ahead bars after the narrowest of n bars, against the overall mean."""
    rows = with_returns(daily).withColumn("nr", F.col("range") == roll("range", F.min, n))
    rows = rows.withColumns({f"f{k}": F.lead("range", k).over(by_time()) for k in range(1, ahead + 1)})
    wide = rows.groupBy("symbol").agg(F.avg("range").alias("base"), *(F.avg(F.when(F.col("nr"), F.col(f"f{k}"))).alias(f"a{k}") for k in range(1, ahead + 1)))
    return wide.select("symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("ahead"), ratio(F.col(f"a{k}"), F.col("base")).alias("expansion")) for k in range(1, ahead + 1)))).alias("e")).select("symbol", "e.ahead", "e.expansion")


def rescaled_ranges(rows: DataFrame, by: tuple[str, ...], least: int, most: int, points: int = 20) -> DataFrame:
    """``by..., size, rs``: mean R/S of non-overlapping pieces of ``rows(by, i, ret)``, i from 0, for sizes spaced evenly in logarithm up to half of the series."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    top = F.least(F.lit(most), F.floor(F.col("n") / 2)).cast("double")
    step = (F.log10(top) - F.lit(math.log10(least))) / (points - 1)
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.floor(F.pow(F.lit(10.0), F.lit(math.log10(least)) + k * step) + 1e-9)))
    n = n.where(top > least).select(*by, F.explode(sizes).alias("size"))
    each = rows.join(n, list(by)).withColumn("piece", F.floor(F.col("i") / F.col("size")))
    piece = Window.partitionBy(*by, "size", "piece")
    each = each.withColumn("full", F.count("*").over(piece) == F.col("size")).where("full").withColumn("d", F.col("ret") - F.avg("ret").over(piece))
    each = each.withColumn("c", F.sum("d").over(piece.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy(*by, "size", "piece").agg(ratio(F.max("c") - F.min("c"), F.stddev_samp("ret")).alias("rs")).groupBy(*by, "size").agg(F.avg("rs").alias("rs")).where("rs > 0")


def hurst(daily: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """Rescaled-range slope over about 20 sizes of pieces."""
    rows = with_returns(daily).where("ret is not null").withColumn("i", F.row_number().over(by_time()) - 1).select("symbol", "i", "ret")
    return rescaled_ranges(rows, ("symbol",), least, most).groupBy("symbol").agg(F.regr_slope(F.log10("rs"), F.log10("size")).alias("hurst"), F.count("*").alias("sizes"))


def rolling_hurst(daily: DataFrame, window: int = 252, step: int = 21, least: int = 10) -> DataFrame:
    """The slope in windows that step through a symbol's returns; a return goes to the windows it is in, which are a range of whole numbers."""
    rows = with_returns(daily).where("ret is not null").withColumn("i", F.row_number().over(by_time()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (window - 1)) / step)).cast("int")
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - window) / step)).cast("int")
    rows = rows.where((F.col("n") >= window) & (first <= last)).select("symbol", "ts", "i", "ret", F.explode(F.sequence(first, last)).alias("window"))
    rows = rows.withColumn("i", F.col("i") - F.col("window") * step)
    ends = rows.groupBy("symbol", "window").agg(F.max("ts").alias("ts"))
    slopes = rescaled_ranges(rows.select("symbol", "window", "i", "ret"), ("symbol", "window"), least, window // 2)
    return slopes.groupBy("symbol", "window").agg(F.regr_slope(F.log10("rs"), F.log10("size")).alias("hurst")).join(ends, ["symbol", "window"]).select("symbol", "ts", "hurst")


def variance_ratio(daily: DataFrame, lags: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """Variance of overlapping q-bar log returns over q times the variance of one."""
    rows = daily.withColumn("r", F.ln(ratio(F.col("close"), F.lag("close").over(by_time())))).where("r is not null")
    rows = rows.withColumns({f"s{q}": roll("r", F.sum, q) for q in lags})
    wide = rows.groupBy("symbol").agg(F.var_samp("r").alias("v"), *(F.var_samp(f"s{q}").alias(f"v{q}") for q in lags))
    return wide.select("symbol", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), ratio(F.col(f"v{q}"), q * F.col("v")).alias("vr")) for q in lags))).alias("e")).select("symbol", "e.q", "e.vr", F.when(F.col("e.vr") > 1.05, "trending").when(F.col("e.vr") < 0.95, "reverting").otherwise("random").alias("label"))


def overnight_split(daily: DataFrame) -> DataFrame:
    rows = daily.withColumn("prev", F.lag("close").over(by_time())).where("prev is not null")
    rows = rows.withColumns({"overnight": ratio(F.col("open"), F.col("prev")) - 1, "intraday": ratio(F.col("close"), F.col("open")) - 1})
    return rows.groupBy("symbol", F.weekday("ts").alias("dow")).agg(F.count("*").alias("n"), F.avg("overnight").alias("overnight"), F.avg("intraday").alias("intraday"))


def opening_range(ticks: DataFrame, minutes: int = 60) -> DataFrame:
    """Per symbol and day: the range of the first minutes, and whether and where the rest of the day leaves it."""
    day = F.date_trunc("day", "ts")
    minute = F.hour("ts") * 60 + F.minute("ts")
    early = minute < minutes
    rows = ticks.groupBy("symbol", day.alias("day")).agg(F.max(F.when(early, F.col("price"))).alias("or_high"), F.min(F.when(early, F.col("price"))).alias("or_low"), F.max(F.when(~early, F.col("price"))).alias("high"), F.min(F.when(~early, F.col("price"))).alias("low"))
    rows = rows.where("or_high is not null and high is not null")
    return rows.withColumns({"broke_up": F.col("high") > F.col("or_high"), "broke_down": F.col("low") < F.col("or_low"), "went_on": F.col("high") >= 2 * F.col("or_high") - F.col("or_low")})


def opening_rates(ticks: DataFrame, minutes: int = 60) -> DataFrame:
    rows = opening_range(ticks, minutes)
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("symbol").agg(F.count("*").alias("days"), rate("broke_up").alias("up_rate"), rate("broke_down").alias("down_rate"), F.avg(F.when(F.col("broke_up"), F.col("went_on").cast("double"))).alias("continuation"))


def volume_quintiles(daily: DataFrame, least: int = 20) -> DataFrame:
    rows = with_returns(daily).withColumn("fwd", F.lead("ret").over(by_time())).where("fwd is not null")
    return quantile_bins(rows, "volume", 5, "bin").groupBy("symbol", "bin").agg(*stats("fwd")).where(F.col("n") >= least)


def vol_quartiles(daily: DataFrame, n: int = 21) -> DataFrame:
    rows = with_returns(daily)
    rows = rows.withColumns({"vol": roll("ret", F.stddev_samp, n), "fwd": F.lead("ret").over(by_time())}).where("vol is not null and fwd is not null")
    return quantile_bins(rows, "vol", 4, "bin").groupBy("symbol", "bin").agg(*stats("fwd"))


def event_days(daily: DataFrame) -> DataFrame:
    """Third-Friday expiry, last bar of a quarter, first five bars of January, against the other bars."""
    rows = with_returns(daily)
    first = F.date_trunc("month", "ts").cast("date")
    expiry = F.to_date("ts") == F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)
    quarter_end = F.coalesce(F.month(F.lead("ts").over(by_time())) != F.month("ts"), F.lit(True)) & (F.month("ts") % 3 == 0)
    year = Window.partitionBy("symbol", F.year("ts")).orderBy("ts")
    january = (F.month("ts") == 1) & (F.row_number().over(year) <= 5)
    flags = {"expiry": expiry, "quarter_end": quarter_end, "january": january}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).where("ret is not null")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("event"), F.col(k).alias("on")) for k in flags)))
    return rows.select("ret", each.alias("e")).groupBy(F.col("e.event").alias("event"), F.col("e.on").alias("is_event")).agg(*stats())


def runs_test(daily: DataFrame) -> DataFrame:
    """Wald-Wolfowitz runs of the return's sign: runs, expected runs and z."""
    rows = with_returns(daily).where("ret <> 0").withColumn("up", F.col("ret") > 0)
    rows = rows.withColumn("fresh", F.coalesce(F.col("up") != F.lag("up").over(by_time()), F.lit(True)))
    sums = rows.groupBy("symbol").agg(F.sum(F.col("fresh").cast("int")).alias("runs"), F.sum(F.col("up").cast("double")).alias("a"), F.sum((~F.col("up")).cast("double")).alias("b"))
    n, p = F.col("a") + F.col("b"), 2 * F.col("a") * F.col("b")
    expected = ratio(p, n) + 1
    return sums.select("symbol", "runs", expected.alias("expected"), ratio(F.col("runs") - expected, F.sqrt(ratio(p * (p - n), n * n * (n - 1)))).alias("z"))


def range_zones(daily: DataFrame, n: int = 14) -> DataFrame:
    rows = with_returns(daily)
    rows = rows.withColumns({"rel": ratio(F.col("range"), roll("range", F.avg, n)), "fwd": F.lead("ret").over(by_time())}).where("rel is not null and fwd is not null")
    zone = F.when(F.col("rel") <= 0.7, "narrow").when(F.col("rel") <= 1.3, "normal").otherwise("wide")
    return rows.groupBy("symbol", zone.alias("zone")).agg(*stats("fwd"))


def streak_stats(daily: DataFrame, longest: int = 4) -> DataFrame:
    """Next-bar statistics after at least k bars up, or down, in a row."""
    rows = with_returns(daily).withColumn("fwd", F.lead("ret").over(by_time()))
    rows = streak(streak(rows, F.col("ret") > 0, "up"), F.col("ret") < 0, "down").where("fwd is not null")
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(k).alias("k"), (F.col(d) >= k).alias("on")) for d in ("up", "down") for k in range(1, longest + 1))))
    return rows.select("symbol", "fwd", each.alias("e")).where("e.on").groupBy("symbol", F.col("e.direction").alias("direction"), F.col("e.k").alias("k")).agg(*stats("fwd"))


def vwap_deviation(ticks: DataFrame, ahead: int = 30) -> DataFrame:
    """Mean of the next returns by quintile of the distance from the day's volume-weighted price."""
    day = Window.partitionBy("symbol", F.date_trunc("day", "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = ticks.withColumn("ret", pct_change("price")).withColumn("vwap", ratio(F.sum(F.col("price") * F.col("volume")).over(day), F.sum("volume").over(day)))
    next_n = by_time().rowsBetween(1, ahead)
    rows = rows.withColumns({"dev": ratio(F.col("price"), F.col("vwap")) - 1, "fwd": F.when(F.count("ret").over(next_n) == ahead, F.sum("ret").over(next_n))}).where("dev is not null and fwd is not null")
    return quantile_bins(rows, "dev", 5, "bin").groupBy("symbol", "bin").agg(F.count("*").alias("n"), F.avg("fwd").alias("fwd_mean"), F.avg("dev").alias("dev_mean"))


def hourly_reversal(ticks: DataFrame, least: int = 30) -> DataFrame:
    """Lag-1 autocorrelation of returns within each hour of the day."""
    rows = ticks.withColumn("ret", pct_change("price")).where("ret is not null").withColumn("hour", F.hour("ts"))
    within = Window.partitionBy("symbol", "hour").orderBy("ts")
    rows = rows.withColumn("before", F.lag("ret").over(within))
    sums = rows.groupBy("symbol", "hour").agg(F.count("*").alias("n"), F.corr("ret", "before").alias("r")).where(F.col("n") >= least)
    return sums.withColumn("label", F.when(F.col("r") > 0.05, "momentum").when(F.col("r") < -0.05, "reversion").otherwise("neutral"))


def drawdowns(bars: DataFrame) -> DataFrame:
    """Absolute, relative and log fall from the highest close so far."""
    top = F.max("close").over(so_far())
    return bars.select("symbol", "ts", (top - F.col("close")).alias("dd"), (1 - ratio(F.col("close"), top)).alias("dd_pct"), (F.ln(top) - F.ln("close")).alias("dd_log"))


def arch_lm(daily: DataFrame, lags: int = 5) -> DataFrame:
    """Engle's test: n times R squared of squared returns on the ``lags`` squared returns before, and their lag-1 correlation."""
    rows = with_returns(daily).where("ret is not null").withColumn("sq", F.col("ret") ** 2)
    rows = rows.withColumns({f"q{k}": F.lag("sq", k).over(by_time()) for k in range(1, lags + 1)})
    first = rows.groupBy("symbol").agg(F.corr("sq", "q1").alias("r"))
    fit = least_squares(rows, "sq", [f"q{k}" for k in range(1, lags + 1)], ["symbol"])
    return fit.join(first, "symbol").select("symbol", "n", (F.col("n") * F.col("r2")).alias("lm"), "r", (F.col("n") * F.col("r2") > CHI_5[lags]).alias("clustered"))


def unit_root(daily: DataFrame, lags: int = 4) -> DataFrame:
    """Augmented Dickey-Fuller statistic of closes and of returns with a constant and ``lags`` lagged differences, and the 5 % verdict."""
    rows = with_returns(daily)
    each = F.explode(F.array(F.struct(F.lit("level").alias("series"), F.col("close").alias("x")), F.struct(F.lit("return").alias("series"), F.col("ret").alias("x"))))
    rows = rows.select("symbol", "ts", each.alias("e")).select("symbol", "ts", "e.*").where("x is not null")
    w = Window.partitionBy("symbol", "series").orderBy("ts")
    rows = rows.withColumns({"x1": F.lag("x").over(w), "d": F.col("x") - F.lag("x").over(w)}).withColumns({f"d{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)})
    fit = least_squares(rows, "d", [*(f"d{k}" for k in range(1, lags + 1)), "x1"], ["symbol", "series"])
    return fit.select("symbol", "series", "n", F.element_at("t", -1).alias("t")).withColumn("stationary", F.col("t") < -2.86)


def session_gap_detail(bars: DataFrame, opens: int = 570, closes: int = 960, least: float = 0.01, edges: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """Gaps in percent between the session's opening bar and the closing bar of the session before: direction, bucket, weekend, whether and after how many minutes the day fills it.

    ``opens`` and ``closes`` are minutes of the day; the session before is the last day with an opening bar.
    """
    minute, day = F.hour("ts") * 60 + F.minute("ts"), F.date_trunc("day", "ts")
    rows = bars.withColumns({"minute": minute, "day": day})
    days = rows.where(F.col("minute").between(opens, closes)).groupBy("symbol", "day").agg(F.min_by(F.when(F.col("minute") == opens, F.col("open")), F.when(F.col("minute") == opens, F.col("ts"))).alias("session_open"), F.max_by(F.when(F.col("minute") == closes, F.col("close")), F.when(F.col("minute") == closes, F.col("ts"))).alias("session_close"))
    w = Window.partitionBy("symbol").orderBy("day")
    days = days.where("session_open is not null").withColumn("prior_close", F.lag("session_close").over(w)).where("prior_close is not null")
    days = days.withColumn("gap_pct", 100 * (ratio(F.col("session_open"), F.col("prior_close")) - 1)).where(F.abs("gap_pct") >= least)
    inside = rows.where(F.col("minute").between(opens, closes)).select("symbol", "day", "minute", "low", "high")
    met = F.when(F.col("gap_pct") > 0, F.col("low") <= F.col("prior_close")).otherwise(F.col("high") >= F.col("prior_close"))
    fills = inside.join(days, ["symbol", "day"]).groupBy("symbol", "day").agg(F.min(F.when(met, F.col("minute") - opens)).alias("fill_minutes"))
    size = F.abs("gap_pct")
    bucket = F.lit(None).cast("string")
    for e in reversed(edges):
        bucket = F.when(size < e, f"< {e}%").otherwise(F.coalesce(bucket, F.lit(f">= {edges[-1]}%")))
    return days.join(fills, ["symbol", "day"], "left").select(
        "symbol", "day", (F.weekday("day") == 0).alias("weekend"), "prior_close", "session_open", "gap_pct", F.when(F.col("gap_pct") > 0, "up").otherwise("down").alias("direction"), bucket.alias("bucket"), F.col("fill_minutes").isNotNull().alias("filled"), "fill_minutes"
    )


def session_gap_summary(bars: DataFrame, **options) -> DataFrame:
    """Events, fill rate and median minutes to the fill by bucket, direction, weekend and weekday, as grouping sets in one pass."""
    rows = session_gap_detail(bars, **options).withColumns({"dow": F.weekday("day"), "hit": F.col("filled").cast("double")})
    sets = rows.groupingSets([["bucket"], ["direction"], ["weekend"], ["dow"], []], "bucket", "direction", "weekend", "dow")
    return sets.agg(F.count("*").alias("n"), F.avg("hit").alias("fill_rate"), F.percentile("fill_minutes", 0.5).alias("median_minutes"))


def gap_fills(daily: DataFrame, q: int = 5) -> DataFrame:
    """Share of gaps that their own day fills, and the next day's return, by quantile of the gap's size."""
    rows = daily.withColumn("prev", F.lag("close").over(by_time())).withColumn("gap", ratio(F.col("open"), F.col("prev")) - 1).where("gap is not null")
    filled = F.when(F.col("gap") > 0, F.col("low") <= F.col("prev")).otherwise(F.col("high") >= F.col("prev"))
    rows = rows.withColumns({"size": F.abs("gap"), "hit": filled.cast("double"), "next_ret": ratio(F.lead("close").over(by_time()), F.col("close")) - 1})
    return quantile_bins(rows, "size", q, "bin").groupBy("symbol", "bin").agg(F.count("*").alias("n"), F.avg("hit").alias("fill_rate"), F.avg("next_ret").alias("next_mean"), F.avg((F.col("next_ret") > 0).cast("double")).alias("next_win"))


def day_types(daily: DataFrame, wide: float = 1.2, narrow: float = 0.8) -> DataFrame:
    """``day_type`` by the range over its exponential mean, and signals known before the open: a large gap, a close near an end of its range, a narrow bar, the weekday; ``score`` adds them up."""
    rows = ewm(with_returns(daily), [("atr", "range", 2 / 15, 1, "first")])
    rel = ratio(F.col("range"), F.col("atr"))
    w = by_time()
    rows = rows.withColumns({"day_type": F.when(rel > wide, "trend").when(rel < narrow, "chop").otherwise("neutral"), "_c": F.lag("close").over(w), "_l": F.lag("low").over(w), "_r": F.lag("range").over(w)})
    lowest = F.when(F.count("_r").over(w.rowsBetween(-6, 0)) >= 4, F.min("_r").over(w.rowsBetween(-6, 0)))
    rows = rows.withColumns({"gap_size": F.abs(ratio(F.col("open") - F.col("_c"), F.col("_c"))), "close_rank": ratio(F.col("_c") - F.col("_l"), F.col("_r")), "_m": lowest})
    edge = rows.groupBy("symbol").agg(F.percentile("gap_size", 0.6).alias("_edge"))
    on = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    rows = rows.join(edge, "symbol").withColumns({"sig_gap": on(F.col("gap_size") > F.col("_edge")), "sig_close_rank": on((F.col("close_rank") > 0.7) | (F.col("close_rank") < 0.3)), "sig_narrow": on(F.col("_r") == F.col("_m")), "sig_dow": on(F.weekday("ts").isin(1, 2))})
    return rows.select("symbol", "ts", "day_type", "gap_size", "close_rank", *(f"sig_{n}" for n in ("gap", "close_rank", "narrow", "dow")), (F.col("sig_gap") + F.col("sig_close_rank") + F.col("sig_narrow") + F.col("sig_dow")).alias("score"))


def signal_lift(typed: DataFrame, least: int = 20, least_side: int = 5) -> DataFrame:
    """How often days with each signal, and without, are trend days among trend and chop days, and the lift over all of them."""
    names = ("gap", "close_rank", "narrow", "dow")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(f"sig_{n}").alias("on")) for n in names)))
    rows = typed.where(F.col("day_type").isin("trend", "chop")).select("symbol", (F.col("day_type") == "trend").cast("double").alias("hit"), each.alias("e")).select("symbol", "hit", "e.*")
    fired = F.col("on") == 1
    sums = rows.groupBy("symbol", "signal").agg(F.count("*").alias("n"), F.sum(fired.cast("int")).alias("fired"), F.avg("hit").alias("base_rate"), F.avg(F.when(fired, F.col("hit"))).alias("rate_fired"), F.avg(F.when(~fired, F.col("hit"))).alias("rate_not"))
    return sums.where((F.col("n") >= least) & (F.col("fired") >= least_side) & (F.col("n") - F.col("fired") >= least_side)).withColumn("lift", ratio(F.col("rate_fired"), F.col("base_rate")))


#: Segments of the trading day, first and last minute.
SEGMENTS = (("open drive", 570, 599), ("morning", 600, 689), ("midday", 690, 809), ("afternoon", 810, 899), ("power hour", 900, 959))


def session_buckets(bars: DataFrame, minutes: int = 30, opens: int = 570, closes: int = 960) -> DataFrame:
    """Return statistics and volume by half hour of the session."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    rows = with_returns(bars).withColumn("minute", minute).where(F.col("minute").between(opens, closes - 1) & F.col("ret").isNotNull())
    return rows.groupBy("symbol", (F.floor((F.col("minute") - opens) / minutes) * minutes + opens).alias("bucket")).agg(*stats(), F.avg(F.abs("ret")).alias("mean_abs"), F.avg("volume").alias("avg_volume"))


def session_segments(bars: DataFrame) -> DataFrame:
    """Mean return from first open to last close of each named segment, its share of days that end up, and the mean range."""
    minute, day = F.hour("ts") * 60 + F.minute("ts"), F.date_trunc("day", "ts")
    name = F.coalesce(*(F.when(minute.between(a, b), n) for n, a, b in SEGMENTS))
    days = bars.withColumns({"segment": name, "day": day}).where("segment is not null").groupBy("symbol", "day", "segment").agg((ratio(F.max_by("close", "ts"), F.min_by("open", "ts")) - 1).alias("ret"), ratio(F.max("high") - F.min("low"), F.min_by("open", "ts")).alias("span"))
    return days.groupBy("symbol", "segment").agg(*stats(), F.avg("span").alias("avg_range"))


def open_drive(bars: DataFrame, opens: int = 570, split: int = 600, closes: int = 960) -> DataFrame:
    """Correlation of a day's first half hour with the rest of its session, and how often both have one sign."""
    minute, day = F.hour("ts") * 60 + F.minute("ts"), F.date_trunc("day", "ts")
    early = minute < split
    take = lambda fn, x, on: fn(F.when(on, F.col(x)), F.when(on, F.col("ts")))
    days = bars.withColumn("day", day).where(minute.between(opens, closes - 1)).groupBy("symbol", "day").agg(
        (ratio(take(F.max_by, "close", early), take(F.min_by, "open", early)) - 1).alias("drive"), (ratio(take(F.max_by, "close", ~early), take(F.min_by, "open", ~early)) - 1).alias("rest")
    )
    days = days.where("drive is not null and rest is not null")
    return days.groupBy("symbol").agg(F.count("*").alias("days"), ratio(F.covar_pop("drive", "rest"), F.stddev_pop("drive") * F.stddev_pop("rest")).alias("corr"), F.avg((F.signum("drive") == F.signum("rest")).cast("double")).alias("same_sign"))


def screen_signals(daily: DataFrame) -> DataFrame:
    """Eight long-or-flat rules side by side, with the return that follows each bar."""
    rows = ewm(with_returns(daily), [("atr", "range", 2 / 15, 1, "first")])
    w, month = by_time(), Window.partitionBy("symbol", F.year("ts"), F.month("ts"))
    edges = rows.groupBy("symbol").agg(F.percentile("atr", [0.33, 0.67]).alias("_edges"))
    rows = rows.join(edges, "symbol").withColumns({
        "_off": F.row_number().over(month.orderBy("ts")) - F.count("*").over(month), "_g5": ratio(F.col("close"), F.lag("close", 5).over(w)) - 1, "_g3": ratio(F.col("close"), F.lag("close", 3).over(w)) - 1,
        "_nr": (F.col("range") == roll("range", F.min, 7)) & (F.col("close") >= F.col("open")), "fwd": F.lead("ret").over(w),
    })
    on = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    lo, hi = F.col("_edges")[0], F.col("_edges")[1]
    rules = {
        "always_long": F.lit(1), "eom_momentum": on(F.col("_off").isin(-2, -1, 1)), "dow_filter": on(F.weekday("ts").isin(1, 2, 3)), "momentum_5d": on(F.col("_g5") > 0), "momentum_3d": on(F.col("_g3") > 0),
        "low_vol": on(F.col("atr") <= lo), "mid_vol": on((F.col("atr") > lo) & (F.col("atr") <= hi)), "nr7_up": on(F.lag("_nr").over(w)),
    }
    return rows.withColumns(rules).select("symbol", "ts", "fwd", *rules)


RULES = ("always_long", "eom_momentum", "dow_filter", "momentum_5d", "momentum_3d", "low_vol", "mid_vol", "nr7_up")


def held_returns(signals: DataFrame) -> DataFrame:
    """``symbol, signal, ts, fwd`` of the bars on which each rule is long and a return follows."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("on")) for n in RULES)))
    return signals.select("symbol", "ts", "fwd", each.alias("e")).where("e.on = 1 and fwd is not null").select("symbol", F.col("e.signal").alias("signal"), "ts", "fwd")


def screen(daily: DataFrame, train_end: str, test_start: str, pass_sharpe: float = 0.3, max_decay: float = 50.0, least: int = 20) -> DataFrame:
    """In-sample and out-of-sample statistics of each rule, the decay of its Sharpe ratio, whether it passes, and its rank."""
    rows = held_returns(screen_signals(daily)).withColumn("split", F.when(F.to_date("ts") <= train_end, "is").when(F.to_date("ts") >= test_start, "oos")).where("split is not null")
    w = Window.partitionBy("symbol", "signal", "split").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum(F.log1p("fwd")).over(w)).withColumn("_d", F.exp(F.col("_c") - F.max("_c").over(w)) - 1)
    gain, loss = F.sum(F.when(F.col("fwd") > 0, F.col("fwd"))), -F.sum(F.when(F.col("fwd") < 0, F.col("fwd")))
    sums = rows.groupBy("symbol", "signal", "split").agg(*stats("fwd"), ratio(gain, loss).alias("profit_factor"), F.min("_d").alias("max_drawdown")).where((F.col("n") >= least) & F.col("sharpe").isNotNull())
    a, b = (sums.where(F.col("split") == k).select("symbol", "signal", *(F.col(x).alias(f"{k}_{x}") for x in ("n", "sharpe", "win_rate", "profit_factor", "max_drawdown"))) for k in ("is", "oos"))
    both = a.join(b, ["symbol", "signal"]).withColumn("decay_pct", ratio(F.col("is_sharpe") - F.col("oos_sharpe"), F.abs("is_sharpe")) * 100)
    both = both.withColumn("passes", (F.col("oos_sharpe") >= pass_sharpe) & F.coalesce(F.col("decay_pct") <= max_decay, F.lit(True)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("oos_sharpe"), "signal")))


def blend(daily: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Sharpe ratio, worst drawdown and log of the end value of each rule held through (flat days count as 0), and of their equal-weight blend."""
    rows = screen_signals(daily).where("fwd is not null")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), (F.col(n) * F.col("fwd")).alias("x")) for n in rules), F.struct(F.lit("blend").alias("signal"), (sum((F.col(n) for n in rules), F.lit(0)) * F.col("fwd") / len(rules)).alias("x"))))
    rows = rows.select("symbol", "ts", each.alias("e")).select("symbol", "ts", "e.*")
    w = Window.partitionBy("symbol", "signal").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum(F.log1p("x")).over(w)).withColumn("_d", F.exp(F.col("_c") - F.max("_c").over(w)) - 1)
    return rows.groupBy("symbol", "signal").agg(F.count("*").alias("days"), (ratio(F.avg("x"), F.stddev_samp("x")) * F.lit(252.0**0.5)).alias("sharpe"), F.min("_d").alias("max_drawdown"), F.sum(F.log1p("x")).alias("log_value"))


def equity_curves(daily: DataFrame) -> DataFrame:
    """Running product of each rule's returns, as its logarithm."""
    rows = screen_signals(daily).where("fwd is not null")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), (F.col(n) * F.col("fwd")).alias("x")) for n in RULES)))
    w = Window.partitionBy("symbol", "signal").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("symbol", "ts", each.alias("e")).select("symbol", "ts", "e.*").select("symbol", "signal", "ts", F.sum(F.log1p("x")).over(w).alias("log_value"))


def runs_p_value(runs: DataFrame) -> DataFrame:
    """``p`` and ``label`` beside the z of ``runs_test``: two-sided, from a rational form of the normal tail, good to 1.5e-7."""
    x = F.abs("z") / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    label = F.when(F.col("p") >= 0.05, "random").when(F.col("z") < 0, "trending").otherwise("reverting")
    return runs.withColumn("p", tail).withColumn("label", label)
