"""Rule strategies: ``signal`` of 1, -1 or 0 for each bar.

Entries are held until the next one.  With ``exit_mode='row'`` an exit row is flat for that row
only; with ``'hold'`` it stays flat until the next entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scan import scan_state
from lodestar.functions.windows import by_time, ffill, lag, last_n, ratio, roll, so_far
from lodestar.operators import indicators as ta
from lodestar.operators.resample import asof

c = F.col


def held(df: DataFrame, long: Column, short: Column, leave: Column | None = None, exit_mode: str = "row") -> DataFrame:
    """``signal`` from entry conditions and an exit condition, which may use the column ``side`` held so far."""
    entry = F.when(F.coalesce(short, F.lit(False)), -1).when(F.coalesce(long, F.lit(False)), 1)
    df = df.withColumn("_entry", entry)
    df = df.withColumn("side", F.coalesce(ffill("_entry"), F.lit(0)))
    if leave is None:
        return df.withColumn("signal", c("side")).drop("_entry", "side")
    out = (c("side") != 0) & F.coalesce(leave, F.lit(False))
    if exit_mode == "row":
        return df.withColumn("signal", F.when(out, 0).otherwise(c("side"))).drop("_entry", "side")
    df = df.withColumn("_entry", F.when(out, 0).otherwise(c("_entry")))
    return df.withColumn("signal", F.coalesce(ffill("_entry"), F.lit(0))).drop("_entry", "side")


def _crossed(x: Column, before: Column, level: Column | float = 0.0) -> Column:
    return ((before < level) & (x >= level)) | ((before > level) & (x <= level))


def ema_cross(df: DataFrame, fast: int = 10, slow: int = 50) -> DataFrame:
    df = ta.ewm(df, [("_f", "close", 2 / (fast + 1), fast, "sma"), ("_s", "close", 2 / (slow + 1), slow, "sma")])
    return held(df, c("_f") > c("_s"), c("_f") < c("_s")).drop("_f", "_s")


def macd_trend(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, exit_mode: str = "row") -> DataFrame:
    tag = f"{fast}_{slow}_{signal}"
    df = ta.macd(df, fast, slow, signal)
    return macd_trend_sides(df.withColumnsRenamed({f"MACD_{tag}": "_m", f"MACDs_{tag}": "_g"}), exit_mode).drop(f"MACDh_{tag}")


def macd_trend_sides(df: DataFrame, exit_mode: str) -> DataFrame:
    """From the line ``_m`` and its signal ``_g``."""
    m, s = c("_m"), c("_g")
    df = df.withColumns({"_m1": lag(m), "_s1": lag(s)})
    up = (m > 0) & (m > s) & (c("_m1") <= c("_s1"))
    down = (m < 0) & (m < s) & (c("_m1") >= c("_s1"))
    return held(df, up, down, m * c("_m1") < 0, exit_mode).drop("_m1", "_s1", "_m", "_g")


def bollinger_reversion(df: DataFrame, length: int = 20, std: float = 2.0, exit_mode: str = "row") -> DataFrame:
    df = df.withColumns({"_m": roll("close", F.avg, length), "_d": roll("close", F.stddev_pop, length)})
    df = df.withColumn("_x", c("close") - c("_m")).withColumn("_x1", lag("_x"))
    return held(df, c("_x") < -std * c("_d"), c("_x") > std * c("_d"), (c("_x") * c("_x1") < 0) | (c("_x") == 0), exit_mode).drop("_m", "_d", "_x", "_x1")


def rsi_reversal(df: DataFrame, length: int = 14, lower: float = 30.0, upper: float = 70.0, middle: float = 50.0, exit_mode: str = "row") -> DataFrame:
    return rsi_sides(ta.rsi(df, length).withColumnRenamed(f"RSI_{length}", "_x"), lower, upper, middle, exit_mode)


def rsi_sides(df: DataFrame, lower: Column | float, upper: Column | float, middle: Column | float, exit_mode: str) -> DataFrame:
    """From the relative strength ``_x``."""
    x = c("_x")
    df = df.withColumn("_x1", lag(x))
    return held(df, x < lower, x > upper, _crossed(x, c("_x1"), middle), exit_mode).drop("_x1", "_x")


def zscore_arb(df: DataFrame, length: int = 20, threshold: float = 2.0, exit_mode: str = "row") -> DataFrame:
    df = df.withColumn("_z", ratio(c("close") - roll("close", F.avg, length), roll("close", F.stddev_samp, length))).withColumn("_z1", lag("_z"))
    return held(df, c("_z") < -threshold, c("_z") > threshold, _crossed(c("_z"), c("_z1")), exit_mode).drop("_z", "_z1")


def washer(df: DataFrame, lookback: int = 4, window: int = 24, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """Against extreme returns of ``lookback`` bars; flat once they are near their mean."""
    df = df.withColumn("_r", ratio(c("close"), lag("close", lookback)) - 1)
    z = ratio(c("_r") - roll("_r", F.avg, window), roll("_r", F.stddev_samp, window))
    df = df.withColumn("_z", z).withColumn("_e", F.when(F.abs("_z") < leave, 0).when(c("_z") > enter, -1).when(c("_z") < -enter, 1))
    return df.withColumn("signal", F.coalesce(ffill("_e"), F.lit(0))).drop("_r", "_z", "_e")


def _channel(col: str, fn: Callable[[Column], Column], n: int) -> Column:
    frame = by_time().rowsBetween(-n, -1)
    return F.when(F.count(col).over(frame) == n, fn(col).over(frame))


def turtle(df: DataFrame, entry: int = 20, leave: int = 10, exit_mode: str = "row") -> DataFrame:
    df = df.withColumns({"_h": _channel("high", F.max, entry), "_l": _channel("low", F.min, entry), "_xh": _channel("high", F.max, leave), "_xl": _channel("low", F.min, leave)})
    out = F.when(c("side") == 1, c("close") < c("_xl")).otherwise(c("close") > c("_xh"))
    return held(df, c("close") > c("_h"), c("close") < c("_l"), out, exit_mode).drop("_h", "_l", "_xh", "_xl")


def channel_breakout(df: DataFrame, long_entry: int = 20, long_exit: int = 10, short_entry: int = 20, short_exit: int = 10, exit_mode: str = "row") -> DataFrame:
    df = df.withColumns({"_h": _channel("high", F.max, long_entry), "_l": _channel("low", F.min, short_entry), "_xh": _channel("high", F.max, short_exit), "_xl": _channel("low", F.min, long_exit)})
    out = F.when(c("side") == 1, c("low") <= c("_xl")).otherwise(c("high") >= c("_xh"))
    return held(df, c("high") >= c("_h"), c("low") <= c("_l"), out, exit_mode).drop("_h", "_l", "_xh", "_xl")


def narrow_breakout(df: DataFrame, window: int = 7) -> DataFrame:
    """Close crossing the range of the latest narrowest bar."""
    df = df.withColumn("_r", c("high") - c("low")).withColumn("_on", c("_r") == roll("_r", F.min, window))
    df = df.withColumns({"_h": ffill(F.when(c("_on"), c("high"))), "_l": ffill(F.when(c("_on"), c("low")))})
    df = df.withColumns({"_h1": lag("_h"), "_l1": lag("_l"), "_c1": lag("close")})
    return held(df, (c("close") > c("_h")) & (c("_c1") <= c("_h1")), (c("close") < c("_l")) & (c("_c1") >= c("_l1"))).drop("_r", "_on", "_h", "_l", "_h1", "_l1", "_c1")


def swing_reversal(df: DataFrame, trend: int = 3, exit_mode: str = "row") -> DataFrame:
    """A local extreme two bars ago after a trend into it, confirmed by the price level."""
    for k in range(1, 3 + trend):
        df = df.withColumns({f"_h{k}": lag("high", k), f"_l{k}": lag("low", k)})
    df = df.withColumn("_c2", lag("close", 2))
    h, lo = (lambda k: c(f"_h{k}") if k else c("high")), (lambda k: c(f"_l{k}") if k else c("low"))
    peak = (h(2) > h(3)) & (h(2) > h(4)) & (h(2) > h(1)) & (h(2) > h(0))
    trough = (lo(2) < lo(3)) & (lo(2) < lo(4)) & (lo(2) < lo(1)) & (lo(2) < lo(0))
    for k in range(2, 2 + trend):
        peak, trough = peak & (h(k) > h(k + 1)), trough & (lo(k) < lo(k + 1))
    buy, sell = F.least("open", "close"), F.greatest("open", "close")
    out = F.when(c("side") == 1, c("close") < buy).otherwise(c("close") > sell)
    df = held(df, trough & (c("_c2") > buy), peak & (c("_c2") < sell), out, exit_mode)
    return df.drop("_c2", *(f"_{x}{k}" for k in range(1, 3 + trend) for x in "hl"))


def supertrend_direction(df: DataFrame, length: int = 10, multiplier: float = 3.0) -> DataFrame:
    df = ta.supertrend(df, length, multiplier)
    return df.withColumn("signal", F.coalesce(c(f"SUPERTd_{length}"), F.lit(0)).cast("int")).drop(f"SUPERT_{length}", f"SUPERTd_{length}")


def pairs_trading(df: DataFrame, y: str, x: str, window: int = 60, enter: float = 2.0, leave: float = 0.0) -> DataFrame:
    """Mirrored signals of two symbols from the z-score of their log-price spread with a rolling beta."""
    a = df.where(c("symbol") == y).select("ts", F.ln("close").alias("ly"))
    b = df.where(c("symbol") == x).select("ts", F.ln("close").alias("lx"))
    both = a.join(b, "ts").withColumn("symbol", F.lit(f"{y}/{x}"))
    frame = last_n(window)
    full = F.count("ly").over(frame) == window
    both = both.withColumn("beta", F.when(full, ratio(F.covar_samp("ly", "lx").over(frame), F.var_samp("lx").over(frame))))
    both = both.withColumn("_s", c("ly") - c("beta") * c("lx"))
    both = both.withColumn("z", ratio(c("_s") - roll("_s", F.avg, window), roll("_s", F.stddev_samp, window)))
    both = both.withColumn("_e", F.when(F.abs("z") < leave, 0).when(c("z") > enter, -1).when(c("z") < -enter, 1))
    both = both.withColumn("_g", F.coalesce(ffill("_e"), F.lit(0)))
    legs = F.explode(F.array(F.struct(F.lit(y).alias("symbol"), c("_g").alias("signal")), F.struct(F.lit(x).alias("symbol"), (-c("_g")).alias("signal"))))
    return both.select("ts", "beta", "z", legs.alias("leg")).select("leg.symbol", "ts", "beta", "z", "leg.signal")


def regime_follower(df: DataFrame, index: str, top: int = 3, hold: int = 5) -> DataFrame:
    """After a rising index bar long the symbols of the highest rank by the bar before, after a falling one short the lowest."""
    idx = df.where(c("symbol") == index).withColumn("_green", lag(F.when(c("close") > c("open"), 1).when(c("close") < c("open"), -1).otherwise(0))).select("ts", "_green")
    rest = df.where(c("symbol") != index).withColumn("_r", ratio(c("close"), lag("close")) - 1).withColumn("_r1", lag("_r"))
    across = Window.partitionBy("ts")
    rest = rest.withColumns({"_best": F.row_number().over(across.orderBy(F.desc_nulls_last("_r1"), "symbol")), "_worst": F.row_number().over(across.orderBy(F.asc_nulls_last("_r1"), "symbol"))}).join(F.broadcast(idx), "ts", "left")
    entry = F.when(c("_r1").isNull(), None).when((c("_green") == 1) & (c("_best") <= top), 1).when((c("_green") == -1) & (c("_worst") <= top), -1)
    rest = rest.withColumn("_e", entry).withColumn("_i", F.row_number().over(by_time()))
    last = ffill(F.when(c("_e").isNotNull(), F.struct("_i", "_e")))
    rest = rest.withColumn("_last", last)
    return rest.withColumn("signal", F.coalesce(F.when(c("_i") - c("_last._i") < hold, c("_last._e")), F.lit(0))).drop("_green", "_r", "_r1", "_best", "_worst", "_e", "_i", "_last")


def macd_reversal(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, middle: float = 0.0, exit_mode: str = "row") -> DataFrame:
    """With the line over or under its signal; flat where the line crosses the middle."""
    tag = f"{fast}_{slow}_{signal}"
    df = ta.macd(df, fast, slow, signal).withColumnsRenamed({f"MACD_{tag}": "_m", f"MACDs_{tag}": "_g"})
    return macd_reversal_sides(df, middle, exit_mode).drop(f"MACDh_{tag}")


def macd_reversal_sides(df: DataFrame, middle: Column | float, exit_mode: str) -> DataFrame:
    m, s = c("_m"), c("_g")
    df = df.withColumn("_m1", lag(m))
    return held(df, m > s, m < s, _crossed(m, c("_m1"), middle), exit_mode).drop("_m1", "_m", "_g")


def grid_trading(df: DataFrame, count: int = 10, upper: float = 1.1, lower: float = 0.9, reverse: bool = False) -> DataFrame:
    """Side of the last crossing of any of ``count`` levels around the first close; ``reverse`` trades against it.

    Levels are evenly spaced, so a crossing is a change of the number of levels below or at the price.
    """
    place = (c("close") / F.first("close").over(so_far()) - lower) / ((upper - lower) / (count - 1))
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(count), x))
    df = df.withColumns({"_k": clip(F.floor(place) + 1), "_m": clip(F.ceil(place))})
    df = df.withColumns({"_up": c("_k") > lag("_k"), "_down": c("_m") < lag("_m")})
    long, short = (c("_down"), c("_up")) if reverse else (c("_up"), c("_down"))
    return held(df, long, short).drop("_k", "_m", "_up", "_down")


def grid_reversal(df: DataFrame, count: int = 10, upper: float = 1.1, lower: float = 0.9) -> DataFrame:
    return grid_trading(df, count, upper, lower, reverse=True)


def _trend_share(df: DataFrame, lookback: int, threshold: float, history: int, length: int) -> DataFrame:
    """``_ups``: bars of the last ``history`` in an up state, which holds until the move over ``lookback`` bars passes the threshold, in mean true ranges, the other way."""
    df = ta.atr(df, length)
    df = trend_state(df.withColumn("_z", ratio(c("close") - lag("close", lookback), c(f"ATRr_{length}"))), threshold)
    return df.withColumn("_ups", roll((c("_s") == 1).cast("int"), F.sum, history)).drop("_z", "_s", f"ATRr_{length}", f"NATR_{length}")


def trend_state(df: DataFrame, threshold: Column | float) -> DataFrame:
    """``_s``: 1 or -1 by the last scaled move ``_z`` beyond the threshold."""
    return df.withColumn("_s", F.coalesce(ffill(F.when(c("_z") > threshold, 1).when(c("_z") < -threshold, -1)), F.lit(1)))


def markov_trend(df: DataFrame, lookback: int = 14, threshold: float = 0.5, history: int = 33, length: int = 14) -> DataFrame:
    """With the state that most of the last bars were in."""
    return markov_trend_sides(_trend_share(df, lookback, threshold, history, length), F.lit(history))


def markov_trend_sides(df: DataFrame, history: Column) -> DataFrame:
    return held(df, 2 * c("_ups") > history, 2 * c("_ups") < history).drop("_ups")


def markov_cross(df: DataFrame, lookback: int = 14, threshold: float = 0.5, history: int = 33, length: int = 14, longs: bool = True, shorts: bool = True) -> DataFrame:
    """As ``markov_trend``, entering only where the majority changes."""
    return markov_cross_sides(_trend_share(df, lookback, threshold, history, length), F.lit(history), F.lit(longs), F.lit(shorts))


def markov_cross_sides(df: DataFrame, history: Column, longs: Column, shorts: Column) -> DataFrame:
    df = df.withColumn("_u1", lag("_ups"))
    up = (2 * c("_ups") > history) & (2 * c("_u1") <= history) & longs
    down = (2 * c("_ups") < history) & (2 * c("_u1") >= history) & shorts
    return held(df, up, down).drop("_ups", "_u1")


def double_markov(df: DataFrame, lookback_ev: int = 90, lookback: int = 14, threshold: float = 0.5, history: int = 33, length: int = 14, smooth: int = 20) -> DataFrame:
    """The majority state, where the expected move of a bar, from counts and sums of ups and downs, agrees."""
    df = _trend_share(df, lookback, threshold, history, length).withColumn("_d", F.coalesce(c("close") - lag("close"), F.lit(0.0)))
    flag = lambda x: x.cast("double")
    df = df.withColumns({"_nu": roll(flag(c("_d") > 0), F.sum, lookback_ev), "_nd": roll(flag(c("_d") < 0), F.sum, lookback_ev), "_su": roll(F.greatest(F.lit(0.0), c("_d")), F.sum, lookback_ev), "_sd": roll(F.greatest(F.lit(0.0), -c("_d")), F.sum, lookback_ev)})
    wu, wd = c("_nu") * c("_su"), c("_nd") * c("_sd")
    ev = ratio(wu, wu + wd) * ratio(c("_su"), c("_nu")) - ratio(wd, wu + wd) * ratio(c("_sd"), c("_nd"))
    df = df.withColumn("_ev", ev).withColumn("_e", roll("_ev", F.avg, smooth))
    return held(df, (2 * c("_ups") > history) & (c("_e") > 0), (2 * c("_ups") < history) & (c("_e") < 0)).drop("_ups", "_d", "_nu", "_nd", "_su", "_sd", "_ev", "_e")


def tdi_time_exit(df: DataFrame, rsi_length: int = 21, fast: int = 2, slow: int = 7, flat: float = 0.9, bands: int = 10, std: float = 1.5, length: int = 20, bars: int = 10) -> DataFrame:
    """Means of the relative strength index with widening bands or ranges; flat ``bars`` bars after the entry began."""
    df = ta.atr(ta.rsi(df, rsi_length), length)
    df = df.withColumns({"_f": roll(f"RSI_{rsi_length}", F.avg, fast), "_s": roll(f"RSI_{rsi_length}", F.avg, slow), "_w": 2 * std * roll("close", F.stddev_pop, bands)})
    df = df.withColumns({"_f1": lag("_f"), "_s1": lag("_s"), "_wide": c("_w") > lag("_w"), "_rise": c(f"ATRr_{length}") > lag(f"ATRr_{length}")})
    crossed = (((c("_s1") < c("_f1")) & (c("_s") >= c("_f"))) | ((c("_s1") > c("_f1")) & (c("_s") <= c("_f")))) & (F.abs(c("_f") - c("_f1")) > flat)
    wide, rise = F.coalesce("_wide", F.lit(False)), F.coalesce("_rise", F.lit(False))
    go = (rise & wide) | (F.coalesce(crossed, F.lit(False)) & (rise | wide))
    df = df.withColumn("_e", F.when(go & (c("_f") < c("_s")), -1).when(go & (c("_f") > c("_s")), 1))
    fresh = c("_e").isNotNull() & ~c("_e").eqNullSafe(lag("_e"))
    df = df.withColumn("_fresh", fresh.cast("int")).withColumns({"_id": F.sum("_fresh").over(so_far()), "side": F.coalesce(ffill("_e"), F.lit(0))})
    age = F.row_number().over(Window.partitionBy("symbol", "_id").orderBy("ts")) - 1
    return df.withColumn("signal", F.when(age >= bars, 0).otherwise(c("side"))).drop("_f", "_s", "_w", "_f1", "_s1", "_wide", "_rise", "_e", "_fresh", "_id", "side", f"RSI_{rsi_length}", f"ATRr_{length}", f"NATR_{length}")


def rebalancing_premium(df: DataFrame, length: int = 20, std: float = 2.0, trend: bool = False) -> DataFrame:
    """Against closes outside the bands (``trend``: with the side of the mean), flat from the crossing of the mean on."""
    df = df.withColumns({"_m": roll("close", F.avg, length), "_d": roll("close", F.stddev_pop, length)})
    df = df.withColumns({"_x": c("close") - c("_m")}).withColumn("_x1", lag("_x"))
    long, short = (c("_x") > 0, c("_x") < 0) if trend else (c("_x") < -std * c("_d"), c("_x") > std * c("_d"))
    return df.withColumn("signal", ta.hold(F.when(_crossed(c("_x"), c("_x1")), 0).when(short, -1).when(long, 1))).drop("_m", "_d", "_x", "_x1")


def bouncy_ball(df: DataFrame, slow: int = 200, fast: int = 20, length: int = 14, oversold: float = 30.0, zone: float = 0.005, exit_mode: str = "row") -> DataFrame:
    """Long on a rising bar just over the slow mean while oversold; out at the fast mean."""
    df = ta.rsi(ta.ewm(df, [("_s", "close", 2 / (slow + 1), slow, "sma"), ("_f", "close", 2 / (fast + 1), fast, "sma")]), length)
    return bouncy_sides(df.withColumnRenamed(f"RSI_{length}", "_x"), oversold, zone, exit_mode)


def bouncy_sides(df: DataFrame, oversold: Column | float, zone: Column | float, exit_mode: str) -> DataFrame:
    """From the slow mean ``_s``, the fast one ``_f`` and the relative strength ``_x``."""
    off = ratio(c("close") - c("_s"), c("_s"))
    long = (off >= 0) & (off <= zone) & (c("_x") < oversold) & (c("close") > c("open"))
    return held(df, long, F.lit(False), (c("side") == 1) & (c("close") >= c("_f")), exit_mode).drop("_s", "_f", "_x")


def ichimoku_cloud(df: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52, displacement: int = 26, lookahead: bool = False) -> DataFrame:
    """Beyond the cloud with the lagging span beyond its own; flat inside.

    The lagging span of a bar is a later close.  By default the bar's own close is compared with the
    cloud of ``displacement`` bars before; ``lookahead`` takes the later one.
    """
    df = ta.ichimoku(df, tenkan, kijun, senkou)
    a, b = c(f"ISA_{tenkan}"), c(f"ISB_{kijun}")
    df = df.withColumns({"_a": lag(a, displacement), "_b": lag(b, displacement), "_late": F.lead("close", kijun - 1).over(by_time()) if lookahead else c("close")})
    both = c("_a").isNotNull() & c("_b").isNotNull()
    df = df.withColumns({"_top": F.when(both, F.greatest("_a", "_b")), "_low": F.when(both, F.least("_a", "_b"))}).withColumns({"_top1": lag("_top", displacement), "_low1": lag("_low", displacement)})
    long = (c("close") > c("_top")) & (c("_late") > c("_top1")) & (a > b)
    short = (c("close") < c("_low")) & (c("_late") < c("_low1")) & (a < b)
    inside = (c("close") <= c("_top")) & (c("close") >= c("_low"))
    return df.withColumn("signal", ta.hold(F.when(inside, 0).when(short, -1).when(long, 1))).drop("_a", "_b", "_late", "_top", "_low", "_top1", "_low1", f"ITS_{tenkan}", f"IKS_{kijun}", f"ISA_{tenkan}", f"ISB_{kijun}")


def daily_range_breakout(df: DataFrame, hold_days: int = 5, reverse: bool = False) -> DataFrame:
    """Close crossing the range of the calendar day before (or the last one known); flat ``hold_days`` days after the entry."""
    day = F.date_trunc("day", "ts")
    ranges = df.groupBy("symbol", day.alias("_day")).agg(F.max("high").alias("_h"), F.min("low").alias("_l")).withColumn("_day", F.date_trunc("day", F.date_add("_day", 1)))
    df = df.withColumn("_day", day).join(ranges, ["symbol", "_day"], "left").drop("_day")
    df = df.withColumns({"_h": ffill("_h"), "_l": ffill("_l")}).withColumns({"_h1": lag("_h"), "_l1": lag("_l"), "_c1": lag("close")})
    up, down = (c("close") > c("_h")) & (c("_c1") <= c("_h1")), (c("close") < c("_l")) & (c("_c1") >= c("_l1"))
    sign = -1 if reverse else 1
    df = df.withColumn("side", F.coalesce(ffill(F.when(down, -sign).when(up, sign)), F.lit(0)))
    begun = ffill(F.when((c("side") != 0) & ~c("side").eqNullSafe(lag("side")), c("ts")))
    age = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("_t")) / 86400)
    return df.withColumn("_t", begun).withColumn("signal", F.when(age >= hold_days, 0).otherwise(c("side"))).drop("_h", "_l", "_h1", "_l1", "_c1", "side", "_t")


def squeeze_breakout(df: DataFrame, length: int = 20, bands: float = 2.0, channel: float = 1.5, follow: bool = False, exit_mode: str = "row") -> DataFrame:
    """Closes outside the bands while these lie inside the mean-range channel: against the break, or with it; out where the close comes back over the mean."""
    df = ta.true_range(df, "_tr")
    df = ta.ewm(df, [("_k", "close", 2 / (length + 1), length, "sma"), ("_w", "_tr", 2 / (length + 1), length, "sma")])
    df = df.withColumns({"_m": roll("close", F.avg, length), "_d": roll("close", F.stddev_pop, length)})
    return squeeze_sides(df, F.lit(bands), F.lit(channel), F.lit(follow), exit_mode).drop("_tr")


def squeeze_sides(df: DataFrame, bands: Column, channel: Column, follow: Column, exit_mode: str) -> DataFrame:
    """From the mean ``_m`` and deviation ``_d`` of the closes, and the middle ``_k`` and width ``_w`` of the channel."""
    df = df.withColumn("_x", c("close") - c("_m")).withColumn("_x1", lag("_x"))
    squeezed = (c("_m") + bands * c("_d") <= c("_k") + channel * c("_w")) & (c("_m") - bands * c("_d") >= c("_k") - channel * c("_w"))
    up, down = squeezed & (c("_x") > bands * c("_d")), squeezed & (c("_x") < -bands * c("_d"))
    long, short = (follow & up) | (~follow & down), (follow & down) | (~follow & up)
    out = ((c("side") == 1) & (c("_x1") > 0) & (c("_x") <= 0)) | ((c("side") == -1) & (c("_x1") < 0) & (c("_x") >= 0))
    return held(df, long, short, out, exit_mode).drop("_k", "_w", "_m", "_d", "_x", "_x1")


def tdi_heikin_ashi(df: DataFrame, length: int = 5, shift: int = 2, rsi_length: int = 13, green: int = 2, red: int = 7, strong: float = 1.0, flat: float = 0.2, exit_mode: str = "row") -> DataFrame:
    """Averaged candles wholly on one side of their mean, a change of their colour, and a steep crossing of two means of the relative strength index."""
    df = ta.rsi(df, rsi_length).withColumns({"_hc": (c("open") + c("high") + c("low") + c("close")) / 4, "_ho": (c("open") + c("close")) / 2})
    df = ta.ewm(df, [("_e", "_hc", 2 / (length + 1), length, "sma"), ("_g", f"RSI_{rsi_length}", 2 / (green + 1), green, "sma")])
    df = ta.ewm(df, [("_r", "_g", 2 / (red + 1), red, "sma")])
    high, low = F.greatest("high", "_ho", "_hc"), F.least("low", "_ho", "_hc")
    df = df.withColumns({"_o": lag("_e", shift), "_bull": c("_hc") > c("_ho"), "_bear": c("_hc") < c("_ho")})
    df = df.withColumns({"_above": c("_o").isNotNull() & (low >= c("_o")), "_below": c("_o").isNotNull() & (high <= c("_o")), **{f"_g{k}": lag("_g", k) for k in (1, 2)}, **{f"_r{k}": lag("_r", k) for k in (1, 2)}, "_up": lag("_bull") & lag("_bear", 2), "_dn": lag("_bear") & lag("_bull", 2)})
    over, under = (c("_g2") < c("_r2")) & (c("_g1") >= c("_r1")), (c("_g2") > c("_r2")) & (c("_g1") <= c("_r1"))
    df = df.withColumns({"_over": F.coalesce(over, F.lit(False)), "_under": F.coalesce(under, F.lit(False)), "_slope": c("_g1") - c("_g2")})
    df = df.withColumns({"_over1": F.coalesce(lag("_over"), F.lit(False)), "_under1": F.coalesce(lag("_under"), F.lit(False))})
    long = (c("_over") | c("_over1")) & (c("_slope") >= strong) & c("_up") & c("_above")
    short = (c("_under") | c("_under1")) & (c("_slope") <= -strong) & c("_dn") & c("_below")
    still = F.coalesce(F.abs("_slope") <= flat, F.lit(False))
    out = F.when(c("side") == 1, still | F.coalesce(c("_slope") <= -strong, F.lit(False)) | c("_under")).otherwise(still | F.coalesce(c("_slope") >= strong, F.lit(False)) | c("_over"))
    return held(df, long, short, out, exit_mode).drop("_hc", "_ho", "_e", "_g", "_r", "_o", "_bull", "_bear", "_above", "_below", "_g1", "_g2", "_r1", "_r2", "_up", "_dn", "_over", "_under", "_slope", "_over1", "_under1", f"RSI_{rsi_length}")


def chandelier_direction(df: DataFrame, length: int = 22, multiplier: float = 3.0) -> DataFrame:
    """``dir``: 1 or -1 by two stops under the highest and over the lowest close, which tighten while the close before is beyond them: a carried state."""
    name = f"ATRr_{length}"
    df = ta.atr(df, length)
    df = df.withColumns({"_ls": F.coalesce(roll("close", F.max, length) - multiplier * c(name), F.lit(0.0)), "_ss": F.coalesce(roll("close", F.min, length) + multiplier * c(name), F.lit(0.0))})

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        close, long_stop, short_stop = row
        if state is None:
            return (close, long_stop, short_stop, 1), (0,)
        before, long1, short1, side = state
        if before > long1:
            long_stop = max(long_stop, long1)
        if before < short1:
            short_stop = min(short_stop, short1)
        side = 1 if close > short1 else -1 if close < long1 else side
        return (close, long_stop, short_stop, side), (side,)

    made = T.StructType([T.StructField("dir", T.LongType())])
    return scan_state(df, lambda: None, step, ["close", "_ls", "_ss"], made).drop("_ls", "_ss")


def newsom(df: DataFrame, length: int = 22, multiplier: float = 3.0, bands: int = 20, std: float = 2.0, mean: int = 10, vol_mean: int = 20, exit_mode: str = "row") -> DataFrame:
    """With the chandelier direction after a bar against it, on the right side of the mean, while bands widen and ranges are above their mean."""
    df = chandelier_direction(df, length, multiplier)
    df = df.withColumn("_q", 100 * ratio(c(f"ATRr_{length}"), c("close")))
    df = ta.ewm(df, [("_e", "close", 2 / (mean + 1), mean, "sma"), ("_v", "_q", 2 / (vol_mean + 1), vol_mean, "sma")])
    df = df.withColumn("_w", 2 * std * roll("close", F.stddev_pop, bands))
    df = df.withColumns({"_wide": c("_w") > lag("_w"), "_fell": lag("close") < lag("open"), "_rose": lag("close") > lag("open"), "_d1": lag("dir")})
    mid = (c("open") + c("high") + c("low") + c("close")) / 4
    calm = c("_wide") & (c("_q") > c("_v"))
    long = (c("close") > c("_e")) & c("_fell") & (mid > c("_e")) & (c("dir") == 1) & calm
    short = (c("close") < c("_e")) & c("_rose") & (mid < c("_e")) & (c("dir") == -1) & calm
    return held(df, long, short, ~c("dir").eqNullSafe(c("_d1")), exit_mode).drop("_q", "_e", "_v", "_w", "_wide", "_fell", "_rose", "_d1", "dir", f"ATRr_{length}", f"NATR_{length}")


def news_breakout(df: DataFrame, hour: int = 8, minute: int = 30, take: float = 35.0, stop: float = 25.0, tick: float = 1.0, by_colour: bool = True, cancel_hours: int = 1) -> DataFrame:
    """Stop entries at the range of the bar at the hour, on its own day, with a target and a stop in ticks: a carried state.

    A bar that touches target and stop counts as closed; ``tick`` is the instrument's step.
    """

    def start() -> dict:
        return {"first": True, "high": None, "low": None, "green": None, "day": 0, "side": 0, "take": 0.0, "stop": 0.0}

    def step(s: dict, row: tuple) -> tuple[dict, tuple]:
        day, h, m, o, high, low, close = row
        if s["first"]:
            return {**s, "first": False}, (0,)
        s = dict(s)
        if day != s["day"]:
            s.update(high=None, low=None, green=None)
        if (h, m) == (hour, minute):
            s.update(high=high, low=low, green=close > o, day=day)
        elif s["side"]:
            up, down = (s["take"], s["stop"]) if s["side"] > 0 else (s["stop"], s["take"])
            if high >= up or low <= down:
                s["side"] = 0
        elif day == s["day"] and s["high"] is not None and h <= hour + cancel_hours:
            if (s["green"] or not by_colour) and high >= s["high"]:
                s.update(side=1, take=s["high"] + take * tick, stop=s["high"] - stop * tick)
            elif (not s["green"] or not by_colour) and low <= s["low"]:
                s.update(side=-1, take=s["low"] - take * tick, stop=s["low"] + stop * tick)
        return s, (s["side"],)

    made = T.StructType([T.StructField("signal", T.LongType())])
    df = df.withColumns({"_day": F.dayofmonth("ts"), "_h": F.hour("ts"), "_m": F.minute("ts")})
    return scan_state(df, start, step, ["_day", "_h", "_m", "open", "high", "low", "close"], made).drop("_day", "_h", "_m")


def slope_screen(df: DataFrame, week: int = 7, quarter: int = 90, last: int = 5) -> DataFrame:
    """The last bars of the symbols in which the week mean has turned with the quarter mean: ``symbol, ts, bull_entry, bear_entry``."""
    df = ta.ewm(df, [("_w", "close", 2 / (week + 1), week, "first"), ("_q", "close", 2 / (quarter + 1), quarter, "first")])
    df = df.withColumns({"_dw": c("_w") - lag("_w"), "_dq": c("_q") - lag("_q")}).withColumn("_dw1", lag("_dw"))
    bull = F.coalesce((c("_dw1") < 0) & (c("_dw") > 0) & (c("_dq") > 0), F.lit(False))
    bear = F.coalesce((c("_dw1") > 0) & (c("_dw") < 0) & (c("_dq") < 0), F.lit(False))
    df = df.select("symbol", "ts", bull.alias("bull_entry"), bear.alias("bear_entry"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("_i")).where(c("_i") <= last)
    return df.withColumn("_any", F.max(c("bull_entry") | c("bear_entry")).over(Window.partitionBy("symbol"))).where("_any").drop("_i", "_any")


def energy_states(df: DataFrame, velocity: int = 5) -> DataFrame:
    """``energy, state, force, breakout, reversion``: relative volume times squared velocity, votes of three entropies of returns, and the pull to the mean.

    Velocity is the exponential mean of the close's change.  Entropies are taken over the last 5, 7
    and 14 returns (the first is 0), by up and down patterns and by histograms of 5 and 10 bins.
    """
    df = df.withColumn("_d", c("close") - lag("close"))
    df = ta.ewm(df, [("_v", "_d", 2 / (velocity + 1), velocity, "sma")])
    df = df.withColumn("_r", F.coalesce(ratio(c("close"), lag("close")) - 1, F.lit(0.0)))
    df = df.withColumn("energy", 0.5 * ratio(c("volume"), roll("volume", F.avg, 20)) * c("_v") * c("_v"))
    df = df.withColumns({f"_x{n}": F.collect_list("_r").over(last_n(n)) for n in (5, 7, 14)})
    less = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    ups = F.size(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get("_x5", i) > F.get("_x5", i - 1))) / F.lit(4.0)

    def histogram(n: int, bins: int) -> Column:
        x = f"_x{n}"
        lo, hi = F.array_min(x), F.array_max(x)
        lo, width = F.when(hi > lo, lo).otherwise(lo - 0.5), F.when(hi > lo, hi - lo).otherwise(1.0)
        of = lambda v: F.least(F.lit(bins - 1), F.floor((v - lo) / width * bins))
        counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(x, lambda v: of(v) == b)))
        # densities over the number of bins, as published
        return F.aggregate(counts, F.lit(0.0), lambda s, k: s + less(k / (n * width / bins) / bins))

    votes = {"_e5": less(ups) + less(1 - ups) < 0.7, "_e7": histogram(7, 5) < 1.1, "_e14": histogram(14, 10) < 1.4}
    low = sum((F.when(F.size(f"_x{k[2:]}") == int(k[2:]), v.cast("int")).otherwise(0) for k, v in votes.items()), F.lit(0))
    df = df.withColumns({"state": F.when(low >= 2, "ordered").otherwise("disordered"), "_m": roll("close", F.avg, 20), "_sd": F.stddev_samp("close").over(Window.partitionBy("symbol")), "_t": 1.5 * roll("energy", F.avg, 20)})
    df = df.withColumn("force", -F.when(c("state") == "ordered", 2.0).otherwise(0.5) * (c("close") - c("_m")) - 0.1 * c("_v"))
    breakout = (c("state") == "ordered") & F.coalesce(c("energy") > c("_t"), F.lit(False))
    reversion = (c("state") == "disordered") & F.coalesce(F.abs("force") > 2 * c("_sd"), F.lit(False))
    return df.withColumns({"breakout": breakout, "reversion": reversion}).drop("_d", "_v", "_r", "_x5", "_x7", "_x14", "_m", "_sd", "_t")


def cluster_reversion(df: DataFrame, threshold: float = 0.85, window: int = 20, enter: float = 2.0, leave: float = 0.0) -> DataFrame:
    """``z, signal``: against the distance from the mean in the largest group of symbols whose returns correlate above the threshold; others have no z and stay flat."""
    from lodestar.operators.pairs import clusters, correlations, grid_returns

    rets = grid_returns(df, None).withColumn("ret", F.exp("ret") - 1)
    groups = clusters(correlations(rets), df.select("symbol").distinct(), threshold)
    largest = groups.groupBy("cluster", "size").agg(F.count("*")).orderBy(F.desc("size"), "cluster").limit(1).select("cluster")
    inside = groups.join(F.broadcast(largest), "cluster", "left_semi").select("symbol", F.lit(True).alias("_in"))
    z = -ratio(c("close") - roll("close", F.avg, window), roll("close", F.stddev_samp, window))
    df = df.join(inside, "symbol", "left").withColumn("_z", z).withColumn("z", F.when(c("_in"), c("_z")))
    return df.withColumn("signal", ta.hold(F.when(F.abs("z") < leave, 0).when(c("z") < -enter, -1).when(c("z") > enter, 1))).drop("_in", "_z")


def strength_stop(df: DataFrame, length: int = 14, start: float = 0.02, more: float = 0.02, most: float = 0.2) -> DataFrame:
    """``RSI``, and ``SAR_RSI``: a stop-and-reverse line that follows the strength of highs and lows as it would follow prices; strength is 0 until it is defined, and has nine digits, so that a price that stands still makes no new extreme by rounding."""
    parts = {f"_{x[0]}{way}": x for x in ("close", "high", "low") for way in "ud"}
    for name, x in parts.items():
        move = F.col(x) - lag(x)
        df = df.withColumn(name, F.when(move.isNull(), None).otherwise(F.greatest(move if name[-1] == "u" else -move, F.lit(0.0))))
    df = ta.ewm(df, [(f"{n}m", n, 1 / length, length, "first") for n in parts])
    strength = lambda x: F.coalesce(F.round(100 * ratio(c(f"_{x}um"), c(f"_{x}um") + c(f"_{x}dm")), 9), F.lit(0.0))
    df = df.withColumns({"RSI": strength("c"), "_top": strength("h"), "_bottom": strength("l")}).drop(*parts, *(f"{n}m" for n in parts))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        high, low = row
        if state is None:
            return (1, high, low, start, [row]), (0.0,)
        side, extreme, line, pace, before = state
        line += pace * (extreme - line)
        near, far = (low, high) if side > 0 else (high, low)  # where the line is crossed, and where a new extreme is made
        inner, outer = (min, max) if side > 0 else (max, min)
        if side * (line - near) > 0:
            line, extreme, side, pace = outer(far, extreme), near, -side, start
        else:
            if side * (far - extreme) > 0:
                extreme, pace = far, min(pace + more, most)
            line = inner(line, *(b[1] if side > 0 else b[0] for b in before))
        return (side, extreme, line, pace, [row, *before[:1]]), (line,)

    return scan_state(df, lambda: None, step, ["_top", "_bottom"], T.StructType([T.StructField("SAR_RSI", T.DoubleType())])).drop("_top", "_bottom")


def kinematics(df: DataFrame, length: int = 14, smooth: int = 5) -> DataFrame:
    """``velocity`` (the mean move), ``acceleration`` (its change), and ``long, short``: the first bar on which both and the strength against its stop line point one way."""
    df = strength_stop(df.withColumn("_move", c("close") - lag("close")), length)
    df = ta.ewm(df, [("velocity", "_move", 2 / (smooth + 1), smooth, "sma"), ("RSI_EMA", "RSI", 2 / (smooth + 1), smooth, "sma")])
    df = df.withColumn("acceleration", c("velocity") - lag("velocity"))
    ways = {"long": (c("velocity") > 0) & (c("acceleration") > 0) & (c("RSI_EMA") > c("SAR_RSI")), "short": (c("velocity") < 0) & (c("acceleration") < 0) & (c("RSI_EMA") < c("SAR_RSI"))}
    df = df.withColumns({f"_{k}": F.coalesce(w, F.lit(False)) for k, w in ways.items()})
    return df.withColumns({k: c(f"_{k}") & ~F.coalesce(lag(f"_{k}"), F.lit(True)) for k in ways}).drop("_move", *(f"_{k}" for k in ways))


def frame_kinematics(low: DataFrame, mid: DataFrame, regimes: DataFrame, mid_seconds: int, low_seconds: int, length: int = 14, smooth: int = 5) -> DataFrame:
    """Bars of ``low`` with ``signal``: entries of ``kinematics`` on the bars of ``mid`` where the coarse regime agrees, taken on the next low bar.

    ``regimes`` holds ``symbol, ts, regime``: 1, -1 or 0 (flat; also a null, and before the first
    one), known from ``ts`` on.  Bars carry the time they begin and are known when they end, so no
    signal looks ahead; a coarse bar that ends with a mid bar counts for it, a mid bar that ends with
    a low bar counts for the low bar after that.  A state is held until the other side enters or
    the regime is flat; a low bar before the first mid one is flat.
    """
    ended = lambda df, n: df.withColumn("ts", F.timestamp_micros(F.unix_micros(c("ts").cast("timestamp")) + n * 1_000_000))
    made = ended(kinematics(mid.select("symbol", "ts", "high", "low", "close"), length, smooth), mid_seconds)
    # a null regime is one of its own: it must not be filled by the one before
    gated = asof(made.select("symbol", "ts", "long", "short"), regimes.select("symbol", c("ts").cast("timestamp").alias("ts"), F.coalesce("regime", F.lit(0)).alias("regime")), ["regime"])
    regime = F.coalesce("asof_regime", F.lit(0))
    state = F.when(regime == 0, 0).when((regime > 0) & c("long"), 1).when((regime < 0) & c("short"), -1)
    gated = gated.withColumn("state", F.coalesce(ffill(state), F.lit(0)))
    out = asof(ended(low.withColumn("_begin", c("ts")), low_seconds), gated.select("symbol", "ts", "state"), ["state"])
    return out.withColumn("signal", F.coalesce(lag("asof_state"), F.lit(0))).withColumn("ts", c("_begin")).drop("_begin", "asof_state")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (ema_cross, macd_trend, bollinger_reversion, rsi_reversal, zscore_arb, washer, turtle, channel_breakout, narrow_breakout, swing_reversal, supertrend_direction, macd_reversal, grid_trading, grid_reversal, markov_trend, markov_cross, double_markov, tdi_time_exit, rebalancing_premium, bouncy_ball, ichimoku_cloud, daily_range_breakout, squeeze_breakout, tdi_heikin_ashi, newsom, news_breakout, cluster_reversion)}
#: Default grids of the strategies.
GRIDS: dict[str, dict[str, list]] = {
    "ema_cross": {"fast": [5, 10, 20], "slow": [50, 100]},
    "macd_trend": {"fast": [8, 12], "slow": [26, 40], "signal": [9]},
    "bollinger_reversion": {"length": [10, 20, 40], "std": [1.5, 2.0, 2.5]},
    "rsi_reversal": {"length": [7, 14], "lower": [20.0, 30.0], "upper": [70.0, 80.0]},
    "zscore_arb": {"length": [10, 20, 40], "threshold": [1.5, 2.0]},
    "washer": {"lookback": [2, 4], "window": [24, 48]},
    "turtle": {"entry": [20, 40, 55], "leave": [10, 20]},
    "channel_breakout": {"long_entry": [20, 40], "long_exit": [10], "short_entry": [20, 40], "short_exit": [10]},
    "narrow_breakout": {"window": [4, 7, 10]},
    "swing_reversal": {"trend": [2, 3, 4]},
    "supertrend_direction": {"length": [7, 10, 14], "multiplier": [2.0, 3.0]},
    "macd_reversal": {"fast": [8, 12], "slow": [30, 40], "signal": [9]},
    "grid_trading": {"count": [5, 10, 20], "upper": [1.1, 1.2], "lower": [0.8, 0.9]},
    "grid_reversal": {"count": [5, 10, 20], "upper": [1.05, 1.1], "lower": [0.9, 0.95]},
    "markov_trend": {"lookback": [7, 14], "threshold": [0.3, 0.5], "history": [20, 33]},
    "markov_cross": {"lookback": [7, 14], "threshold": [0.3, 0.5], "history": [20, 33]},
    "double_markov": {"lookback_ev": [60, 90], "lookback": [14], "smooth": [10, 20]},
    "tdi_time_exit": {"rsi_length": [14, 21], "bars": [5, 10]},
    "rebalancing_premium": {"length": [20, 40], "std": [1.5, 2.0], "trend": [True, False]},
    "bouncy_ball": {"slow": [100, 200], "fast": [10, 20], "oversold": [30.0, 40.0]},
    "ichimoku_cloud": {"tenkan": [7, 9], "kijun": [22, 26]},
    "daily_range_breakout": {"hold_days": [1, 5, 10], "reverse": [True, False]},
    "squeeze_breakout": {"length": [20, 40], "channel": [1.5, 2.0], "follow": [True, False]},
    "tdi_heikin_ashi": {"rsi_length": [13, 21], "green": [2, 5], "strong": [0.8, 1.0]},
    "newsom": {"length": [14, 22], "multiplier": [2.0, 3.0], "bands": [20]},
    "news_breakout": {"take": [25.0, 35.0], "stop": [15.0, 25.0], "by_colour": [True, False]},
    "cluster_reversion": {"threshold": [0.8, 0.85, 0.9], "window": [20, 40], "enter": [1.5, 2.0]},
}
#: Other names of the strategies.
ALIASES = {
    "ema": "ema_cross", "macd": "macd_trend", "bollinger": "bollinger_reversion", "rsi": "rsi_reversal", "zscore": "zscore_arb", "channel": "channel_breakout", "nr7": "narrow_breakout", "swing": "swing_reversal", "supertrend": "supertrend_direction",
    "grid": "grid_trading", "markov": "markov_trend", "tdi": "tdi_time_exit", "rebalancing": "rebalancing_premium", "ichimoku": "ichimoku_cloud", "squeeze": "squeeze_breakout", "news": "news_breakout", "cluster": "cluster_reversion",
}


def default_grid(name: str) -> dict[str, list]:
    return GRIDS[ALIASES.get(name, name)]


def ema_cross_grid(bars: DataFrame, points: list[dict]) -> DataFrame:
    """``param_id, symbol, ts, close, signal`` of ``ema_cross`` at every point: each distinct length is solved once, all in one pass, and the points pick theirs."""
    pairs = [(p.get("fast", 10), p.get("slow", 50)) for p in points]
    wide = ta.ewm(bars, [(f"_e{n}", "close", 2 / (n + 1), n, "sma") for n in sorted({n for pair in pairs for n in pair})])
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("param_id"), c(f"_e{fast}").alias("_f"), c(f"_e{slow}").alias("_s")) for k, (fast, slow) in enumerate(pairs))))
    long = wide.select("symbol", "ts", "close", each.alias("g")).select(F.struct("g.param_id", "symbol").alias("symbol"), "ts", "close", "g._f", "g._s")
    return held(long, c("_f") > c("_s"), c("_f") < c("_s")).select("symbol.param_id", "symbol.symbol", "ts", "close", "signal")


def signals(bars: DataFrame, name: str, **params) -> DataFrame:
    """Signals of a strategy by its name or another name of it."""
    return STRATEGIES[ALIASES.get(name, name)](bars, **params)
