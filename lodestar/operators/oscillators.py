"""Further technical indicators per symbol: windows, exponential means and carried states.

The same rules hold as in ``indicators``; ``INDICATORS`` there has these, too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scan import ewm, linear_scan, scan_state
from lodestar.functions.windows import by_time, diff, kernel, lag, ratio, roll, so_far, streak
from lodestar.operators.indicators import _nonzero, atr, ema, linreg, rsi, true_range

c = F.col


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def _ma(df: DataFrame, specs: list[tuple[str, str, int]]) -> DataFrame:
    """Exponential means ``(name, column, length)`` in one pass."""
    return ewm(df, [(name, col, 2 / (n + 1), n, "sma") for name, col, n in specs])


# --- windows


def gravity(df: DataFrame, length: int = 10) -> DataFrame:
    """Centre of gravity: the weighted sum of the last closes over their sum, negative."""
    weights = [float(k + 1) for k in range(length)]
    return df.withColumn(f"CG_{length}", -ratio(kernel("close", weights) * math.fsum(weights), roll("close", F.sum, length)))


def correlation_trend(df: DataFrame, length: int = 12) -> DataFrame:
    df = linreg(df, length)
    return df.withColumn(f"CTI_{length}", c(f"LRr_{length}")).drop(*(f"{n}_{length}" for n in ("LR", "LRm", "LRb", "LRr", "TSF")))


def regression_angle(df: DataFrame, length: int = 14) -> DataFrame:
    """Slope of the regression line as an angle in degrees."""
    df = linreg(df, length)
    return df.withColumn(f"LRa_{length}", F.degrees(F.atan(f"LRm_{length}"))).drop(*(f"{n}_{length}" for n in ("LR", "LRm", "LRb", "LRr", "TSF")))


def fast_stoch(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    lo, hi = roll("low", F.min, k), roll("high", F.max, k)
    return df.withColumn(f"STOCHFk_{k}_{d}", 100 * (c("close") - lo) / _nonzero(hi - lo)).withColumn(f"STOCHFd_{k}_{d}", roll(f"STOCHFk_{k}_{d}", F.avg, d))


def brar(df: DataFrame, length: int = 26) -> DataFrame:
    """Sums of the ranges over and under the open (AR), and over and under the close before (BR), as percentages."""
    df = df.withColumns({"_p": lag("close"), "_ho": c("high") - c("open"), "_ol": c("open") - c("low")}).withColumns({"_hp": F.greatest(F.lit(0.0), c("high") - c("_p")), "_pl": F.greatest(F.lit(0.0), c("_p") - c("low"))})
    df = df.withColumns({x: F.when(c("_p").isNotNull(), c(x)) for x in ("_hp", "_pl")})
    return df.withColumns({f"AR_{length}": 100 * ratio(roll("_ho", F.sum, length), roll("_ol", F.sum, length)), f"BR_{length}": 100 * ratio(roll("_hp", F.sum, length), roll("_pl", F.sum, length))}).drop("_p", "_ho", "_ol", "_hp", "_pl")


def price_distance(df: DataFrame) -> DataFrame:
    return df.withColumn("PDIST", 2 * (c("high") - c("low")) + F.abs(c("open") - lag("close")) - F.abs(c("close") - c("open")))


def ease_of_movement(df: DataFrame, length: int = 14, divisor: float = 1e8) -> DataFrame:
    mid = (c("high") + c("low")) / 2
    df = df.withColumn("_m", mid)
    df = df.withColumn("_e", ratio(diff("_m"), c("volume") / divisor / _nonzero(c("high") - c("low"))))
    return df.withColumn(f"EOM_{length}", roll("_e", F.avg, length)).drop("_m", "_e")


def volume_indexes(df: DataFrame, length: int = 1, initial: float = 1000.0) -> DataFrame:
    """Negative and positive volume index: sums of the close's rate of change on bars of falling, and of rising, volume."""
    grow = 100 * ratio(diff("close", length), lag("close", length))
    df = df.withColumns({"_g": F.coalesce(grow, F.lit(0.0)), "_d": diff("volume")})
    total = lambda on: initial + F.sum(F.when(on, c("_g")).otherwise(0.0)).over(so_far())
    return df.withColumns({"NVI": total(c("_d") < 0), "PVI": total(c("_d") > 0)}).drop("_g", "_d")


def volume_heat(df: DataFrame, length: int = 610) -> DataFrame:
    """Distance of the volume from its mean in population deviations."""
    return df.withColumn(f"VHM_{length}", ratio(c("volume") - roll("volume", F.avg, length), roll("volume", F.stddev_pop, length)))


def time_segmented_volume(df: DataFrame, length: int = 18, signal: int = 10) -> DataFrame:
    df = df.withColumn("_d", diff("close")).withColumn("_v", F.abs("_d") * c("volume"))
    df = df.withColumn(f"TSV_{length}", roll(F.signum("_d") * c("_v"), F.sum, length)).withColumn(f"TSVs_{length}", roll(f"TSV_{length}", F.avg, signal))
    return df.withColumn(f"TSVr_{length}", ratio(c(f"TSV_{length}"), c(f"TSVs_{length}"))).drop("_d", "_v")


def vwap(df: DataFrame, anchor: str = "day", bands: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Volume-weighted price since the start of the anchor, and bands by volume-weighted deviations."""
    w = Window.partitionBy("symbol", F.date_trunc(anchor, "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    df = df.withColumn("VWAP", ratio(F.sum(c("_tp") * c("volume")).over(w), F.sum("volume").over(w))).withColumn("_q", c("volume") * (c("_tp") - c("VWAP")) ** 2)
    df = df.withColumn("_s", F.sqrt(ratio(F.sum("_q").over(w), F.sum("volume").over(w))))
    return df.withColumns({f"VWAP_{side}_{b:g}": c("VWAP") + s * b * c("_s") for b in bands for side, s in (("L", -1), ("U", 1))}).drop("_tp", "_q", "_s")


def volume_profile(df: DataFrame, bins: int = 10, by_price: bool = False) -> DataFrame:
    """For each symbol and bin, of consecutive bars or of equal price ranges: low, mean and high close and the volume of rising, falling and still bars."""
    df = df.withColumns({"_d": diff("close"), "_n": F.ntile(bins).over(by_time()) - 1})
    if by_price:
        whole = Window.partitionBy("symbol")
        lo, hi = F.min("close").over(whole), F.max("close").over(whole)
        df = df.withColumn("_n", F.least(F.lit(bins - 1), F.floor(ratio(c("close") - lo, hi - lo) * bins)))
    part = lambda on: F.sum(F.when(on, c("volume")).otherwise(0.0))
    out = df.groupBy("symbol", c("_n").cast("int").alias("bin")).agg(F.min("close").alias("low"), F.avg("close").alias("mean"), F.max("close").alias("high"), part(c("_d") > 0).alias("rising"), part(c("_d") < 0).alias("falling"), part((c("_d") == 0) | c("_d").isNull()).alias("still"))
    return out.withColumn("total", c("rising") + c("falling"))


def runs(df: DataFrame, fast: str, slow: str, length: int = 2) -> DataFrame:
    """``LR, SR``: a rising fast line over any slow one but a flat one (long run), and a falling one (short run)."""
    up, down = (lambda x: _flag(diff(x, length) > 0)), (lambda x: _flag(diff(x, length) < 0))
    return df.withColumns({f"LR_{length}": F.when(up(fast) + up(slow) == 2, 1).when(up(fast) + down(slow) == 2, 1).otherwise(0), f"SR_{length}": F.when(down(fast) + down(slow) == 2, 1).when(down(fast) + up(slow) == 2, 1).otherwise(0)})


def crosses(df: DataFrame, a: str, b: Column | str, name: str = "X") -> DataFrame:
    """``_above, _over, _under``: whether a is over b, and whether it has just come over or under it."""
    b = c(b) if isinstance(b, str) else b
    df = df.withColumn("_b", b).withColumns({"_now": (c(a) > c("_b")).cast("int"), "_low": (c(a) < c("_b")).cast("int")})
    return df.withColumns({f"{name}_above": F.coalesce("_now", F.lit(0)), f"{name}_over": _flag((c("_now") == 1) & (lag("_now") == 0)), f"{name}_under": _flag((c("_low") == 1) & (lag("_low") == 0))}).drop("_b", "_now", "_low")


def trend_signals(df: DataFrame, trend: Column) -> DataFrame:
    """``TS_Trends, TS_Trades, TS_Entries, TS_Exits`` of a condition: its state, its changes, and which of them begin or end it."""
    df = df.withColumn("TS_Trends", _flag(trend)).withColumn("TS_Trades", F.coalesce(diff("TS_Trends"), F.lit(0)))
    return df.withColumns({"TS_Entries": (c("TS_Trades") > 0).cast("int"), "TS_Exits": (c("TS_Trades") < 0).cast("int")})


def band_signals(df: DataFrame, col: str, above: float, below: float) -> DataFrame:
    """Signals of an indicator against two levels: over the upper, under the lower, and the crossings of each."""
    df = crosses(df, col, F.lit(above), f"{col}_A")
    return crosses(df, col, F.lit(below), f"{col}_B")


def exhaustion(df: DataFrame, length: int = 4, cap: int = 13) -> DataFrame:
    """How many bars in a row the close has been under, and over, the one ``length`` bars before, up to ``cap``; counts under 6 and over 9 are 0."""
    d = diff("close", length)
    df = df.withColumn("_d", d)
    df = streak(streak(df, c("_d") < 0, "_dn"), c("_d") > 0, "_up")
    shown = lambda x: F.when(c(x).between(6, 9), F.least(c(x), F.lit(cap))).otherwise(0).cast("int")
    return df.withColumns({f"EXHCd_{length}": shown("_dn"), f"EXHCu_{length}": shown("_up")}).drop("_d", "_dn", "_up")


def imbalances(df: DataFrame, length: int = 14, vol_length: int = 20, vol_ratio: float = 1.5, percent: float = 1.0) -> DataFrame:
    """Gaps between the bar and the one two before, at the top and bottom, against the range of the last bars; and wide bars."""
    span = roll("high", F.max, length) - roll("low", F.min, length)
    df = df.withColumns({"SMCbi": c("low") - lag("high", 2), "SMCti": lag("low", 2) - c("high"), "_s": span, "_h": c("high") - c("low")})
    df = df.withColumns({"SMCbp": 100 * ratio(c("SMCbi"), c("_s")), "SMCtp": 100 * ratio(c("SMCti"), c("_s"))})
    return df.withColumns({"SMChv": _flag(c("_h") > vol_ratio * roll("_h", F.avg, vol_length)), "SMCbf": _flag((c("SMCbi") > 0) & (c("SMCbp") > percent)), "SMCtf": _flag((c("SMCti") > 0) & (c("SMCtp") > percent))}).drop("_s", "_h")


def candle_scores(df: DataFrame, length: int = 30) -> DataFrame:
    return df.withColumns({f"{x}_Z_{length}": ratio(c(x) - roll(x, F.avg, length), roll(x, F.stddev_samp, length)) for x in ("open", "high", "low", "close")})


def detrended(df: DataFrame, length: int = 20, lookahead: bool = False) -> DataFrame:
    """The close less its mean of half a length before; ``lookahead`` centres it, which uses later bars."""
    t = length // 2 + 1
    df = df.withColumn("_m", roll("close", F.avg, length))
    if not lookahead:
        return df.withColumn(f"DPO_{length}", c("close") - lag("_m", t)).drop("_m")
    df = df.withColumn("_x", lag("close", t) - c("_m"))
    return df.withColumn(f"DPO_{length}", F.lead("_x", t).over(by_time())).drop("_m", "_x")


def remap(df: DataFrame, col: str = "close", low: float = 0.0, high: float = 100.0, to_low: float = -1.0, to_high: float = 1.0) -> DataFrame:
    return df.withColumn("REMAP", to_low + (to_high - to_low) / (high - low) * (c(col) - low))


def cube(df: DataFrame, col: str = "close", power: float = 3.0) -> DataFrame:
    return df.withColumn(f"CUBE_{power:g}", F.pow(c(col), power)).withColumn(f"CUBEs_{power:g}", lag(f"CUBE_{power:g}"))


def inverse_fisher(df: DataFrame, col: str = "close", amp: float = 1.0) -> DataFrame:
    """Hyperbolic tangent of half the value, put into -1 to 1 over the whole series first if any is outside."""
    whole = Window.partitionBy("symbol")
    lo, hi = F.min(col).over(whole), F.max(col).over(whole)
    x = F.when((lo >= -1) & (hi <= 1), c(col)).otherwise(2 * ratio(c(col) - lo, hi - lo) - 1)
    return df.withColumn("_x", F.exp(amp * x)).withColumn("INVFISHER", ratio(c("_x") - 1, c("_x") + 1)).drop("_x")


def deviation_lines(df: DataFrame, widths: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The regression line of the whole series and lines at multiples of its standard deviation."""
    df = df.withColumn("_i", F.row_number().over(by_time()) - 1)
    fit = df.groupBy("symbol").agg(F.regr_slope("close", "_i").alias("_b"), F.regr_intercept("close", "_i").alias("_a"), F.stddev_samp("close").alias("_s"))
    df = df.join(fit, "symbol").withColumn("TOS_LR", c("_a") + c("_b") * c("_i"))
    return df.withColumns({f"TOS_{side}_{k}": c("TOS_LR") + s * k * c("_s") for k in widths for side, s in (("L", -1), ("U", 1))}).drop("_i", "_a", "_b", "_s")


def percent_rank(df: DataFrame, length: int = 100) -> DataFrame:
    """Share of the ``length`` returns before that are under the last one, as a percentage."""
    df = df.withColumn("_r", ratio(c("close"), lag("close")) - 1)
    before = by_time().rowsBetween(-length, -1)
    df = df.withColumn("_v", F.collect_list("_r").over(before))
    return df.withColumn(f"PRANK_{length}", F.when(F.size("_v") == length, 100.0 * F.size(F.filter("_v", lambda v: v < c("_r"))) / length)).drop("_r", "_v")


def true_momentum(df: DataFrame, length: int = 14, calc: int = 5, smooth: int = 3) -> DataFrame:
    """Sum of the signs of the close less each of the last opens, averaged twice exponentially, and a slower line."""
    total = sum((F.signum(c("close") - lag("open", k)) for k in range(1, length)), F.lit(0.0))
    df = _ma(df.withColumn("_t", total), [("_a", "_t", calc)])
    df = _ma(df, [(f"TMO_{length}", "_a", smooth)])
    return _ma(df, [(f"TMOs_{length}", f"TMO_{length}", smooth)]).drop("_t", "_a")


def more_pivots(df: DataFrame, method: str = "classic", anchor: str = "month") -> DataFrame:
    """Classic, Woodie and DeMark pivots from the bars of the period before."""
    period = F.date_trunc(anchor, "ts")
    bars = df.groupBy("symbol", period.alias("_period")).agg(F.min_by("open", "ts").alias("_o"), F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "ts").alias("_c"))
    w = Window.partitionBy("symbol").orderBy("_period")
    bars = bars.withColumn("_now", c("_o")).select("symbol", "_period", "_now", *(F.lag(x).over(w).alias(x) for x in ("_o", "_h", "_l", "_c")))
    o, h, lo, cl, span = c("_o"), c("_h"), c("_l"), c("_c"), c("_h") - c("_l")
    if method == "classic":
        p = (h + lo + cl) / 3
        levels = {"S1": 2 * p - h, "S2": p - span, "S3": p - 2 * span, "S4": p - 3 * span, "R1": 2 * p - lo, "R2": p + span, "R3": p + 2 * span, "R4": p + 3 * span}
    elif method == "woodie":
        p = (2 * c("_now") + h + lo) / 4
        levels = {"S1": 2 * p - h, "S2": p - span, "S3": lo - 2 * (h - p), "R1": 2 * p - lo, "R2": p + span, "R3": h + 2 * (p - lo)}
    else:
        p = F.when(o == cl, (h + lo + 2 * cl) / 4).when(cl > o, (2 * h + lo + cl) / 4).otherwise((h + 2 * lo + cl) / 4)
        levels = {"S1": 2 * p - h, "R1": 2 * p - lo}
    out = df.withColumn("_period", period).join(bars, ["symbol", "_period"], "left").withColumns({"PIVOT": p, **levels})
    return out.drop("_period", "_now", "_o", "_h", "_l", "_c")


# --- exponential means


def smma(df: DataFrame, length: int = 7, col: str = "close", name: str | None = None) -> DataFrame:
    """Smoothed mean: weight 1 / length from the plain mean of the first ones on."""
    return ewm(df, [(name or f"SMMA_{length}", col, 1 / length, length, "sma")])


def alligator(df: DataFrame, jaw: int = 13, teeth: int = 8, lips: int = 5) -> DataFrame:
    return ewm(df, [(f"AG{x}", "close", 1 / n, n, "sma") for x, n in (("j", jaw), ("t", teeth), ("l", lips))])


def t3(df: DataFrame, length: int = 10, a: float = 0.7) -> DataFrame:
    df = ewm(df, [(f"_e{k}", "close" if k == 1 else f"_e{k - 1}", 2 / (length + 1), length, "sma") for k in range(1, 7)])
    weights = (a**3 + 3 * a**2 + 3 * a + 1, -6 * a**2 - 3 * a - 3 * a**3, 3 * a**2 + 3 * a**3, -(a**3))
    return df.withColumn(f"T3_{length}", sum((F.lit(w) * c(f"_e{k}") for w, k in zip(weights, (3, 4, 5, 6), strict=True)), F.lit(0.0))).drop(*(f"_e{k}" for k in range(1, 7)))


def zero_lag(df: DataFrame, length: int = 10) -> DataFrame:
    df = df.withColumn("_x", 2 * c("close") - lag("close", (length - 1) // 2))
    return ema(df, length, "_x", f"ZL_EMA_{length}").drop("_x")


def ppo(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Percentage price oscillator of plain means, with an exponential signal."""
    df = df.withColumn(f"PPO_{fast}_{slow}", 100 * ratio(roll("close", F.avg, fast) - roll("close", F.avg, slow), roll("close", F.avg, slow)))
    df = ewm(df, [(f"PPOs_{fast}_{slow}", f"PPO_{fast}_{slow}", 2 / (signal + 1), signal, "counted")])
    return df.withColumn(f"PPOh_{fast}_{slow}", c(f"PPO_{fast}_{slow}") - c(f"PPOs_{fast}_{slow}"))


def tsi(df: DataFrame, fast: int = 13, slow: int = 25, signal: int = 13, name: str = "TSI") -> DataFrame:
    """True strength: twice-smoothed change over twice-smoothed absolute change."""
    df = df.withColumn("_d", diff("close")).withColumn("_q", F.abs("_d"))
    df = _ma(df, [("_s", "_d", slow), ("_t", "_q", slow), ("_fs", "_s", fast), ("_ft", "_t", fast)])
    df = df.withColumn(f"{name}_{fast}_{slow}", 100 * ratio(c("_fs"), c("_ft")))
    return _ma(df, [(f"{name}s_{fast}_{slow}", f"{name}_{fast}_{slow}", signal)]).drop("_d", "_q", "_s", "_t", "_fs", "_ft")


def smi(df: DataFrame, fast: int = 5, slow: int = 20, signal: int = 5) -> DataFrame:
    df = tsi(df, fast, slow, signal, "SMI")
    return df.withColumn(f"SMIo_{fast}_{slow}", c(f"SMI_{fast}_{slow}") - c(f"SMIs_{fast}_{slow}"))


def pretty_good(df: DataFrame, length: int = 14) -> DataFrame:
    df = _ma(atr(df, length), [("_e", f"ATRr_{length}", length)])
    return df.withColumn(f"PGO_{length}", ratio(c("close") - roll("close", F.avg, length), c("_e"))).drop("_e", f"ATRr_{length}", f"NATR_{length}")


def elder_ray(df: DataFrame, length: int = 13) -> DataFrame:
    return ema(df, length, name="_e").withColumns({f"ERIbull_{length}": c("high") - c("_e"), f"ERIbear_{length}": c("low") - c("_e")}).drop("_e")


def _adjusted(df: DataFrame, specs: list[tuple[str, str, int]]) -> DataFrame:
    """Means of weight 1 / n with all weights normalised: the weighted sum and the sum of weights as two recurrences."""
    terms = {}
    for name, x, n in specs:
        seen = F.count(x).over(so_far())
        df = df.withColumn(f"_c{name}", seen)
        keep = F.when(c(f"_c{name}") == 0, 0.0).otherwise(1 - 1 / n)
        terms[f"_u{name}"], terms[f"_v{name}"] = (keep, F.coalesce(c(x), F.lit(0.0))), (keep, F.when(c(x).isNotNull(), 1.0).otherwise(0.0))
    df = linear_scan(df, terms)
    for name, _, n in specs:
        df = df.withColumn(name, F.when(c(f"_c{name}") >= n, ratio(c(f"_u{name}"), c(f"_v{name}")))).drop(f"_c{name}", f"_u{name}", f"_v{name}")
    return df


def kdj(df: DataFrame, length: int = 9, signal: int = 3) -> DataFrame:
    lo, hi = roll("low", F.min, length), roll("high", F.max, length)
    df = df.withColumn("_k", 100 * (c("close") - lo) / _nonzero(hi - lo))
    df = _adjusted(_adjusted(df, [(f"K_{length}", "_k", signal)]), [(f"D_{length}", f"K_{length}", signal)])
    return df.withColumn(f"J_{length}", 3 * c(f"K_{length}") - 2 * c(f"D_{length}")).drop("_k")


def stoch_rsi(df: DataFrame, length: int = 14, rsi_length: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    df = rsi(df, rsi_length)
    lo, hi = roll(f"RSI_{rsi_length}", F.min, length), roll(f"RSI_{rsi_length}", F.max, length)
    df = df.withColumn("_s", 100 * (c(f"RSI_{rsi_length}") - lo) / _nonzero(hi - lo)).withColumn(f"STOCHRSIk_{length}", roll("_s", F.avg, k))
    return df.withColumn(f"STOCHRSId_{length}", roll(f"STOCHRSIk_{length}", F.avg, d)).drop("_s", f"RSI_{rsi_length}")


def connors_rsi(df: DataFrame, length: int = 3, streak_length: int = 2, rank: int = 100) -> DataFrame:
    """Mean of the strength of the close, the strength of its streak of rises or falls, and the rank of its return."""
    df = df.withColumn("_dc", diff("close"))
    df = streak(streak(df, c("_dc") > 0, "_up"), c("_dc") < 0, "_dn").withColumn("_k", (c("_up") - c("_dn")).cast("double"))
    df = percent_rank(rsi(df, length), rank).withColumn("_cl", c("close"))
    df = rsi(df.withColumn("close", c("_k")), streak_length).withColumn("close", c("_cl"))
    return df.withColumn(f"CRSI_{length}_{streak_length}_{rank}", (c(f"RSI_{length}") + c(f"RSI_{streak_length}") + c(f"PRANK_{rank}")) / 3).drop("_dc", "_up", "_dn", "_k", "_cl", f"RSI_{length}", f"RSI_{streak_length}", f"PRANK_{rank}")


def relative_volatility(df: DataFrame, length: int = 14) -> DataFrame:
    """Exponential mean of the deviation on rising bars over that on all."""
    df = df.withColumns({"_s": roll("close", F.stddev_samp, length), "_d": diff("close")})
    df = df.withColumns({"_p": F.when(c("_d") > 0, c("_s")).when(c("_d").isNotNull(), F.when(c("_s").isNotNull(), 0.0)), "_n": F.when(c("_d") < 0, c("_s")).when(c("_d").isNotNull(), F.when(c("_s").isNotNull(), 0.0))})
    df = _ma(df, [("_ep", "_p", length), ("_en", "_n", length)])
    return df.withColumn(f"RVI_{length}", 100 * ratio(c("_ep"), c("_ep") + c("_en"))).drop("_s", "_d", "_p", "_n", "_ep", "_en")


def inertia(df: DataFrame, length: int = 20, rvi_length: int = 14) -> DataFrame:
    """End of the regression line through the relative volatility."""
    df = relative_volatility(df, rvi_length).withColumn("_cl", c("close"))
    df = linreg(df.withColumn("close", c(f"RVI_{rvi_length}")), length).withColumn("close", c("_cl"))
    return df.withColumn(f"INERTIA_{length}_{rvi_length}", c(f"LR_{length}")).drop("_cl", f"RVI_{rvi_length}", *(f"{n}_{length}" for n in ("LR", "LRm", "LRb", "LRr", "TSF")))


def thermometer(df: DataFrame, length: int = 20, long: float = 2.0, short: float = 0.5) -> DataFrame:
    df = df.withColumn("_t", F.when(F.abs(diff("low")) > F.abs(diff("high")), F.abs(diff("low"))).otherwise(F.abs(diff("high"))))
    df = _ma(df, [(f"THERMOma_{length}", "_t", length)])
    return df.withColumns({f"THERMO_{length}": c("_t"), f"THERMOl_{length}": _flag(c("_t") < long * c(f"THERMOma_{length}")), f"THERMOs_{length}": _flag(c("_t") > short * c(f"THERMOma_{length}"))}).drop("_t")


def aberration(df: DataFrame, length: int = 5, atr_length: int = 15) -> DataFrame:
    df = atr(df, atr_length)
    mid = roll((c("high") + c("low") + c("close")) / 3, F.avg, length)
    return df.withColumn(f"ABER_ZG_{length}", mid).withColumns({f"ABER_SG_{length}": c(f"ABER_ZG_{length}") + c(f"ATRr_{atr_length}"), f"ABER_XG_{length}": c(f"ABER_ZG_{length}") - c(f"ATRr_{atr_length}")}).drop(f"ATRr_{atr_length}", f"NATR_{atr_length}")


def chandelier(df: DataFrame, length: int = 22, atr_length: int = 14, multiplier: float = 2.0) -> DataFrame:
    """Stops under the highest high and over the lowest low so far in the window, and the side last broken out to."""
    df = atr(df, atr_length)
    w = c(f"ATRr_{atr_length}") * multiplier
    df = df.withColumns({"CHDLREXTl": roll("high", F.max, length, least=1) - w, "CHDLREXTs": roll("low", F.min, length, least=1) + w})
    side = _flag(c("close") > lag("CHDLREXTl")) - _flag(c("close") < lag("CHDLREXTs"))
    df = df.withColumn("_s", side).withColumn("_s", F.when((F.row_number().over(by_time()) == 1) & (c("_s") == 0), 1).otherwise(c("_s")))
    return df.withColumn("CHDLREXTd", F.last(F.when(c("_s") != 0, c("_s")), ignorenulls=True).over(so_far())).drop("_s", f"ATRr_{atr_length}", f"NATR_{atr_length}")


def kroll_stops(df: DataFrame, p: int = 10, x: float = 3.0, q: int = 20) -> DataFrame:
    df = atr(df, p)
    df = df.withColumns({"_l": roll("high", F.max, p) - x * c(f"ATRr_{p}"), "_s": roll("low", F.min, p) + x * c(f"ATRr_{p}")})
    return df.withColumns({f"CKSPl_{p}": roll("_l", F.max, q), f"CKSPs_{p}": roll("_s", F.min, q)}).drop("_l", "_s", f"ATRr_{p}", f"NATR_{p}")


def squeeze(df: DataFrame, length: int = 20, std: float = 2.0, widths: tuple[float, ...] = (1.5,), momentum: int = 12, smooth: int = 6) -> DataFrame:
    """Bands inside the channel of mean true ranges (on), outside it (off) or neither, for each channel width, and smoothed momentum."""
    df = true_range(df, "_tr")
    df = df.withColumns({"_m": roll("close", F.avg, length), "_d": std * roll("close", F.stddev_pop, length), "_w": roll("_tr", F.avg, length), "_mom": diff("close", momentum)})
    df = df.withColumn("SQZ", roll("_mom", F.avg, smooth))
    for x in widths:
        inside, outside = _flag(c("_d") < x * c("_w")), _flag(c("_d") > x * c("_w"))
        df = df.withColumns({f"SQZ_ON_{x:g}": inside, f"SQZ_OFF_{x:g}": outside, f"SQZ_NO_{x:g}": 1 - inside - outside})
    return df.drop("_tr", "_m", "_d", "_w", "_mom")


def squeeze_pro(df: DataFrame, length: int = 20) -> DataFrame:
    return squeeze(df, length, widths=(2.0, 1.5, 1.0))


def archer_trends(df: DataFrame, fast: int = 8, slow: int = 21, lookback: int = 2) -> DataFrame:
    df = runs(_ma(df, [("_f", "close", fast), ("_s", "close", slow)]), "_f", "_s", lookback)
    return df.withColumns({f"AMATl_{fast}_{slow}": c(f"LR_{lookback}"), f"AMATs_{fast}_{slow}": c(f"SR_{lookback}")}).drop("_f", "_s", f"LR_{lookback}", f"SR_{lookback}")


def random_walk(df: DataFrame, length: int = 14) -> DataFrame:
    df = atr(df, length)
    d = c(f"ATRr_{length}") * math.sqrt(length)
    return df.withColumns({f"RWIh_{length}": ratio(c("high") - lag("low", length), d), f"RWIl_{length}": ratio(lag("high", length) - c("low"), d)}).drop(f"ATRr_{length}", f"NATR_{length}")


def klinger(df: DataFrame, fast: int = 34, slow: int = 55, signal: int = 13) -> DataFrame:
    """Difference of two means of the volume signed by the typical price's change; the first bar counts as a fall."""
    df = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3).withColumn("_v", F.signum(diff("_tp")) * c("volume"))
    df = df.withColumn("_v", F.coalesce("_v", -c("volume")))
    means = [(name, "_v", 2 / (n + 1), n, "sma") for name, n in (("_f", fast), ("_s", slow))]
    df = ewm(df, [*means, (f"KVOs_{fast}_{slow}", ("_f", "_s"), 2 / (signal + 1), signal, "counted")])
    return df.withColumn(f"KVO_{fast}_{slow}", c("_f") - c("_s")).drop("_tp", "_v", "_f", "_s")


def archer_volume(df: DataFrame, fast: int = 4, slow: int = 12, lookback: int = 2) -> DataFrame:
    df = df.withColumn("_g", F.coalesce(F.signum(diff("close")), F.lit(1.0)) * c("volume")).withColumn("_o", F.sum("_g").over(so_far()))
    df = runs(_ma(df, [("_f", "_o", fast), ("_s", "_o", slow)]), "_f", "_s", lookback)
    return df.withColumns({f"AOBVf_{fast}": c("_f"), f"AOBVs_{slow}": c("_s"), f"AOBVl_{lookback}": c(f"LR_{lookback}"), f"AOBVd_{lookback}": c(f"SR_{lookback}")}).drop("_g", "_o", "_f", "_s", f"LR_{lookback}", f"SR_{lookback}")


def vidya(df: DataFrame, length: int = 14) -> DataFrame:
    """Mean whose weight follows the momentum oscillator of the last bars: a recurrence with a varying weight."""
    df = df.withColumn("_d", diff("close")).withColumns({"_i": F.row_number().over(by_time()), "_u": F.when(c("_d") > 0, c("_d")).when(c("_d").isNotNull(), 0.0), "_n": F.when(c("_d") < 0, -c("_d")).when(c("_d").isNotNull(), 0.0)})
    up, down = roll("_u", F.sum, length), roll("_n", F.sum, length)
    df = df.withColumn("_k", F.coalesce(F.abs(ratio(up - down, up + down)), F.lit(0.0)) * (2 / (length + 1)))
    a, b = F.when(c("_i") <= length, 0.0).otherwise(1 - c("_k")), F.when(c("_i") <= length, 0.0).otherwise(c("_k") * c("close"))
    df = linear_scan(df.withColumns({"_a": a, "_b": b}), {"_y": (c("_a"), c("_b"))})
    return df.withColumn(f"VIDYA_{length}", F.when(c("_i") > length, c("_y"))).drop("_d", "_i", "_u", "_n", "_k", "_a", "_b", "_y")


# --- carried states


def _scan(df: DataFrame, names: list[str], columns: list[str], step: Callable) -> DataFrame:
    made = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return scan_state(df, lambda: None, step, columns, made)


def _known(x: float | None) -> bool:
    return x is not None and x == x


def hilo(df: DataFrame, high_length: int = 13, low_length: int = 21) -> DataFrame:
    """The mean of lows once the close is over the mean of highs before, the mean of highs once it is under that of lows, held between."""
    df = df.withColumns({"_h": roll("high", F.avg, high_length), "_l": roll("low", F.avg, low_length)})

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        close, h, lo = row
        held, h1, l1 = state or (None, None, None)
        if _known(h1) and close > h1:
            held = lo
        elif _known(l1) and close < l1:
            held = h
        return (held, h, lo), (held,)

    return _scan(df, [f"HILO_{high_length}_{low_length}"], ["close", "_h", "_l"], step).drop("_h", "_l")


def mcginley(df: DataFrame, length: int = 10, k: float = 1.0) -> DataFrame:
    """McGinley's dynamic on the pair of the last two closes."""
    x, y = lag("close"), c("close")
    return df.withColumn(f"MCGD_{length}", x + ratio(y - x, k * length * F.pow(ratio(y, x), 4)))


def fisher(df: DataFrame, length: int = 9, signal: int = 1) -> DataFrame:
    """Fisher transform of the mid price's place in its range."""
    df = df.withColumn("_m", (c("high") + c("low")) / 2)
    lo, hi = roll("_m", F.min, length), roll("_m", F.max, length)
    df = df.withColumn("_p", (c("_m") - lo) / F.greatest(F.lit(0.001), hi - lo) - 0.5)

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
        (place,) = row
        if not _known(place):
            return state, (None,)
        if state is None:
            return (0.0, 0.0), (0.0,)
        v, last = state
        v = 0.66 * place + 0.67 * v
        v = -0.999 if v < -0.99 else 0.999 if v > 0.99 else v
        out = 0.5 * (math.log((1 + v) / (1 - v)) + last)
        return (v, out), (out,)

    df = _scan(df, [f"FISHERT_{length}"], ["_p"], step)
    return df.withColumn(f"FISHERTs_{length}", lag(f"FISHERT_{length}", signal)).drop("_m", "_p")


def holt_winter(df: DataFrame, na: float = 0.2, nb: float = 0.1, nc: float = 0.1, nd: float = 0.1, width: float = 1.0) -> DataFrame:
    """Holt-Winter mean and channel: level, speed and acceleration carried from bar to bar, and the variance of the last misses."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (x,) = row
        f, v, a, var, price, shown = state or (x, 0.0, 0.0, 0.0, x, x)
        f1 = (1 - na) * (f + v + 0.5 * a) + na * x
        v1 = (1 - nb) * (v + a) + nb * (f1 - f)
        a1 = (1 - nc) * a + nc * (v1 - v)
        out, wide = f1 + v1 + 0.5 * a1, width * math.sqrt(var)
        return (f1, v1, a1, (1 - nd) * var + nd * (price - shown) ** 2, x, out), (out, out - wide, out + wide)

    return _scan(df, ["HWMA", "HWL", "HWU"], ["close"], step)


def super_smoother(df: DataFrame, length: int = 20) -> DataFrame:
    """Two- and three-pole smoothers; their first values are the closes."""
    a = math.exp(-math.pi * math.sqrt(2) / length)
    b = 2 * a * math.cos(math.pi * math.sqrt(2) / length)
    e = math.exp(-math.pi / length)
    g, h = 2 * e * math.cos(-math.pi * math.sqrt(3) / length), e * e
    d2, d3, d4 = g + h, -h * (1 + g), h * h

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (x,) = row
        n, x1, y1, y2, z1, z2, z3 = state or (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        y = x if n < 2 else 0.5 * (a * a - b + 1) * (x + x1) + b * y1 - a * a * y2
        z = x if n < 3 else (1 - d2 - d3 - d4) * x + d2 * z1 + d3 * z2 + d4 * z3
        return (n + 1, x, y, y1, z, z1, z2), (y, z)

    return _scan(df, [f"SSF_{length}", f"SSF3_{length}"], ["close"], step)


def decay(df: DataFrame, length: int = 1) -> DataFrame:
    """The close, or what is left of the value before after losing a share 1 / length (linear), or a factor (exponential), if more."""
    rate = 1 / length
    keep = 1 - math.exp(-length)

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (x,) = row
        lin, ex = (x, x) if state is None else (max(x, state[0] - rate, 0.0), max(x, state[1] - keep, 0.0))
        return (lin, ex), (lin, ex)

    return _scan(df, [f"LDECAY_{length}", f"EXPDECAY_{length}"], ["close"], step)


def qqe(df: DataFrame, length: int = 14, smooth: int = 5, factor: float = 4.236) -> DataFrame:
    """Smoothed strength index with trailing lines on both sides, and the one on the trend's side."""
    n = 2 * length - 1
    df = _ma(rsi(df, length), [("_m", f"RSI_{length}", smooth)]).withColumn("_t", F.abs(diff("_m")))
    df = _ma(df, [("_s", "_t", n), ("_w", "_s", n)]).withColumn("_w", factor * c("_w"))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        x, w = row
        if not _known(x) or not _known(w):
            return (x, None, None, None, None, 1), (None, None)
        x1, long1, short1, long2, short2, side = state or (None, None, None, None, None, 1)
        long, short = x - w, x + w
        if _known(x1) and _known(long1):
            if x1 > long1 and x > long1:
                long = max(long, long1)
            if x1 < short1 and x < short1:
                short = min(short, short1)
            if x > short1 and (short2 is None or x1 <= short2):
                side = 1
            elif x < long1 and (long2 is None or x1 >= long2):
                side = -1
        return (x, long, short, long1, short1, side), (long if side > 0 else short, float(side))

    return _scan(df, [f"QQE_{length}", f"QQEd_{length}"], ["_m", "_w"], step).withColumn(f"QQEm_{length}", c("_m")).drop("_m", "_t", "_s", "_w", f"RSI_{length}")


MORE: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        gravity, correlation_trend, regression_angle, fast_stoch, brar, price_distance, ease_of_movement, volume_indexes, volume_heat, time_segmented_volume, vwap, exhaustion, imbalances, candle_scores, detrended, remap, cube,
        inverse_fisher, deviation_lines, percent_rank, true_momentum, more_pivots, smma, alligator, t3, zero_lag, ppo, tsi, smi, pretty_good, elder_ray, kdj, stoch_rsi, connors_rsi, relative_volatility, inertia, thermometer,
        aberration, chandelier, kroll_stops, squeeze, squeeze_pro, archer_trends, random_walk, klinger, archer_volume, vidya, hilo, mcginley, fisher, holt_winter, super_smoother, decay, qqe,
    )
}
