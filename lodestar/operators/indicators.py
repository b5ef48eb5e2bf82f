"""Technical indicators per symbol.

Each takes bars and adds columns named after itself and its parameters.  Those on windows are
built from the same partitioning and order, so a study of many needs one shuffle and one sort;
those on recurrences go through ``linear_scan``, all of a stage in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scan import ewm, scan_state
from lodestar.functions.windows import by_time, so_far, diff, ffill, kernel, lag, last_n, ratio, roll

c = F.col
_TINY = 2.220446049250313e-16  # the double's epsilon, put in place of a zero range


def _nonzero(x: Column) -> Column:
    return F.when(x == 0, F.lit(_TINY)).otherwise(x)


def price_mixes(df: DataFrame) -> DataFrame:
    o, h, lo, cl = (c(x) for x in ("open", "high", "low", "close"))
    return df.withColumns({"HL2": (h + lo) / 2, "HLC3": (h + lo + cl) / 3, "OHLC4": (o + h + lo + cl) / 4, "WCP": (h + lo + cl * 2) / 4})


def sma(df: DataFrame, length: int = 10, col: str = "close") -> DataFrame:
    return df.withColumn(f"SMA_{length}", roll(col, F.avg, length))


def midpoint(df: DataFrame, length: int = 2) -> DataFrame:
    return df.withColumn(f"MIDPOINT_{length}", (roll("close", F.min, length) + roll("close", F.max, length)) / 2)


def midprice(df: DataFrame, length: int = 2) -> DataFrame:
    return df.withColumn(f"MIDPRICE_{length}", (roll("low", F.min, length) + roll("high", F.max, length)) / 2)


def trima(df: DataFrame, length: int = 10) -> DataFrame:
    half = round(0.5 * (length + 1))
    return df.withColumn("_t", roll("close", F.avg, half)).withColumn(f"TRIMA_{length}", roll("_t", F.avg, half)).drop("_t")


def vwma(df: DataFrame, length: int = 10) -> DataFrame:
    return df.withColumn(f"VWMA_{length}", ratio(roll(c("close") * c("volume"), F.avg, length), roll("volume", F.avg, length)))


def rolling_median(df: DataFrame, length: int = 30) -> DataFrame:
    return df.withColumn(f"MEDIAN_{length}", roll("close", lambda x: F.percentile(x, 0.5), length))


def rolling_quantile(df: DataFrame, length: int = 30, q: float = 0.25) -> DataFrame:
    return df.withColumn(f"QTL_{length}_{round(q * 100)}", roll("close", lambda x: F.percentile(x, q), length))


def variance(df: DataFrame, length: int = 30) -> DataFrame:
    return df.withColumn(f"VAR_{length}", roll("close", F.var_samp, length))


def stdev(df: DataFrame, length: int = 30) -> DataFrame:
    return df.withColumn(f"STDEV_{length}", roll("close", F.stddev_samp, length))


def zscore(df: DataFrame, length: int = 30) -> DataFrame:
    return df.withColumn(f"ZS_{length}", ratio(c("close") - roll("close", F.avg, length), roll("close", F.stddev_samp, length)))


def skew(df: DataFrame, length: int = 30) -> DataFrame:
    """The unbiased form, from the population skewness."""
    n = float(length)
    return df.withColumn(f"SKEW_{length}", roll("close", F.skewness, length) * math.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(df: DataFrame, length: int = 30) -> DataFrame:
    """The unbiased excess form, from the population kurtosis."""
    n = float(length)
    return df.withColumn(f"KURT_{length}", (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * roll("close", F.kurtosis, length) + 6))


def mad(df: DataFrame, length: int = 30) -> DataFrame:
    """Mean absolute deviation from the frame's mean."""
    frame = last_n(length)
    df = df.withColumns({"_v": F.collect_list("close").over(frame), "_m": F.avg("close").over(frame)})
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + F.abs(x - c("_m")))
    return df.withColumn(f"MAD_{length}", F.when(F.size("_v") == length, total / length)).drop("_v", "_m")


def entropy(df: DataFrame, length: int = 10) -> DataFrame:
    df = df.withColumn("_p", ratio(c("close"), F.sum("close").over(last_n(length))))
    return df.withColumn("_p", -c("_p") * F.log2("_p")).withColumn(f"ENTP_{length}", roll("_p", F.sum, length)).drop("_p")


def qstick(df: DataFrame, length: int = 10) -> DataFrame:
    return df.withColumn(f"QS_{length}", roll(c("close") - c("open"), F.avg, length))


def wma(df: DataFrame, length: int = 10, col: str = "close", name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"WMA_{length}", kernel(col, [float(i + 1) for i in range(length)]))


def hma(df: DataFrame, length: int = 10) -> DataFrame:
    df = wma(wma(df, length // 2, name="_h"), length, name="_w").withColumn("_d", 2 * c("_h") - c("_w"))
    return wma(df, int(math.sqrt(length)), "_d", f"HMA_{length}").drop("_h", "_w", "_d")


def fwma(df: DataFrame, length: int = 10) -> DataFrame:
    weights = [1.0, 1.0]
    while len(weights) < length:
        weights.append(weights[-1] + weights[-2])
    return df.withColumn(f"FWMA_{length}", kernel("close", weights[:length]))


def pwma(df: DataFrame, length: int = 10) -> DataFrame:
    return df.withColumn(f"PWMA_{length}", kernel("close", [float(math.comb(length - 1, i)) for i in range(length)]))


def sinwma(df: DataFrame, length: int = 14) -> DataFrame:
    return df.withColumn(f"SINWMA_{length}", kernel("close", [math.sin((i + 1) * math.pi / (length + 1)) for i in range(length)]))


def swma(df: DataFrame, length: int = 10) -> DataFrame:
    return df.withColumn(f"SWMA_{length}", kernel("close", [float(min(i + 1, length - i)) for i in range(length)]))


def alma(df: DataFrame, length: int = 9, sigma: float = 6.0, offset: float = 0.85) -> DataFrame:
    m, s = offset * (length - 1), length / sigma
    return df.withColumn(f"ALMA_{length}", kernel("close", [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(length)]))


def linreg(df: DataFrame, length: int = 14) -> DataFrame:
    """Least squares over the last rows: the line's end, slope, intercept, correlation and the next value."""
    xs = range(1, length + 1)
    sx, sxx = float(sum(xs)), float(sum(x * x for x in xs))
    d = length * sxx - sx * sx
    df = df.withColumns({"_y": roll("close", F.sum, length), "_yy": roll(c("close") * c("close"), F.sum, length), "_xy": kernel("close", [float(x) for x in xs]) * sx})
    m = (length * c("_xy") - sx * c("_y")) / d
    b = (c("_y") * sxx - sx * c("_xy")) / d
    r = ratio(length * c("_xy") - sx * c("_y"), F.sqrt(F.greatest(F.lit(0.0), d * (length * c("_yy") - c("_y") * c("_y")))))
    return df.withColumns({f"LR_{length}": m * length + b, f"LRm_{length}": m, f"LRb_{length}": b, f"LRr_{length}": r, f"TSF_{length}": m * (length + 1) + b}).drop("_y", "_yy", "_xy")


def coppock(df: DataFrame, length: int = 10, fast: int = 11, slow: int = 14) -> DataFrame:
    grow = lambda n: ratio(diff("close", n), lag("close", n)) * 100
    return wma(df.withColumn("_s", grow(fast) + grow(slow)), length, "_s", f"COPC_{fast}_{slow}_{length}").drop("_s")


def momentum(df: DataFrame, length: int = 10) -> DataFrame:
    return df.withColumns({f"MOM_{length}": diff("close", length), f"ROC_{length}": ratio(diff("close", length), lag("close", length)) * 100})


def bias(df: DataFrame, length: int = 26) -> DataFrame:
    return df.withColumn(f"BIAS_SMA_{length}", ratio(c("close"), roll("close", F.avg, length)) - 1)


def change(df: DataFrame, length: int = 1) -> DataFrame:
    first = F.first("close").over(so_far())
    return df.withColumns({f"SLOPE_{length}": diff("close", length) / length, f"PCTRET_{length}": ratio(c("close"), lag("close", length)) - 1, f"LOGRET_{length}": F.ln(ratio(c("close"), lag("close", length))), "CUMPCTRET": ratio(c("close"), first) - 1, "CUMLOGRET": F.ln(ratio(c("close"), first))})


def willr(df: DataFrame, length: int = 14) -> DataFrame:
    lo, hi = roll("low", F.min, length), roll("high", F.max, length)
    return df.withColumn(f"WILLR_{length}", 100 * (ratio(c("close") - lo, hi - lo) - 1))


def stoch(df: DataFrame, k: int = 14, d: int = 3, smooth: int = 3) -> DataFrame:
    lo, hi = roll("low", F.min, k), roll("high", F.max, k)
    df = df.withColumn("_k", 100 * (c("close") - lo) / _nonzero(hi - lo))
    df = df.withColumn(f"STOCHk_{k}_{d}_{smooth}", roll("_k", F.avg, smooth))
    return df.withColumn(f"STOCHd_{k}_{d}_{smooth}", roll(f"STOCHk_{k}_{d}_{smooth}", F.avg, d)).drop("_k")


def donchian(df: DataFrame, lower: int = 20, upper: int = 20) -> DataFrame:
    lo, hi = roll("low", F.min, lower), roll("high", F.max, upper)
    return df.withColumns({f"DCL_{lower}_{upper}": lo, f"DCM_{lower}_{upper}": (lo + hi) / 2, f"DCU_{lower}_{upper}": hi})


def vhf(df: DataFrame, length: int = 28) -> DataFrame:
    df = df.withColumn("_d", F.abs(diff("close")))
    return df.withColumn(f"VHF_{length}", ratio(F.abs(roll("close", F.max, length) - roll("close", F.min, length)), roll("_d", F.sum, length))).drop("_d")


def aroon(df: DataFrame, length: int = 14) -> DataFrame:
    """Bars since the latest high and low of the last length + 1, as percentages."""
    df = df.withColumn("_i", F.row_number().over(by_time()))
    frame = last_n(length + 1)
    full = F.count("high").over(frame) == length + 1
    up = c("_i") - F.max_by("_i", F.struct("high", "_i")).over(frame)
    down = c("_i") - F.max_by("_i", F.struct(-c("low"), "_i")).over(frame)
    df = df.withColumns({f"AROONU_{length}": F.when(full, 100 * (1 - up / length)), f"AROOND_{length}": F.when(full, 100 * (1 - down / length))})
    return df.withColumn(f"AROONOSC_{length}", c(f"AROONU_{length}") - c(f"AROOND_{length}")).drop("_i")


def bop(df: DataFrame) -> DataFrame:
    return df.withColumn("BOP", (c("close") - c("open")) / _nonzero(c("high") - c("low")))


def psl(df: DataFrame, length: int = 12) -> DataFrame:
    df = df.withColumn("_u", F.coalesce((diff("close") > 0).cast("double"), F.lit(0.0)))
    return df.withColumn(f"PSL_{length}", 100 * roll("_u", F.sum, length) / length).drop("_u")


def ultimate(df: DataFrame, fast: int = 7, medium: int = 14, slow: int = 28) -> DataFrame:
    before = lag("close")
    df = df.withColumns({"_lo": F.least("low", before), "_hi": F.greatest("high", before), "_p": before})
    df = df.withColumns({"_bp": F.when(c("_p").isNotNull(), c("close") - c("_lo")), "_tr": F.when(c("_p").isNotNull(), c("_hi") - c("_lo"))})
    mean = lambda n: ratio(roll("_bp", F.sum, n), roll("_tr", F.sum, n))
    return df.withColumn(f"UO_{fast}_{medium}_{slow}", 100 * (4 * mean(fast) + 2 * mean(medium) + mean(slow)) / 7).drop("_lo", "_hi", "_p", "_bp", "_tr")


def awesome(df: DataFrame, fast: int = 5, slow: int = 34) -> DataFrame:
    mid = (c("high") + c("low")) / 2
    return df.withColumn(f"AO_{fast}_{slow}", roll(mid, F.avg, fast) - roll(mid, F.avg, slow))


def apo(df: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    return df.withColumn(f"APO_{fast}_{slow}", roll("close", F.avg, fast) - roll("close", F.avg, slow))


def efficiency(df: DataFrame, length: int = 10) -> DataFrame:
    df = df.withColumn("_d", F.abs(diff("close")))
    return df.withColumn(f"ER_{length}", ratio(F.abs(diff("close", length)), roll("_d", F.sum, length))).drop("_d")


def cci(df: DataFrame, length: int = 14, scale: float = 0.015) -> DataFrame:
    frame = last_n(length)
    df = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    df = df.withColumns({"_v": F.collect_list("_tp").over(frame), "_m": F.avg("_tp").over(frame)})
    spread = F.aggregate("_v", F.lit(0.0), lambda a, x: a + F.abs(x - c("_m"))) / length
    return df.withColumn(f"CCI_{length}", F.when(F.size("_v") == length, ratio(c("_tp") - c("_m"), scale * spread))).drop("_tp", "_v", "_m")


def true_range(df: DataFrame, name: str = "TRUERANGE") -> DataFrame:
    before = lag("close")
    return df.withColumn(name, F.when(before.isNotNull(), F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))))


def bbands(df: DataFrame, length: int = 5, std: float = 2.0) -> DataFrame:
    mid, dev = roll("close", F.avg, length), roll("close", F.stddev_pop, length)
    df = df.withColumns({f"BBL_{length}": mid - std * dev, f"BBM_{length}": mid, f"BBU_{length}": mid + std * dev})
    lo, mi, up = (c(f"BB{x}_{length}") for x in "LMU")
    return df.withColumns({f"BBB_{length}": 100 * ratio(up - lo, mi), f"BBP_{length}": ratio(c("close") - lo, _nonzero(up - lo))})


def accbands(df: DataFrame, length: int = 20, width: float = 4.0) -> DataFrame:
    share = width * ratio(c("high") - c("low"), c("high") + c("low"))
    return df.withColumns({f"ACCBL_{length}": roll(c("low") * (1 - share), F.avg, length), f"ACCBM_{length}": roll("close", F.avg, length), f"ACCBU_{length}": roll(c("high") * (1 + share), F.avg, length)})


def vortex(df: DataFrame, length: int = 14) -> DataFrame:
    df = true_range(df, "_tr").withColumns({"_p": F.abs(c("high") - lag("low")), "_m": F.abs(c("low") - lag("high"))})
    total = roll("_tr", F.sum, length)
    return df.withColumns({f"VTXP_{length}": ratio(roll("_p", F.sum, length), total), f"VTXM_{length}": ratio(roll("_m", F.sum, length), total)}).drop("_tr", "_p", "_m")


def ulcer(df: DataFrame, length: int = 14) -> DataFrame:
    df = df.withColumn("_d", 100 * (ratio(c("close"), roll("close", F.max, length)) - 1))
    return df.withColumn(f"UI_{length}", F.sqrt(roll(c("_d") * c("_d"), F.sum, length) / length)).drop("_d")


def volume_lines(df: DataFrame) -> DataFrame:
    """Accumulation/distribution, on-balance volume, price-volume trend, price-volume and its rank."""
    share = (2 * c("close") - c("high") - c("low")) / _nonzero(c("high") - c("low"))
    df = df.withColumns({"_ad": share * c("volume"), "_s": F.coalesce(F.signum(diff("close")), F.lit(1.0)) * c("volume"), "_pvt": ratio(diff("close"), lag("close")) * 100 * c("volume"), "_dc": diff("close"), "_dv": diff("volume")})
    rank = F.when((c("_dc") >= 0) & (c("_dv") >= 0), 1).when((c("_dc") >= 0) & (c("_dv") < 0), 2).when((c("_dc") < 0) & (c("_dv") >= 0), 3).when((c("_dc") < 0) & (c("_dv") < 0), 4)
    return df.withColumns({"AD": F.sum("_ad").over(so_far()), "OBV": F.sum("_s").over(so_far()), "PVT": F.sum("_pvt").over(so_far()), "PVOL": c("close") * c("volume"), "PVR": rank}).drop("_ad", "_s", "_pvt", "_dc", "_dv")


def cmf(df: DataFrame, length: int = 20) -> DataFrame:
    share = (2 * c("close") - c("high") - c("low")) / _nonzero(c("high") - c("low"))
    return df.withColumn(f"CMF_{length}", ratio(roll(share * c("volume"), F.sum, length), roll("volume", F.sum, length)))


def mfi(df: DataFrame, length: int = 14) -> DataFrame:
    df = df.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    df = df.withColumns({"_d": diff("_tp"), "_f": c("_tp") * c("volume")})
    df = df.withColumns({"_up": F.when(c("_d") > 0, c("_f")).when(c("_d").isNotNull(), 0.0), "_dn": F.when(c("_d") < 0, c("_f")).when(c("_d").isNotNull(), 0.0)})
    up, dn = roll("_up", F.sum, length), roll("_dn", F.sum, length)
    return df.withColumn(f"MFI_{length}", 100 * ratio(up, up + dn)).drop("_tp", "_d", "_f", "_up", "_dn")


def flags(df: DataFrame, length: int = 1) -> DataFrame:
    """Rising and falling closes, doji-like bodies, inside bars and the candle's colour."""
    body, span = F.abs(c("close") - c("open")), c("high") - c("low")
    return df.withColumns({
        f"INC_{length}": F.coalesce((diff("close", length) > 0).cast("int"), F.lit(0)), f"DEC_{length}": F.coalesce((diff("close", length) < 0).cast("int"), F.lit(0)),
        "CDL_DOJI": F.coalesce((body < 0.1 * roll(span, F.avg, 10)).cast("int"), F.lit(0)), "CDL_INSIDE": F.coalesce(((c("high") < lag("high")) & (c("low") > lag("low"))).cast("int"), F.lit(0)),
        "COLOR": F.when(c("close") >= c("open"), 1).otherwise(-1),
    })


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52, lookahead: bool = False) -> DataFrame:
    mid = lambda n: (roll("high", F.max, n) + roll("low", F.min, n)) / 2
    df = df.withColumns({f"ITS_{tenkan}": mid(tenkan), f"IKS_{kijun}": mid(kijun), "_b": mid(senkou)})
    df = df.withColumns({f"ISA_{tenkan}": lag((c(f"ITS_{tenkan}") + c(f"IKS_{kijun}")) / 2, kijun - 1), f"ISB_{kijun}": lag("_b", kijun - 1)})
    return (df.withColumn(f"ICS_{kijun}", F.lead("close", kijun - 1).over(by_time())) if lookahead else df).drop("_b")


def pivots(df: DataFrame, method: str = "traditional", anchor: str = "month") -> DataFrame:
    """Pivot, supports and resistances from the bars of the period before."""
    period = F.date_trunc(anchor, "ts")
    bars = df.groupBy("symbol", period.alias("_period")).agg(F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "ts").alias("_c"))
    w = Window.partitionBy("symbol").orderBy("_period")
    bars = bars.select("symbol", "_period", *(F.lag(x).over(w).alias(x) for x in ("_h", "_l", "_c")))
    h, lo, cl = c("_h"), c("_l"), c("_c")
    p = (h + lo + cl) / 3
    steps = {"traditional": (2 * p - lo, p + (h - lo), 2 * p - h, p - (h - lo)), "fibonacci": (p + 0.382 * (h - lo), p + 0.618 * (h - lo), p - 0.382 * (h - lo), p - 0.618 * (h - lo)), "camarilla": (cl + (h - lo) * 1.1 / 12, cl + (h - lo) * 1.1 / 6, cl - (h - lo) * 1.1 / 12, cl - (h - lo) * 1.1 / 6)}[method]
    out = df.withColumn("_period", period).join(bars, ["symbol", "_period"], "left")
    return out.withColumns({"PIVOT": p, "R1": steps[0], "R2": steps[1], "S1": steps[2], "S2": steps[3]}).drop("_period", "_h", "_l", "_c")


def ema(df: DataFrame, length: int = 10, col: str = "close", name: str | None = None) -> DataFrame:
    return ewm(df, [(name or f"EMA_{length}", col, 2 / (length + 1), length, "sma")])


def rma(df: DataFrame, length: int = 10, col: str = "close", name: str | None = None) -> DataFrame:
    return ewm(df, [(name or f"RMA_{length}", col, 1 / length, length, "first")])


def dema(df: DataFrame, length: int = 10) -> DataFrame:
    df = ewm(df, [(y, x, 2 / (length + 1), length, "sma") for x, y in (("close", "_e1"), ("_e1", "_e2"))])
    return df.withColumn(f"DEMA_{length}", 2 * c("_e1") - c("_e2")).drop("_e1", "_e2")


def tema(df: DataFrame, length: int = 10) -> DataFrame:
    df = ewm(df, [(y, x, 2 / (length + 1), length, "sma") for x, y in (("close", "_e1"), ("_e1", "_e2"), ("_e2", "_e3"))])
    return df.withColumn(f"TEMA_{length}", 3 * (c("_e1") - c("_e2")) + c("_e3")).drop("_e1", "_e2", "_e3")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    tag = f"{fast}_{slow}_{signal}"
    # the signal line starts with the mean of the first differences
    df = ewm(df, [("_f", "close", 2 / (fast + 1), fast, "sma"), ("_s", "close", 2 / (slow + 1), slow, "sma"), (f"MACDs_{tag}", ("_f", "_s"), 2 / (signal + 1), signal, "counted")])
    return df.withColumn(f"MACD_{tag}", c("_f") - c("_s")).withColumn(f"MACDh_{tag}", c(f"MACD_{tag}") - c(f"MACDs_{tag}")).drop("_f", "_s")


def rsi(df: DataFrame, length: int = 14) -> DataFrame:
    d = diff("close")
    df = df.withColumns({"_u": F.when(d > 0, d).when(d.isNotNull(), 0.0), "_d": F.when(d < 0, -d).when(d.isNotNull(), 0.0)})
    df = ewm(df, [("_ru", "_u", 1 / length, length, "first"), ("_rd", "_d", 1 / length, length, "first")])
    return df.withColumn(f"RSI_{length}", 100 * ratio(c("_ru"), c("_ru") + c("_rd"))).drop("_u", "_d", "_ru", "_rd")


def atr(df: DataFrame, length: int = 14) -> DataFrame:
    """Mean true range, smoothed by 1 / length from the plain mean of the first ``length`` ranges on."""
    df = ewm(true_range(df, "_tr"), [(f"ATRr_{length}", "_tr", 1 / length, length, "counted")])
    return df.withColumn(f"NATR_{length}", 100 * ratio(c(f"ATRr_{length}"), c("close"))).drop("_tr")


def adx(df: DataFrame, length: int = 14) -> DataFrame:
    up, down = diff("high"), -diff("low")
    df = atr(df, length).withColumns({"_p": F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0), "_q": F.when((down > up) & (down > 0), down).when(up.isNotNull(), 0.0)})
    df = ewm(df, [("_rp", "_p", 1 / length, length, "first"), ("_rq", "_q", 1 / length, length, "first")])
    df = df.withColumns({f"DMP_{length}": 100 * ratio(c("_rp"), c(f"ATRr_{length}")), f"DMN_{length}": 100 * ratio(c("_rq"), c(f"ATRr_{length}"))})
    p, q = c(f"DMP_{length}"), c(f"DMN_{length}")
    df = df.withColumn("_dx", 100 * ratio(F.abs(p - q), p + q))
    return ewm(df, [(f"ADX_{length}", "_dx", 1 / length, length, "first")]).drop("_p", "_q", "_rp", "_rq", "_dx", f"ATRr_{length}", f"NATR_{length}")


def keltner(df: DataFrame, length: int = 20, scalar: float = 2.0) -> DataFrame:
    df = true_range(df, "_tr")
    df = ewm(df, [("_b", "close", 2 / (length + 1), length, "sma"), ("_w", "_tr", 2 / (length + 1), length, "sma")])
    return df.withColumns({f"KCL_{length}": c("_b") - scalar * c("_w"), f"KCB_{length}": c("_b"), f"KCU_{length}": c("_b") + scalar * c("_w")}).drop("_tr", "_b", "_w")


def heikin_ashi(df: DataFrame) -> DataFrame:
    """Averaged candles; the open is half of the open and close before."""
    from lodestar.functions.scan import linear_scan

    df = df.withColumn("HA_close", (c("open") + c("high") + c("low") + c("close")) / 4)
    before = lag("HA_close")
    df = df.withColumn("_b", F.when(before.isNull(), (c("open") + c("close")) / 2).otherwise(before / 2)).withColumn("_a", F.when(before.isNull(), 0.0).otherwise(0.5))
    df = linear_scan(df, {"HA_open": (c("_a"), c("_b"))}).drop("_a", "_b")
    return df.withColumns({"HA_high": F.greatest("HA_open", "HA_close", "high"), "HA_low": F.least("HA_open", "HA_close", "low")})


def band_start() -> tuple:
    return (None, None, 1)


def band_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """Bands ``span`` around the mid price: the one on the trend's side only tightens until the close breaks it."""
    lower, upper, side = state
    mid, span, close = row
    if span is None or span != span:
        return state, (None, None)
    lo, up = mid - span, mid + span
    if upper is not None and close > upper:
        side = 1  # a broken band starts anew
    elif upper is not None and close < lower:
        side = -1
    elif upper is not None and side > 0:
        lo = max(lo, lower)
    elif upper is not None:
        up = min(up, upper)
    return (lo, up, side), (lo if side > 0 else up, side)


def supertrend(df: DataFrame, length: int = 7, multiplier: float = 3.0) -> DataFrame:
    """Bands around the mid price that only tighten until the close breaks them: a carried state."""
    name = f"ATRr_{length}"
    made = T.StructType([T.StructField(f"SUPERT_{length}", T.DoubleType()), T.StructField(f"SUPERTd_{length}", T.LongType())])
    df = atr(df, length).withColumns({"_mid": (c("high") + c("low")) / 2, "_span": multiplier * c(name)})
    return scan_state(df, band_start, band_step, ["_mid", "_span", "close"], made).drop("_mid", "_span", name, f"NATR_{length}")


def psar(df: DataFrame, af: float = 0.02, most: float = 0.2) -> DataFrame:
    """Parabolic stop and reverse."""

    def start() -> None:
        return None

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        high, low = row
        if state is None:
            return (1, low, high, af, high, low), (low, 1)
        side, stop, best, speed, high1, low1 = state
        stop = stop + speed * (best - stop)
        if side > 0:
            stop = min(stop, low1)
            if low < stop:
                return (-1, best, low, af, high, low), (best, -1)
            if high > best:
                best, speed = high, min(most, speed + af)
        else:
            stop = max(stop, high1)
            if high > stop:
                return (1, best, high, af, high, low), (best, 1)
            if low < best:
                best, speed = low, min(most, speed + af)
        return (side, stop, best, speed, high, low), (stop, side)

    made = T.StructType([T.StructField("PSAR", T.DoubleType()), T.StructField("PSARd", T.LongType())])
    return scan_state(df, start, step, ["high", "low"], made)


def kama(df: DataFrame, length: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Adaptive mean: a linear recurrence whose weight is the efficiency ratio's."""
    from lodestar.functions.scan import linear_scan

    df = df.withColumn("_i", F.row_number().over(by_time())).withColumn("_d", F.abs(diff("close")))
    eff = F.coalesce(ratio(F.abs(diff("close", length)), roll("_d", F.sum, length)), F.lit(0.0))
    df = df.withColumn("_sc", (eff * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2)
    a = F.when(c("_i") <= length, 0.0).otherwise(1 - c("_sc"))
    b = F.when(c("_i") < length, 0.0).when(c("_i") == length, c("close")).otherwise(c("_sc") * c("close"))
    df = df.withColumns({"_a": a, "_b": b})
    return linear_scan(df, {"_k": (c("_a"), c("_b"))}).withColumn(f"KAMA_{length}", F.when(c("_i") >= length, c("_k"))).drop("_i", "_d", "_sc", "_a", "_b", "_k")


def ttm_trend(df: DataFrame, length: int = 6) -> DataFrame:
    mean = roll((c("high") + c("low")) / 2, F.avg, length)
    return df.withColumn(f"TTM_TRND_{length}", F.when(c("close") > mean, 1).when(mean.isNotNull(), -1))


def kst(df: DataFrame, rates: tuple[int, ...] = (10, 15, 20, 30), means: tuple[int, ...] = (10, 10, 10, 15), signal: int = 9) -> DataFrame:
    """Weighted sum of smoothed rates of change."""
    total = None
    for k, (r, m) in enumerate(zip(rates, means, strict=True)):
        df = df.withColumn(f"_r{k}", 100 * ratio(diff("close", r), lag("close", r))).withColumn(f"_s{k}", roll(f"_r{k}", F.avg, m))
        total = (k + 1) * c(f"_s{k}") if total is None else total + (k + 1) * c(f"_s{k}")
    df = df.withColumn("KST", total)
    return df.withColumn("KSTs", roll("KST", F.avg, signal)).drop(*(f"_{x}{k}" for k in range(len(rates)) for x in "rs"))


def rvgi(df: DataFrame, length: int = 14) -> DataFrame:
    """Relative vigor: symmetric means of body and range, summed."""
    four = [1.0, 2.0, 2.0, 1.0]
    df = df.withColumns({"_b": kernel(c("close") - c("open"), four), "_g": kernel(c("high") - c("low"), four)})
    df = df.withColumn(f"RVGI_{length}", ratio(roll("_b", F.sum, length), roll("_g", F.sum, length)))
    return df.withColumn(f"RVGIs_{length}", kernel(f"RVGI_{length}", four)).drop("_b", "_g")


def cmo(df: DataFrame, length: int = 14) -> DataFrame:
    df = df.withColumn("_d", diff("close")).withColumns({"_u": F.greatest(F.lit(0.0), c("_d")), "_n": F.greatest(F.lit(0.0), -c("_d"))})
    df = df.withColumns({x: F.when(c("_d").isNotNull(), c(x)) for x in ("_u", "_n")})
    up, down = roll("_u", F.sum, length), roll("_n", F.sum, length)
    return df.withColumn(f"CMO_{length}", 100 * ratio(up - down, up + down)).drop("_d", "_u", "_n")


def chop(df: DataFrame, length: int = 14) -> DataFrame:
    df = true_range(df, "_tr")
    span = roll("high", F.max, length) - roll("low", F.min, length)
    share = ratio(roll("_tr", F.sum, length), span)
    return df.withColumn(f"CHOP_{length}", F.when(share > 0, 100 * F.log10(share) / math.log10(length))).drop("_tr")


def price_volume_ewm(df: DataFrame) -> DataFrame:
    """Elder's force (13), the Chaikin oscillator (3, 10) and the percentage volume oscillator (12, 26)."""
    share = (2 * c("close") - c("high") - c("low")) / _nonzero(c("high") - c("low"))
    df = df.withColumns({"_f": diff("close") * c("volume"), "_v": share * c("volume")}).withColumn("_ad", F.sum("_v").over(so_far()))
    specs = [("EFI_13", "_f", 2 / 14, 13, "sma"), ("_a3", "_ad", 2 / 4, 3, "sma"), ("_a10", "_ad", 2 / 11, 10, "sma"), ("_v12", "volume", 2 / 13, 12, "sma"), ("_v26", "volume", 2 / 27, 26, "sma")]
    df = ewm(df, specs)
    return df.withColumns({"ADOSC_3_10": c("_a3") - c("_a10"), "PVO_12_26": 100 * ratio(c("_v12") - c("_v26"), c("_v26"))}).drop("_f", "_v", "_ad", "_a3", "_a10", "_v12", "_v26")


def trix(df: DataFrame, length: int = 18) -> DataFrame:
    df = ewm(df, [(y, x, 2 / (length + 1), length, "sma") for x, y in (("close", "_e1"), ("_e1", "_e2"), ("_e2", "_e3"))])
    return df.withColumn(f"TRIX_{length}", 100 * (ratio(c("_e3"), lag("_e3")) - 1)).drop("_e1", "_e2", "_e3")


def mass_index(df: DataFrame, fast: int = 9, slow: int = 25) -> DataFrame:
    df = ema(df.withColumn("_g", c("high") - c("low")), fast, "_g", "_e1")
    df = ema(df, fast, "_e1", "_e2").withColumn("_q", ratio(c("_e1"), c("_e2")))
    return df.withColumn(f"MASSI_{fast}_{slow}", roll("_q", F.sum, slow)).drop("_g", "_e1", "_e2", "_q")


INDICATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        price_mixes, sma, midpoint, midprice, trima, vwma, rolling_median, rolling_quantile, variance, stdev, zscore, skew, kurtosis, mad, entropy, qstick, wma, hma, fwma, pwma,
        sinwma, swma, alma, linreg, coppock, momentum, bias, change, willr, stoch, donchian, vhf, aroon, bop, psl, ultimate, awesome, apo, efficiency, cci, true_range, bbands,
        accbands, vortex, ulcer, volume_lines, cmf, mfi, flags, ichimoku, pivots, ema, rma, dema, tema, macd, rsi, atr, adx, keltner, heikin_ashi, supertrend, psar, kama,
        ttm_trend, kst, rvgi, cmo, chop, price_volume_ewm, trix, mass_index,
    )
}


#: Indicators on recurrences, which go through passes of their own.
LATE = {"ema", "rma", "dema", "tema", "macd", "rsi", "atr", "adx", "keltner", "heikin_ashi", "supertrend", "psar", "kama", "pivots", "price_volume_ewm", "trix", "mass_index"}
#: Categories that a study may name in place of single indicators.
CATEGORIES = {
    "overlap": ("sma", "midpoint", "midprice", "trima", "vwma", "wma", "hma", "fwma", "pwma", "sinwma", "swma", "alma", "linreg", "ema", "rma", "dema", "tema", "ichimoku", "supertrend", "kama"),
    "statistics": ("rolling_median", "rolling_quantile", "variance", "stdev", "zscore", "skew", "kurtosis", "mad", "entropy"),
    "momentum": ("momentum", "willr", "stoch", "bop", "psl", "ultimate", "awesome", "apo", "efficiency", "cci", "coppock", "bias", "macd", "rsi", "kst", "rvgi", "cmo", "trix"),
    "volatility": ("true_range", "bbands", "accbands", "ulcer", "atr", "keltner", "donchian", "mass_index"),
    "volume": ("volume_lines", "cmf", "mfi", "price_volume_ewm"),
    "trend": ("vhf", "aroon", "vortex", "adx", "psar", "ttm_trend", "chop", "qstick"),
}


def indicators(bars: DataFrame, specs: list[tuple[str, dict] | str], prefix: str = "", suffix: str = "", columns: list[str] | None = None) -> DataFrame:
    """Bars with all the indicators of a study; window ones first, so that they share one sort.

    A name may be that of a category.  New columns get the prefix and suffix, and of them only
    ``columns`` are kept, if given.
    """
    from lodestar.operators.oscillators import MORE

    known = INDICATORS | MORE
    plain = [(s, {}) if isinstance(s, str) else s for s in specs]
    plain = [x for name, options in plain for x in ([(n, {}) for n in CATEGORIES[name]] if name in CATEGORIES and name not in known else [(name, options)])]
    given = bars.columns
    for name, options in sorted(plain, key=lambda s: s[0] in LATE or s[0] in MORE):
        bars = known[name](bars, **options)
    if prefix or suffix or columns is not None:
        made = [n for n in bars.columns if n not in given and (columns is None or n in columns)]
        bars = bars.select(*given, *(c(f"`{n}`").alias(f"{prefix}{n}{suffix}") for n in made))
    return bars


def hold(entries: Column) -> Column:
    """Signals 1, -1 and 0 held until the next one; flat before the first."""
    return F.coalesce(ffill(entries), F.lit(0))
