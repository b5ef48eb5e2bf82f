"""Whole parameter grids of strategies on recurrences, in one or two passes over the bars however many points they have.

A point's recurrences depend on few of its parameters.  ``prepare`` solves each distinct one of
these once, side by side on the bars; then every point picks its columns and takes its thresholds as
columns, and one plan of windows, keyed by ``(param_id, symbol)``, decides for all points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.windows import diff, lag, ratio, roll
from lodestar.operators import indicators as ta
from lodestar.operators import strategy as st

c = F.col
_OHLC = ("open", "high", "low", "close")


def _distinct(points: Iterable[tuple]) -> list[tuple]:
    return sorted(set(points))


def _spread(df: DataFrame, picks: list[dict[str, Column]]) -> DataFrame:
    """A row of ``df`` for each point, with the columns it picks; ``symbol`` becomes the pair of point and symbol."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("param_id"), *(x.alias(n) for n, x in pick.items())) for k, pick in enumerate(picks))))
    names = [f"g.{n}" for n in picks[0]]
    return df.select("symbol", "ts", *_OHLC, each.alias("g")).select(F.struct("g.param_id", "symbol").alias("symbol"), "ts", *_OHLC, *names)


def _out(df: DataFrame) -> DataFrame:
    return df.select("symbol.param_id", "symbol.symbol", "ts", "close", "signal")


def _filled(points: list[dict], **defaults) -> list[dict]:
    """The points with the defaults of what they leave out; other parameters are refused."""
    for point in points:
        if unknown := set(point) - set(defaults):
            raise TypeError(f"unknown parameters {sorted(unknown)}")
    return [defaults | p for p in points]


def _by_mode(points: list[dict], decide: Callable[[list[int], str], DataFrame]) -> DataFrame:
    """``decide(numbers, mode)`` for the points of each exit mode, united; its points keep the numbers of the whole grid."""
    parts = []
    for mode in sorted({p["exit_mode"] for p in points}):
        numbers = [k for k, p in enumerate(points) if p["exit_mode"] == mode]
        there = F.array(*map(F.lit, numbers))
        parts.append(decide(numbers, mode).withColumn("param_id", F.element_at(there, c("param_id") + 1)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _macd(bars: DataFrame, points: list[dict]) -> tuple[DataFrame, list[dict[str, Column]]]:
    lengths = _distinct((n,) for p in points for n in (p["fast"], p["slow"]))
    lines = _distinct((p["fast"], p["slow"], p["signal"]) for p in points)
    specs = [(f"_e{n}", "close", 2 / (n + 1), n, "sma") for (n,) in lengths]
    specs += [(f"_g{f}_{s}_{g}", (f"_e{f}", f"_e{s}"), 2 / (g + 1), g, "counted") for f, s, g in lines]
    picks = [{"_m": c(f"_e{p['fast']}") - c(f"_e{p['slow']}"), "_g": c(f"_g{p['fast']}_{p['slow']}_{p['signal']}")} for p in points]
    return ta.ewm(bars, specs), picks


def macd_trend(bars: DataFrame, points: list[dict]) -> DataFrame:
    points = _filled(points, fast=12, slow=26, signal=9, exit_mode="row")
    wide, picks = _macd(bars, points)
    return _by_mode(points, lambda ks, mode: _out(st.macd_trend_sides(_spread(wide, [picks[k] for k in ks]), mode)))


def macd_reversal(bars: DataFrame, points: list[dict]) -> DataFrame:
    points = _filled(points, fast=12, slow=26, signal=9, middle=0.0, exit_mode="row")
    wide, picks = _macd(bars, points)
    picks = [pick | {"_mid": F.lit(float(p["middle"]))} for pick, p in zip(picks, points, strict=True)]
    return _by_mode(points, lambda ks, mode: _out(st.macd_reversal_sides(_spread(wide, [picks[k] for k in ks]), c("_mid"), mode)))


def _strengths(lengths: Iterable[int]) -> list[tuple]:
    """The means of ups ``_u`` and downs ``_d`` that the relative strength of each length is made of."""
    return [(f"_r{x}{n}", f"_{x}", 1 / n, n, "first") for n in sorted(set(lengths)) for x in "ud"]


def _moves(df: DataFrame) -> DataFrame:
    d = diff("close")
    return df.withColumns({"_u": F.when(d > 0, d).when(d.isNotNull(), 0.0), "_d": F.when(d < 0, -d).when(d.isNotNull(), 0.0)})


def _strength(n: int) -> Column:
    return 100 * ratio(c(f"_ru{n}"), c(f"_ru{n}") + c(f"_rd{n}"))


def rsi_reversal(bars: DataFrame, points: list[dict]) -> DataFrame:
    points = _filled(points, length=14, lower=30.0, upper=70.0, middle=50.0, exit_mode="row")
    wide = ta.ewm(_moves(bars), _strengths(p["length"] for p in points))
    picks = [{"_x": _strength(p["length"])} | {f"_{n}": F.lit(float(p[n])) for n in ("lower", "upper", "middle")} for p in points]
    return _by_mode(points, lambda ks, mode: _out(st.rsi_sides(_spread(wide, [picks[k] for k in ks]), c("_lower"), c("_upper"), c("_middle"), mode)))


def bouncy_ball(bars: DataFrame, points: list[dict]) -> DataFrame:
    points = _filled(points, slow=200, fast=20, length=14, oversold=30.0, zone=0.005, exit_mode="row")
    means = [(f"_e{n}", "close", 2 / (n + 1), n, "sma") for (n,) in _distinct((n,) for p in points for n in (p["slow"], p["fast"]))]
    wide = ta.ewm(_moves(bars), means + _strengths(p["length"] for p in points))
    picks = [{"_s": c(f"_e{p['slow']}"), "_f": c(f"_e{p['fast']}"), "_x": _strength(p["length"]), "_over": F.lit(float(p["oversold"])), "_zone": F.lit(float(p["zone"]))} for p in points]
    return _by_mode(points, lambda ks, mode: _out(st.bouncy_sides(_spread(wide, [picks[k] for k in ks]), c("_over"), c("_zone"), mode)))


def _ranges(bars: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """The mean true range ``_w{n}`` of each length."""
    return ta.ewm(ta.true_range(bars, "_tr"), [(f"_w{n}", "_tr", 1 / n, n, "counted") for n in sorted(set(lengths))])


def supertrend_direction(bars: DataFrame, points: list[dict]) -> DataFrame:
    """One pass for the ranges of all lengths, one walk of all points' bands."""
    points = _filled(points, length=10, multiplier=3.0)
    picks = [{"_span": F.lit(float(p["multiplier"])) * c(f"_w{p['length']}")} for p in points]
    rows = _spread(_ranges(bars, (p["length"] for p in points)), picks).select("symbol.*", "ts", "close", ((c("high") + c("low")) / 2).alias("_mid"), "_span")
    made = T.StructType([T.StructField("_line", T.DoubleType()), T.StructField("_side", T.LongType())])
    walked = ta.scan_state(rows, ta.band_start, ta.band_step, ["_mid", "_span", "close"], made, keys=("param_id", "symbol"))
    return walked.select("param_id", "symbol", "ts", "close", F.coalesce("_side", F.lit(0)).cast("int").alias("signal"))


def squeeze_breakout(bars: DataFrame, points: list[dict]) -> DataFrame:
    points = _filled(points, length=20, bands=2.0, channel=1.5, follow=False, exit_mode="row")
    lengths = sorted({p["length"] for p in points})
    wide = ta.ewm(ta.true_range(bars, "_tr"), [(f"_{x}{n}", col, 2 / (n + 1), n, "sma") for n in lengths for x, col in (("k", "close"), ("w", "_tr"))])
    wide = wide.withColumns({f"_{x}{n}": roll("close", fn, n) for n in lengths for x, fn in (("m", F.avg), ("d", F.stddev_pop))})
    picks = [{f"_{x}": c(f"_{x}{p['length']}") for x in "kwmd"} | {"_bands": F.lit(float(p["bands"])), "_channel": F.lit(float(p["channel"])), "_follow": F.lit(bool(p["follow"]))} for p in points]
    return _by_mode(points, lambda ks, mode: _out(st.squeeze_sides(_spread(wide, [picks[k] for k in ks]), c("_bands"), c("_channel"), c("_follow"), mode)))


def _markov(bars: DataFrame, points: list[dict], flags: tuple[str, ...] = ()) -> DataFrame:
    """``_ups`` and ``_history`` of every point; the sums over the last bars are taken once for each distinct history."""
    wide = _ranges(bars, (p["length"] for p in points)).withColumns({f"_b{n}": lag("close", n) for n in sorted({p["lookback"] for p in points})})
    picks = [{"_z": ratio(c("close") - c(f"_b{p['lookback']}"), c(f"_w{p['length']}")), "_threshold": F.lit(float(p["threshold"])), "_history": F.lit(int(p["history"])), **{f"_{n}": F.lit(bool(p[n])) for n in flags}} for p in points]
    df = st.trend_state(_spread(wide, picks), c("_threshold"))
    up = (c("_s") == 1).cast("int")
    return df.withColumn("_ups", F.coalesce(*(F.when(c("_history") == n, roll(up, F.sum, n)) for n in sorted({p["history"] for p in points}))))


def markov_trend(bars: DataFrame, points: list[dict]) -> DataFrame:
    points = _filled(points, lookback=14, threshold=0.5, history=33, length=14)
    return _out(st.markov_trend_sides(_markov(bars, points), c("_history")))


def markov_cross(bars: DataFrame, points: list[dict]) -> DataFrame:
    points = _filled(points, lookback=14, threshold=0.5, history=33, length=14, longs=True, shorts=True)
    return _out(st.markov_cross_sides(_markov(bars, points, ("longs", "shorts")), c("_history"), c("_longs"), c("_shorts")))


#: Strategies on recurrences that solve all points of a grid at once: ``param_id, symbol, ts, close, signal``.
GRID_FORMS: dict[str, Callable[[DataFrame, list[dict]], DataFrame]] = {"ema_cross": st.ema_cross_grid} | {f.__name__: f for f in (macd_trend, macd_reversal, rsi_reversal, bouncy_ball, supertrend_direction, squeeze_breakout, markov_trend, markov_cross)}
