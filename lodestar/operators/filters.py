"""Filters and trailing lines with memory: companion matrices, clamps, and adaptive states.

Linear filters are matrix scans and ratchets are clamp scans; only those whose
weights hang on their own output walk a state of fixed size.  Constants that published forms
truncate (pi as 3.14159, the root of two as 1.414, degrees given to a cosine in radians) are kept
as published.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scan import clamp_scan, ewm, linear_scan, matrix_scan, scan_state
from lodestar.functions.windows import by_time, lag, last_n, ratio, roll
from lodestar.operators.indicators import mfi, rsi, true_range

c = F.col


def _numbered(df: DataFrame) -> DataFrame:
    """``_i``: 0, 1, ... in the order of a symbol's bars."""
    return df.withColumn("_i", F.row_number().over(by_time()) - 1)


def flex(df: DataFrame, length: int = 20, smooth: int = 20, alpha: float = 0.04) -> DataFrame:
    """Trendflex and reflex: how far a two-pole smoother has moved on average over the last bars, as such and against its own slope, over the root of its power."""
    turn = 2 * 1.414 / smooth
    a = math.exp(-3.14159 * turn)
    b = 2 * a * math.cos(180 * turn)
    push = F.when(c("_i") >= 2, 0.5 * (a * a - b + 1) * (c("close") + c("_x1"))).otherwise(0.0)
    df = _numbered(df).withColumn("_x1", lag("close"))
    df = matrix_scan(df, ["_f", "_f1"], [[b, -a * a], [1.0, 0.0]], [push, 0.0])
    mean = F.sum("_f").over(last_n(length)) / length
    rise = (c("_f") - lag("_f", length)) / length
    ready = c("_i") >= length
    moves = {"_t": F.when(ready, c("_f") - mean), "_r": F.when(ready, c("_f") - mean - rise * (length - 1) / 2)}
    df = df.withColumns(moves)
    df = linear_scan(df, {f"_p{k}": (F.lit(1 - alpha), F.coalesce(alpha * c(k) * c(k), F.lit(0.0))) for k in moves})
    shown = {name: F.when(ready, F.when(c(f"_p{k}") != 0, c(k) / F.sqrt(f"_p{k}")).otherwise(0.0)) for name, k in ((f"TRENDFLEX_{length}_{smooth}", "_t"), (f"REFLEX_{length}_{smooth}", "_r"))}
    return df.withColumns(shown).drop("_i", "_x1", "_f", "_f1", "_t", "_r", "_p_t", "_p_r")


def _twice_smoothed(stages: int, weight: float) -> Callable[[list[float], float], tuple[list[float], float]]:
    """One step of ``stages`` smoothers in a row, each of two means, 1.5 times the first less half the second: the new state and what comes out."""

    def step(state: list[float], x: float) -> tuple[list[float], float]:
        out = []
        for k in range(stages):
            once = (1 - weight) * state[2 * k] + weight * x
            twice = (1 - weight) * state[2 * k + 1] + weight * once
            out += [once, twice]
            x = 1.5 * once - 0.5 * twice
        return out, x

    return step


def relative_strength_xtra(df: DataFrame, length: int = 14) -> DataFrame:
    """Smoothed momentum over smoothed absolute momentum, from 0 to 100: three stages of twice-smoothed means each, as one matrix of twelve states.

    The first value is 50, at the bar ``length``; it stays 50 for ``length - 1`` bars (5 at least) more.
    """
    step = _twice_smoothed(3, 3 / (length + 2))
    unit = lambda j: [float(i == j) for i in range(6)]
    block = list(zip(*(step(unit(j), 0.0)[0] for j in range(6)), strict=True))  # the step is linear: its columns are what units become
    push = step([0.0] * 6, 1.0)[0]
    df = _numbered(df).withColumn("_d", F.when(c("_i") > length, 100 * (c("close") - lag("close"))).otherwise(0.0))
    names = [f"_up{k}" for k in range(6)] + [f"_all{k}" for k in range(6)]
    matrix = [[*row, *[0.0] * 6] for row in block] + [[0.0] * 6 + list(row) for row in block]
    vector = [w * c("_d") for w in push] + [w * F.abs("_d") for w in push]
    df = matrix_scan(df, names, matrix, vector)
    up, all_ = 1.5 * c("_up4") - 0.5 * c("_up5"), 1.5 * c("_all4") - 0.5 * c("_all5")
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (up / all_ + 1) * 50))
    warm = c("_i") >= length + max(length - 1, 5)
    out = F.when(c("_i") >= length - 1, F.when(warm & (all_ > 1e-10), value).otherwise(50.0))
    return df.withColumn(f"RSX_{length}", out).drop("_i", "_d", *names)


def _ratchet(df: DataFrame, name: str, up: Column, floor: Column, ceiling: Column, ready: Column) -> DataFrame:
    """A line that may only rise to ``floor`` where ``up`` holds and only fall to ``ceiling`` elsewhere; it starts at its own bound at the first ready bar."""
    df = df.withColumns({"_up": F.coalesce(up, F.lit(False)), "_floor": floor, "_top": ceiling, "_ready": F.coalesce(ready, F.lit(False))})
    df = df.withColumn("_n", F.sum(c("_ready").cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    bound = F.when(c("_up"), c("_floor")).otherwise(c("_top"))
    first = c("_ready") & (c("_n") == 1)
    low = F.when(first, bound).when(c("_ready") & c("_up"), c("_floor"))
    high = F.when(first, bound).when(c("_ready") & ~c("_up"), c("_top"))
    df = clamp_scan(df, "_line", low, high)
    return df.withColumn(name, F.when(c("_ready"), c("_line"))).drop("_up", "_floor", "_top", "_ready", "_n", "_line")


def alpha_trend(df: DataFrame, length: int = 14, multiplier: float = 1.0, threshold: float = 50.0, behind: int = 2, momentum: str = "rsi") -> DataFrame:
    """A line under the lows while momentum is at the threshold or over it, and over the highs otherwise, that moves one way in each."""
    df = mfi(df, length).withColumnRenamed(f"MFI_{length}", "_mo") if momentum == "mfi" else rsi(df, length).withColumnRenamed(f"RSI_{length}", "_mo")
    df = true_range(df, "_tr").withColumn("_w", multiplier * roll("_tr", F.avg, length))
    name = f"ALPHAT_{length}"
    df = _ratchet(df, name, c("_mo") >= threshold, c("low") - c("_w"), c("high") + c("_w"), c("_w").isNotNull())
    return df.withColumn(f"ALPHATl_{length}_{behind}", lag(name, behind)).drop("_mo", "_tr", "_w")


def range_stop(df: DataFrame, length: int = 14, mean: int = 20, multiplier: float = 3.0, percent: bool = False) -> DataFrame:
    """Trailing stop of mean true ranges under the close while it is over its exponential mean, and over it otherwise."""
    df = _numbered(ewm(true_range(df, "_tr"), [("_a", "_tr", 1 / length, length, "counted"), ("_e", "close", 2 / (mean + 1), mean, "sma")]))
    width = multiplier * c("_a")
    name = f"ATRTS{'p' if percent else ''}_{length}_{mean}"
    df = _ratchet(df, name, c("close") > c("_e"), c("close") - width, c("close") + width, (c("_i") >= max(length, mean)) & c("_a").isNotNull())
    return (df.withColumn(name, 100 * ratio(c(name), c("close"))) if percent else df).drop("_tr", "_a", "_e", "_i")


def schaff_cycle(df: DataFrame, cycle: int = 10, fast: int = 12, slow: int = 26, factor: float = 0.5) -> DataFrame:
    """Schaff's trend cycle: the place of the difference of two means in its range, smoothed, its place in its own range, smoothed again.

    The first place is held while the range's low isn't positive, as published; means are rounded to 8 digits.
    """
    df = _numbered(ewm(df, [("_f", "close", 2 / (fast + 1), fast, "sma"), ("_s", "close", 2 / (slow + 1), slow, "sma")]))
    df = df.withColumn("_m", c("_f") - c("_s")).withColumns({"_lo": roll("_m", F.min, cycle), "_hi": roll("_m", F.max, cycle)})
    span = F.when(c("_hi") == c("_lo"), 2.220446049250313e-16).otherwise(c("_hi") - c("_lo"))
    df = df.withColumn("_k", F.when(c("_lo") > 0, 100 * (c("_m") - c("_lo")) / span))
    df = df.withColumn("_k", F.coalesce(F.last("_k", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    df = linear_scan(df, {"_p": (F.lit(1 - factor), F.when(c("_i") > 0, factor * c("_k")).otherwise(0.0))}).withColumn("_p", F.round("_p", 8))
    low, high = F.min("_p").over(last_n(cycle)), F.max("_p").over(last_n(cycle))
    df = df.withColumn("_q", F.when(high > low, 100 * (c("_p") - low) / (high - low)).otherwise(0.0))
    df = linear_scan(df, {"_y": (F.lit(1 - factor), F.when(c("_i") > 0, factor * c("_q")).otherwise(0.0))})
    ready, tag = c("_i") >= max(cycle, fast, slow) - 1, f"{cycle}_{fast}_{slow}"
    return df.withColumns({f"STC_{tag}": F.when(ready, F.round("_y", 8)), f"STCmacd_{tag}": c("_m"), f"STCstoch_{tag}": F.when(ready, c("_p"))}).drop("_i", "_f", "_s", "_m", "_lo", "_hi", "_k", "_p", "_q", "_y")


def even_better_sine(df: DataFrame, length: int = 40, bars: int = 10) -> DataFrame:
    """A high-pass and a two-pole smoother as one matrix of three states, and the mean of three outputs over the root of their power; the close before the first filtered one counts as 0."""
    angle, turn = 2 * math.pi / length, math.sqrt(2) * math.pi / bars
    keep = (1 - math.sin(angle)) / math.cos(angle)
    a = math.exp(-turn)
    b2, b3 = 2 * a * math.cos(turn), -a * a
    half = (1 - b2 - b3) / 2
    df = _numbered(df)
    push = F.when(c("_i") == length, c("close")).when(c("_i") > length, c("close") - lag("close")).otherwise(0.0)
    df = df.withColumn("_u", 0.5 * (1 + keep) * push)
    df = matrix_scan(df, ["_h", "_f", "_f1"], [[keep, 0.0, 0.0], [half * (keep + 1), b2, b3], [0.0, 1.0, 0.0]], [c("_u"), half * c("_u"), 0.0])
    df = df.withColumn("_f2", F.coalesce(lag("_f1"), F.lit(0.0)))
    wave = (c("_f") + c("_f1") + c("_f2")) / 3
    power = F.sqrt((c("_f") * c("_f") + c("_f1") * c("_f1") + c("_f2") * c("_f2")) / 3)
    return df.withColumn(f"EBSW_{length}_{bars}", F.when(c("_i") >= length, ratio(wave, power)).when(c("_i") == length - 1, 0.0)).drop("_i", "_u", "_h", "_f", "_f1", "_f2")


class Hilbert:
    """The dominant period of a series by a homodyne discriminator, bar by bar; the taps are scaled by the period before."""

    TAPS = (0.0962, 0.5769)

    def __init__(self, begin: int, sign: float) -> None:
        self.begin, self.sign, self.n = begin, sign, 0
        self.closes: deque[float] = deque([0.0] * 4, 4)
        self.smooth, self.detrended, self.inphase, self.quadrature = (deque([0.0] * 7, 7) for _ in range(4))
        self.i2 = self.q2 = self.re = self.im = self.period = self.steady = 0.0

    def _transform(self, past: deque) -> float:
        near, far = self.TAPS
        return (0.075 * self.period + 0.54) * (near * (past[-1] - past[-7]) + far * (past[-3] - past[-5]))

    def add(self, x: float) -> bool:
        """Take a value; false while there are too few."""
        self.closes.append(x)
        self.n += 1
        if self.n <= self.begin:
            for past in (self.smooth, self.detrended, self.inphase, self.quadrature):
                past.append(0.0)
            return False
        self.smooth.append(sum(w * v for w, v in zip((0.1, 0.2, 0.3, 0.4), self.closes, strict=True)))
        self.detrended.append(self._transform(self.smooth))
        self.quadrature.append(self._transform(self.detrended))
        self.inphase.append(self.detrended[-4])
        i2 = 0.2 * (self.inphase[-1] - self._transform(self.quadrature)) + 0.8 * self.i2
        q2 = 0.2 * (self.quadrature[-1] + self._transform(self.inphase)) + 0.8 * self.q2
        self.re = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re
        self.im = 0.2 * (i2 * self.q2 + self.sign * q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2 = i2, q2
        return True

    def settle(self, period: float) -> None:
        """The period measured, held within bounds of the one before and smoothed."""
        period = max(0.67 * self.period, min(1.5 * self.period, period))
        self.period = 0.2 * max(6.0, min(50.0, period)) + 0.8 * self.period
        self.steady = 0.33 * self.period + 0.67 * self.steady


def mesa_average(df: DataFrame, fast: float = 0.5, slow: float = 0.05, hidden: int = 3) -> DataFrame:
    """Means whose weight follows the change of phase of the dominant cycle, and the slower one that follows."""

    def start() -> tuple:
        return Hilbert(3, 1.0), 0.0, 0.0, 0.0

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        cycle, phase, mean, after = state
        (x,) = row
        if cycle.add(x):
            cycle.settle(360 / math.atan(cycle.im / cycle.re) if cycle.im and cycle.re else 0.0)
            now = math.atan(cycle.quadrature[-1] / cycle.inphase[-1]) if cycle.inphase[-1] else 0.0
            weight = max(slow, min(fast, fast / max(1.0, phase - now)))
            mean = weight * x + (1 - weight) * mean
            after, phase = 0.5 * weight * mean + (1 - 0.5 * weight) * after, now
        return (cycle, phase, mean, after), (mean, after) if cycle.n > hidden else (None, None)

    made = T.StructType([T.StructField(n, T.DoubleType()) for n in ("MAMA", "FAMA")])
    return scan_state(df, start, step, ["close"], made)


def instant_trend(df: DataFrame) -> DataFrame:
    """Hilbert trend line: the mean over the dominant period, smoothed by four weights; the first thirteen are the closes."""

    def start() -> tuple:
        return Hilbert(6, -1.0), deque(maxlen=50), deque([0.0] * 4, 4)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        cycle, closes, means = state
        (x,) = row
        closes.append(x)
        if cycle.add(x):
            cycle.settle(360 / math.degrees(math.atan(cycle.im / cycle.re)) if cycle.im and cycle.re else 0.0)
            n = int(cycle.steady + 0.5)
            means.append(sum(list(closes)[-n:]) / n if n else 0.0)
        shown = x if cycle.n <= 13 else sum(w * v for w, v in zip((0.1, 0.2, 0.3, 0.4), means, strict=True))
        return (cycle, closes, means), (shown,)

    return scan_state(df, start, step, ["close"], T.StructType([T.StructField("HT_TL", T.DoubleType())]))


def adaptive_average(df: DataFrame, length: int = 7, phase: float = 0.0) -> DataFrame:
    """Jurik's mean: volatility bands set the weight of three smoothing stages bar by bar; the first ``length - 1`` are null."""
    half = 0.5 * (length - 1)
    lead = min(2.5, max(0.5, 1.5 + 0.01 * phase))
    scale = max(math.log2(math.sqrt(half)) + 2, 0.0)
    bend = max(scale - 2, 0.5)
    hold = scale * math.sqrt(half) / (scale * math.sqrt(half) + 1)
    beta = 0.45 * (length - 1) / (0.45 * (length - 1) + 2)

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (x,) = row
        if state is None:
            return (1, x, x, deque([0.0] * 10, 10), deque([0.0], 66), x, 0.0, 0.0, x), (x if length <= 1 else None,)
        n, upper, lower, widths, sums, first, second, third, out = state
        over, under = x - upper, x - lower
        wide = max(abs(over), abs(under)) if abs(over) != abs(under) else 0.0
        sums.append(sums[-1] + (wide - widths[0]) / 10)
        widths.append(wide)
        mean = sum(sums) / len(sums)
        power = max(1.0, min(scale ** (1 / bend), wide / mean if mean else 0.0)) ** bend
        reach = hold ** math.sqrt(power)
        upper, lower = (x if over > 0 else x - reach * over), (x if under < 0 else x - reach * under)
        weight = beta**power
        first = (1 - weight) * x + weight * first
        second = (1 - beta) * (x - first) + beta * second
        third = (first + lead * second - out) * (1 - weight) ** 2 + weight * weight * third
        out += third
        return (n + 1, upper, lower, widths, sums, first, second, third, out), (out if n + 1 >= length else None,)

    return scan_state(df, lambda: None, step, ["close"], T.StructType([T.StructField(f"JMA_{length}", T.DoubleType())]))


def swing_points(df: DataFrame, legs: int = 10, deviation: float = 5.0, look_ahead: bool = False) -> DataFrame:
    """``symbol, ts, known_ts, swing, value, change``: turning points of -1 (low) and 1 (high) that lie ``deviation`` percent apart.

    A candidate is a bar whose low (high) is the least (greatest) of ``legs // 2`` bars on each
    side; ``known_ts`` is the bar that completes the frame.  With ``look_ahead`` the candidates are
    confirmed backwards from the last one, better ones of the same kind take a point's place (but
    for the two latest points), and ``change`` is the move in percent from the point before.
    Without it they are confirmed forwards, and every point and every better one in its place
    stays, as they were met; ``change`` is then the move up to it.  A frame with a null or fewer
    bars makes no candidate; a bar can be low and high, and gives at most one point in a row.
    """
    side = legs // 2
    frame = by_time().rowsBetween(-side, side)
    inside = F.lag(F.lit(1), side).over(by_time()).isNotNull() & F.lead(F.lit(1), side + 1).over(by_time()).isNotNull() & (F.count("low").over(frame) == 2 * side + 1) & (F.count("high").over(frame) == 2 * side + 1)
    ends = df.select("symbol", "ts", F.row_number().over(by_time()).alias("_i"), F.lead("ts", side).over(by_time()).alias("known_ts"), inside.alias("_in"), "low", "high", F.min("low").over(frame).alias("_least"), F.max("high").over(frame).alias("_most"))
    kinds = F.array(F.when(c("low") == c("_least"), F.struct(F.lit(-1).alias("swing"), c("low").alias("value"))), F.when(c("high") == c("_most"), F.struct(F.lit(1).alias("swing"), c("high").alias("value"))))
    ends = ends.where("_in").withColumn("_e", F.explode(F.filter(kinds, lambda e: e.isNotNull()))).select("symbol", "ts", "known_ts", "_i", "_e.*")
    sign = -1 if look_ahead else 1
    ends = ends.withColumns({"_turn": sign * c("_i"), "_side": sign * c("swing")})

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        i, swing, value = row
        if state is None:
            return (0, i, swing, value, None), (0, 0.0)
        slot, at, kind, held, before = state
        if swing == kind:
            better = value < held if kind < 0 else value > held
            if not better or slot < (2 if look_ahead else 0):
                return state, (None, None)
            base = value if look_ahead else before
            move = 100 * abs(before - value) / base if before is not None else 0.0
            return (slot, i, swing, value, before), (slot, move)
        move = (value - held if kind < 0 else held - value) / (value if look_ahead else held)
        if not 100 * move > deviation or at == i:
            return state, (None, None)
        return (slot + 1, i, swing, value, held), (slot + 1, 100 * move)

    made = T.StructType([T.StructField("slot", T.LongType()), T.StructField("change", T.DoubleType())])
    points = scan_state(ends, lambda: None, step, ["_i", "swing", "value"], made, order=("_turn", "_side")).where("slot is not null")
    if look_ahead:
        walk = Window.partitionBy("symbol").orderBy("_turn", "_side")
        # the last one accepted in a slot is the point; its move from the point before is told by the next slot's last
        points = points.withColumn("_next", F.lead("slot").over(walk)).where("_next is null or _next <> slot")
        points = points.withColumn("change", F.coalesce(F.lead("change").over(walk), F.lit(0.0)))
    return points.select("symbol", "ts", "known_ts", "swing", "value", "change")


def zigzag(df: DataFrame, legs: int = 10, deviation: float = 5.0, look_ahead: bool = False) -> DataFrame:
    """Bars with the ``swing_points`` at them: at their own bars with ``look_ahead``, else at the bars that make them known (the last one, if two).

    ``ts`` is unique within a symbol; bars without a point hold nulls.
    """
    tag = f"{deviation:g}_{legs}"
    points = swing_points(df, legs, deviation, look_ahead).withColumn("_at", c("ts") if look_ahead else c("known_ts"))
    one = points.groupBy("symbol", c("_at").alias("ts")).agg(F.max_by(F.struct("swing", "value", "change"), F.struct("ts", "swing")).alias("_p"))
    shown = {f"ZIGZAG{k}_{tag}": c("_p")[n] for k, n in (("s", "swing"), ("v", "value"), ("d", "change"))}
    return df.join(one, ["symbol", "ts"], "left").withColumns(shown).drop("_p")


FILTERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (flex, relative_strength_xtra, alpha_trend, range_stop, schaff_cycle, even_better_sine, mesa_average, instant_trend, adaptive_average, zigzag)}
