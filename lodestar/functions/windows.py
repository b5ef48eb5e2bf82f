"""Sugar for windows over bars: full-frame rolls, fills, streaks and fixed-kernel averages."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def by_time() -> WindowSpec:
    """The order of bars within a symbol."""
    return Window.partitionBy("symbol").orderBy("ts")


def so_far() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def last_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_time()).rowsBetween(-(n - 1), 0)


def roll(col: Column | str, fn: Callable[[Column], Column], n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """``fn`` over the last n rows; null until the frame holds ``least`` (n) values."""
    col = F.col(col) if isinstance(col, str) else col
    frame = last_n(n, w)
    return F.when(F.count(col).over(frame) >= (n if least is None else least), fn(col).over(frame))


def lag(col: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col, n).over(w or by_time())


def diff(col: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return (F.col(col) if isinstance(col, str) else col) - F.lag(col, n).over(w or by_time())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def pct_change(col: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return ratio(c, F.lag(c, n).over(w or by_time())) - 1


def ffill(col: Column | str, w: WindowSpec | None = None) -> Column:
    return F.last(col, ignorenulls=True).over(w or so_far())


def kernel(col: Column | str, weights: list[float], w: WindowSpec | None = None) -> Column:
    """Weighted mean of the last rows, the first weight for the oldest; null until the frame is full."""
    total, out, n = math.fsum(weights), None, len(weights)
    for k, weight in enumerate(weights):
        term = F.lag(col, n - 1 - k).over(w or by_time()) * F.lit(float(weight))
        out = term if out is None else out + term
    return out / F.lit(float(total))


def streak(df: DataFrame, flag: Column, name: str, w: WindowSpec | None = None) -> DataFrame:
    """``name``: how many rows up to this one have had the flag without a break (0 where it is not set)."""
    on = F.coalesce(flag, F.lit(False))
    breaks = F.sum(F.when(on, 0).otherwise(1)).over((w or by_time()).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_on", on).withColumn("_run", breaks)
    inside = Window.partitionBy("symbol", "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col("_on").cast("int")).over(inside)).drop("_on", "_run")


def quantile_bins(df: DataFrame, col: str, q: int, name: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``name``: bin 0, 1, ... of ``col`` by exact linear quantile edges per group.

    Bins are closed on the right, the least value belongs to the first, equal edges count once.
    """
    edges = df.groupBy(*by).agg(F.percentile(col, [i / q for i in range(q + 1)]).alias("_edges"))
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    out = df.join(edges, list(by), "left")
    return out.withColumn(name, F.when(F.col(col).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(col))))).drop("_edges")
