"""Metrics of one series per symbol: growth, risk, regression on a benchmark, slices by calendar, correlations of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.windows import by_time, ratio, so_far

c = F.col
#: Fixed value: days of a tropical year.
YEAR_DAYS = 365.242199074074074


def series_metrics(bars: DataFrame, col: str = "close", years: int = 3, rate: float = 0.0) -> DataFrame:
    """Growth a year, volatility, Sharpe, Sortino and Calmar ratios, worst drawdowns in three measures, optimal leverage and profit score of a price series.

    Years are whole days between the first and last time over the tropical year; the Calmar ratio looks at the last ``years`` years.
    """
    x = c(col)
    top = F.max(x).over(so_far())
    rows = bars.withColumns({"_r": ratio(x, F.lag(x).over(by_time())) - 1, "_dd": top - x, "_dp": 1 - ratio(x, top), "_dl": F.ln(top) - F.ln(x), "_i": F.row_number().over(by_time()) - 1, "_end": F.max("ts").over(Window.partitionBy("symbol"))})
    late = c("ts") > c("_end") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(round(years * 365.25 * 86400))))
    late_top = F.max(F.when(late, x)).over(so_far())
    rows = rows.withColumns({"_late": late, "_ld": F.when(late, 1 - ratio(x, late_top))})
    at = lambda fn, on=None: fn(x if on is None else F.when(on, x), c("ts") if on is None else F.when(on, c("ts")))
    span = lambda a, b: F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 86400) / YEAR_DAYS
    g = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), at(F.min_by).alias("x0"), at(F.max_by).alias("x1"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("std"),
        F.sum(F.when(c("_r") < 0, c("_r") * c("_r")).otherwise(0.0)).alias("down"), F.max("_dd").alias("drawdown"), F.max("_dp").alias("drawdown_pct"), F.max("_dl").alias("drawdown_log"),
        at(F.min_by, c("_late")).alias("y0"), F.min(F.when(c("_late"), c("ts"))).alias("u0"), F.max("_ld").alias("late_drawdown"), F.corr("_i", x).alias("straight"),
    )
    total = span("t0", "t1")
    growth = F.pow(ratio(c("x1"), c("x0")), ratio(F.lit(1.0), total)) - 1
    late_growth = F.pow(ratio(c("x1"), c("y0")), ratio(F.lit(1.0), span("u0", "t1"))) - 1
    a_year = ratio(c("n"), total)
    down = F.sqrt(c("down") / (c("n") - 1)) * F.sqrt(a_year)
    return g.select(
        "symbol", total.alias("years"), growth.alias("cagr"), (F.sqrt(a_year) * c("std")).alias("volatility"), ratio(252 * c("mean") - rate, 252**0.5 * c("std")).alias("sharpe"), down.alias("downside"), ratio(growth - rate, down).alias("sortino"),
        ratio(late_growth, c("late_drawdown")).alias("calmar"), "drawdown", "drawdown_pct", "drawdown_log", (F.ln(c("x1")) - F.ln(c("x0")) - c("drawdown_log")).alias("log_max_drawdown"), ratio(252 * c("mean") - rate, 252 * c("std") * c("std")).alias("optimal_leverage"), (c("straight") * growth).alias("pure_profit"),
    )


def regression(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``a, b, r, t`` of the line through y over x in each group."""
    g = pairs.where(c(x).isNotNull() & c(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.corr(y, x).alias("r"))
    return g.select(*by, "n", "a", "b", "r", ratio(c("r") * F.sqrt(c("n") - 2.0), F.sqrt(1 - c("r") * c("r"))).alias("t"))


def jensens_alpha(bars: DataFrame, index: str) -> DataFrame:
    """Regression of each symbol's returns on those of the index at the same times; ``a`` is the alpha."""
    rows = bars.withColumn("ret", ratio(c("close"), F.lag("close").over(by_time())) - 1)
    base = rows.where(c("symbol") == index).select("ts", c("ret").alias("base"))
    return regression(rows.where(c("symbol") != index).join(base, "ts"), "base", "ret", ["symbol"])


def since(df: DataFrame, as_of: str, unit: str) -> DataFrame:
    """Rows from the start of the month, quarter or year that ``as_of`` lies in, up to it."""
    end = F.lit(as_of).cast("timestamp")
    return df.where((c("ts") >= F.date_trunc(unit, end)) & (c("ts") <= end))


def to_date_returns(bars: DataFrame, as_of: str) -> DataFrame:
    """Month-, quarter- and year-to-date returns from the first close of each slice."""
    end = F.lit(as_of).cast("timestamp")
    out = []
    for unit in ("month", "quarter", "year"):
        on = (c("ts") >= F.date_trunc(unit, end)) & (c("ts") <= end)
        out.append((ratio(F.max_by(F.when(on, c("close")), F.when(on, c("ts"))), F.min_by(F.when(on, c("close")), F.when(on, c("ts")))) - 1).alias(unit))
        out.append(F.count(F.when(on, 1)).alias(f"{unit}_bars"))
    return bars.groupBy("symbol").agg(*out)


def column_correlations(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), triangular: bool = False) -> DataFrame:
    """Correlation of each two columns, all in one aggregate; ``triangular`` leaves out the mirrored half and the diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if not triangular or i < j]
    one = lambda a, b: F.corr(a, b) if a <= b else F.corr(b, a)
    wide = df.groupBy(*by).agg(*(one(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows: Column = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(f"r{k}").alias("corr")) for k, (a, b) in enumerate(pairs))))
    return wide.select(*by, rows.alias("e")).select(*by, "e.*")
