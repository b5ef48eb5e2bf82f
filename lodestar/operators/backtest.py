"""Sizing, returns and costs of signals, portfolio risk, trades, parameter search and bootstrap."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scan import linear_scan
from lodestar.functions.windows import by_time, lag, ratio, roll, so_far
from lodestar.operators.grids import GRID_FORMS
from lodestar.operators.strategy import ALIASES, signals

c = F.col
YEAR = 252.0


def size(df: DataFrame, kind: str = "fixed", share: float = 1.0, target: float = 0.2, lookback: int = 20, cap: float = 2.0, least: int = 50) -> DataFrame:
    """``size`` of each signal: a fixed share, a target volatility, or half of Kelly's fraction so far."""
    if kind == "fixed":
        return df.withColumn("size", c("signal") * share)
    df = df.withColumn("_g", F.ln(ratio(c("close"), lag("close"))))
    if kind == "volatility":
        weight = F.least(F.lit(cap), ratio(F.lit(target), roll("_g", F.stddev_samp, lookback) * YEAR**0.5))
        return df.withColumn("size", F.coalesce(c("signal") * weight, F.lit(0.0))).drop("_g")
    df = df.withColumn("_r", F.coalesce(lag("signal") * c("_g"), F.lit(0.0)))
    fraction = F.when(F.count("_r").over(so_far()) >= least, ratio(F.avg("_r").over(so_far()), F.var_samp("_r").over(so_far())))
    return df.withColumn("size", F.coalesce(c("signal") * F.greatest(F.lit(0.0), F.least(F.lit(cap), fraction / 2)), F.lit(0.0))).drop("_g", "_r")


def run(df: DataFrame, slippage: float = 0.001, commission: float = 0.0, equity: float = 10000.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``position, log_ret, gross, traded, net`` of sized signals: a signal holds from the next bar on."""
    w = Window.partitionBy(*keys).orderBy("ts")
    df = df.withColumns({"position": F.coalesce(F.lag("size").over(w), F.lit(0.0)).cast("double"), "log_ret": F.ln(ratio(c("close"), F.lag("close").over(w)))})
    df = df.withColumns({"gross": c("position") * c("log_ret"), "traded": F.coalesce(F.abs(c("position") - F.lag("position").over(w)), F.lit(0.0))})
    fee = F.when(c("traded") > 0, commission / equity).otherwise(0.0)
    return df.withColumn("net", c("gross") - c("traded") * slippage - fee)


def metrics(df: DataFrame, by: tuple[str, ...] = ("symbol",), ret: str = "net", periods: float = YEAR) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, worst drawdown and trades of log returns."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.where(c(ret).isNotNull()).withColumn("_c", F.sum(ret).over(w))
    df = df.withColumn("_d", F.exp(c("_c") - F.max("_c").over(w)) - 1)
    annual, vol = F.exp(F.avg(ret) * periods) - 1, F.stddev_samp(ret) * periods**0.5
    return df.groupBy(*by).agg((F.exp(F.sum(ret)) - 1).alias("total"), annual.alias("annual"), vol.alias("volatility"), ratio(annual, vol).alias("sharpe"), F.min("_d").alias("max_drawdown"), F.sum("traded").alias("traded"))


def portfolio(df: DataFrame, keys: tuple[str, ...] = (), ret: str = "net", total: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Log return of equal weights at each time; a symbol without a bar there counts as 0."""
    n = df.select("symbol").distinct().agg(F.count("*").alias("_n"))
    sums = df.groupBy(*keys, "ts").agg(total(F.coalesce(F.exp(ret) - 1, F.lit(0.0))).alias("_s"))
    return sums.crossJoin(F.broadcast(n)).select(*keys, "ts", F.log1p(c("_s") / c("_n")).alias("ret"))  # one row


def risk(returns: DataFrame, periods: float = YEAR) -> DataFrame:
    """Value at risk, expected shortfall, Sortino and Calmar ratios and win rate of one series ``ts, ret``."""
    simple = returns.withColumns({"x": F.exp("ret") - 1, "k": F.lit(1)})
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    simple = simple.withColumn("_c", F.sum("ret").over(w)).withColumn("_d", F.exp(c("_c") - F.max("_c").over(w)) - 1)
    edge = simple.agg(F.percentile("x", 0.05).alias("var_95"))
    annual = F.exp(F.avg("ret") * periods) - 1
    down = F.sqrt(F.avg(F.when(c("x") < 0, c("x") * c("x")))) * periods**0.5
    return simple.crossJoin(F.broadcast(edge)).agg(F.first("var_95").alias("var_95"), F.avg(F.when(c("x") <= c("var_95"), c("x"))).alias("cvar_95"), ratio(annual, down).alias("sortino"), ratio(annual, F.abs(F.min("_d"))).alias("calmar"), F.avg((c("x") > 0).cast("double")).alias("win_rate"), F.min("_d").alias("max_drawdown"))


def trades(df: DataFrame) -> DataFrame:
    """Runs of bars with a position: first and last time, bars and return."""
    on = c("position") != 0
    df = df.withColumn("_on", on).withColumn("_new", F.coalesce(c("_on") != lag("_on"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(so_far()))
    return df.where("_on").groupBy("symbol", "_run").agg(F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.count("*").alias("bars"), (F.exp(F.sum("gross")) - 1).alias("ret")).drop("_run")


def trade_metrics(df: DataFrame) -> DataFrame:
    r = c("ret")
    gain, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    return trades(df).groupBy("symbol").agg(F.count("*").alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"), ratio(gain, loss).alias("profit_factor"), F.avg("ret").alias("avg_ret"), F.avg("bars").alias("avg_bars"))


def transactions(df: DataFrame) -> DataFrame:
    """A row for each change of position: action, signed quantity and value at the close."""
    change = c("position") - F.coalesce(lag("position"), F.lit(0.0))
    df = df.withColumn("quantity", change).where("quantity <> 0")
    return df.select("symbol", "ts", F.when(c("quantity") > 0, "BUY").otherwise("SELL").alias("action"), "quantity", c("close").alias("price"), (c("quantity") * c("close")).alias("value"))


def stop_loss(df: DataFrame, pct: float = 0.05) -> DataFrame:
    """The signal set to 0 from the bar whose low (for shorts: high) passes the stop, until a new signal.

    The entry price is the close of the episode's first bar, whose own range doesn't count.
    """
    df = df.withColumn("_new", F.coalesce(c("signal") != lag("signal"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(so_far()))
    inside = Window.partitionBy("symbol", "_run").orderBy("ts")
    later = inside.rowsBetween(Window.unboundedPreceding, 0)
    entry, k = F.first("close").over(later), F.row_number().over(inside)
    hit = (k > 1) & F.when(c("signal") > 0, c("low") <= entry * (1 - pct)).when(c("signal") < 0, c("high") >= entry * (1 + pct)).otherwise(False)
    df = df.withColumn("_hit", hit.cast("int")).withColumn("_out", F.max("_hit").over(later))
    return df.withColumn("signal", F.when(c("_out") == 1, 0).otherwise(c("signal"))).drop("_new", "_run", "_hit", "_out")


def grid(name_to_values: dict[str, list]) -> list[dict]:
    names = list(name_to_values)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*name_to_values.values())]


def grid_returns(bars: DataFrame, strategy: str, points: list[dict]) -> DataFrame:
    """Net returns of every point of a grid: ``param_id, symbol, ts, net, traded``.

    All points' signals stand side by side on the one sort by symbol and are then unpivoted;
    strategies on recurrences that have a form for whole grids solve each distinct parameter once.
    """
    form = GRID_FORMS.get(ALIASES.get(strategy, strategy))
    if form is not None:
        return run(form(bars, points).withColumn("size", c("signal").cast("double")), keys=("param_id", "symbol")).select("param_id", "symbol", "ts", "net", "traded")
    wide = bars
    for k, point in enumerate(points):
        wide = signals(wide, strategy, **point).withColumnRenamed("signal", f"s{k}")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("param_id"), c(f"s{k}").alias("signal")) for k in range(len(points)))))
    long = wide.select("symbol", "ts", "close", each.alias("g")).select("symbol", "ts", "close", "g.*")
    return run(long.withColumn("size", c("signal").cast("double")), keys=("param_id", "symbol")).select("param_id", "symbol", "ts", "net", "traded")


def grid_search(bars: DataFrame, strategy: str, points: list[dict]) -> DataFrame:
    """Log return, Sharpe ratio and worst drawdown of the equal-weight portfolio of each point."""
    w = Window.partitionBy("param_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rets = portfolio(grid_returns(bars, strategy, points), ("param_id",)).withColumn("_c", F.sum("ret").over(w))
    rets = rets.withColumn("_d", F.exp(c("_c") - F.max("_c").over(w)) - 1)
    sharpe = ratio(F.avg("ret"), F.stddev_samp("ret")) * YEAR**0.5
    return rets.groupBy("param_id").agg(F.sum("ret").alias("log_return"), sharpe.alias("sharpe"), F.min("_d").alias("max_drawdown"))


def random_points(points: list[dict], n: int, seed: int) -> list[dict]:
    """n of the points, those of the least digests of seed and number, in the order of the grid."""
    ranked = sorted(range(len(points)), key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
    return [points[k] for k in sorted(ranked[:n])]


def walk_forward(bars: DataFrame, strategy: str, points: list[dict], train_days: int = 252, step_days: int = 63, digits: int | None = None) -> DataFrame:
    """For each window the point of the best Sharpe ratio in training and its return in the test days that follow.

    Ratios are taken over returns from the least up, so points that trade alike in training have the same one to the last
    digit, and the first of them counts; with ``digits`` ratios are compared when rounded to these.

    Windows step through the distinct times.  The windows that hold a time are a range of whole
    numbers, so each row is exploded to them; nothing is joined by range.
    """
    rows = _windowed(_grid_portfolio(bars, strategy, points), train_days, step_days)
    return _best_points(rows, train_days, step_days, digits)


def _grid_portfolio(bars: DataFrame, strategy: str, points: list[dict]) -> DataFrame:
    """Returns of each point's portfolio, the same to the last digit for points that trade alike at a time: a group holds a value for each symbol."""
    return portfolio(grid_returns(bars, strategy, points), ("param_id",), total=lambda x: _ordered_sum(_ordered(x)))


def _ordered(x: Column) -> Column:
    """A group's values from the least up."""
    return F.array_sort(F.collect_list(x))


def _ordered_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _windowed(rets: DataFrame, train_days: int, step_days: int) -> DataFrame:
    """Rows with their time's number ``i``, once for each ``window`` that they are in."""
    days = rets.select("ts").distinct().withColumn("k", F.lit(1))
    days = days.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("ts")) - 1).withColumn("last", F.max("i").over(Window.partitionBy("k")))  # one row a time
    first = F.greatest(F.lit(0), F.ceil((c("i") - (train_days + step_days - 1)) / step_days)).cast("int")
    final = F.least(F.floor(c("i") / step_days), F.greatest(F.lit(0), F.floor((c("last") - train_days) / step_days))).cast("int")
    days = days.where(first <= final).select("ts", "i", F.explode(F.sequence(first, final)).alias("window"))
    return rets.join(days, "ts")


def _best_points(rows: DataFrame, train_days: int, step_days: int, digits: int | None) -> DataFrame:
    train = c("i") < c("window") * step_days + train_days
    sums = rows.groupBy("window", "param_id").agg(_ordered(F.when(train, c("ret"))).alias("_v"), F.sum(F.when(~train, c("ret"))).alias("test_ret"), F.count(F.when(~train, 1)).alias("test_days")).where("test_days > 0")
    least, n = F.get("_v", F.lit(0)), F.size("_v")
    sums = sums.withColumn("_m", least + ratio(_ordered_sum(F.transform("_v", lambda x: x - least)), n))
    spread = F.sqrt(ratio(_ordered_sum(F.transform("_v", lambda x: (x - c("_m")) * (x - c("_m")))), n - 1))
    sums = sums.withColumn("train_sharpe", ratio(c("_m"), spread))
    best = F.max_by(F.struct("param_id", "train_sharpe", "test_ret", "test_days"), F.struct(c("train_sharpe") if digits is None else F.round("train_sharpe", digits), -c("param_id")))
    return sums.groupBy("window").agg(best.alias("b")).select("window", "b.*")


def walk_forward_returns(bars: DataFrame, strategy: str, points: list[dict], train_days: int = 252, step_days: int = 63, digits: int | None = None) -> DataFrame:
    """The out-of-sample returns stitched together: of each window's test days those of its best point, and the running sum."""
    rows = _windowed(_grid_portfolio(bars, strategy, points), train_days, step_days)
    best = _best_points(rows, train_days, step_days, digits).select("window", "param_id")
    tested = rows.where(c("i") >= c("window") * step_days + train_days).join(best, ["window", "param_id"])
    total = Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one row a time
    return tested.select("ts", "window", "param_id", "ret", F.sum("ret").over(total).alias("log_equity"))


def monte_carlo(returns: DataFrame, sims: int = 100, seed: int = 42) -> DataFrame:
    """Bootstrap of one series ``ts, ret``: end value and worst drawdown of each simulated path.

    Draw t of simulation s is the return at index md5(seed:s:t) modulo T, so paths never depend on the plan.
    """
    rows = returns.withColumn("k", F.lit(1)).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("ts")) - 1).select("i", "ret")
    total = rows.agg(F.count("*").alias("n"))
    spark = returns.sparkSession
    draws = spark.range(sims).withColumnRenamed("id", "sim").crossJoin(F.broadcast(total)).select("sim", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), c("n") - 1)).alias("t"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c("sim").cast("string"), c("t").cast("string")).cast("binary")), 1, 8)
    draws = draws.withColumn("i", F.conv(digits, 16, 10).cast("bigint") % c("n"))
    paths = draws.join(rows, "i")
    w = Window.partitionBy("sim").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    paths = paths.withColumn("c", F.sum("ret").over(w)).withColumn("d", F.exp(c("c") - F.greatest(F.lit(0.0), F.max("c").over(w))) - 1)
    return paths.groupBy("sim").agg(F.exp(F.sum("ret")).alias("end_value"), F.min("d").alias("max_drawdown"))


def latest_signals(df: DataFrame, max_leverage: float = 1.0) -> DataFrame:
    """The last signal of each symbol, the action it asks for, and weights scaled to the leverage."""
    df = df.withColumn("before", F.coalesce(lag("signal"), F.lit(0)))
    last = df.groupBy("symbol").agg(F.max_by(F.struct("ts", "signal", "before"), "ts").alias("l")).select("symbol", "l.*")
    now, old = c("signal"), c("before")
    action = F.when((now == 0) & (old != 0), "CLOSE").when((now > 0) & (old <= 0), "BUY").when((now < 0) & (old >= 0), "SELL_SHORT").otherwise("HOLD")
    total = F.sum(F.abs("signal")).over(Window.partitionBy("k"))
    return last.withColumn("k", F.lit(1)).select("symbol", "ts", "signal", action.alias("action"), F.when(total > max_leverage, now * max_leverage / total).otherwise(now.cast("double")).alias("weight"))


def monthly_table(returns: DataFrame) -> DataFrame:
    """Return of each month, years down and months across."""
    return returns.groupBy(F.year("ts").alias("year")).pivot("month", list(range(1, 13))).agg(F.exp(F.sum("ret")) - 1) if "month" in returns.columns else monthly_table(returns.withColumn("month", F.month("ts")))


def inverse_volatility(bars: DataFrame) -> DataFrame:
    vol = bars.withColumn("r", F.ln(ratio(c("close"), lag("close")))).groupBy("symbol").agg(F.stddev_samp("r").alias("vol"))
    whole = Window.partitionBy(F.lit(1))
    return vol.withColumn("weight", ratio(1 / c("vol"), F.sum(1 / c("vol")).over(whole)))


def ar_regime(bars: DataFrame, window: int = 60) -> DataFrame:
    """Rolling AR(1) coefficient of returns, its t value, and a label."""
    df = bars.withColumn("r", ratio(c("close"), lag("close")) - 1).withColumn("r1", lag("r"))
    frame = by_time().rowsBetween(-(window - 1), 0)
    n = F.count("r1").over(frame)
    phi = F.when(n == window, ratio(F.covar_samp("r", "r1").over(frame), F.var_samp("r1").over(frame)))
    df = df.where("r1 is not null").withColumn("phi", phi)
    df = df.withColumn("t", ratio(c("phi"), F.sqrt(F.greatest(F.lit(0.0), (1 - c("phi") * c("phi")) / window))))
    return df.select("symbol", "ts", "phi", "t", F.when(c("t") > 1.96, "trend").when(c("t") < -1.96, "reversion").when(c("t").isNotNull(), "neutral").alias("regime"))


def round_trips(fills: DataFrame) -> DataFrame:
    """First-in-first-out matches of signed fills ``symbol, ts, quantity, price``: one row for each matched lot.

    Each fill closes up to the position before it and opens with the rest.  Within an episode (from
    flat to flat) opened and closed quantities are laid end to end; where two intervals overlap, that
    much of the opening lot is closed there.  The join is on symbol and episode.
    """
    before = F.coalesce(F.sum("quantity").over(by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = fills.withColumn("_p", F.round(before, 9))
    df = df.withColumn("_c", F.when(c("_p") * c("quantity") < 0, F.least(F.abs("_p"), F.abs("quantity"))).otherwise(0.0))
    df = df.withColumn("_o", F.round(F.abs("quantity") - c("_c"), 9)).withColumn("_new", ((c("_o") > 0) & ((c("_p") == 0) | (c("_c") > 0))).cast("int"))
    df = df.withColumn("_e", F.sum("_new").over(so_far()))
    opens = df.where("_o > 0").select("symbol", c("_e").alias("episode"), c("ts").alias("opened"), c("price").alias("entry"), F.when(c("quantity") > 0, "long").otherwise("short").alias("side"), c("_o").alias("q"))
    closes = df.where("_c > 0").select("symbol", (c("_e") - c("_new")).alias("episode"), c("ts").alias("closed"), c("price").alias("exit"), c("_c").alias("q"))
    for_open, for_close = (Window.partitionBy("symbol", "episode").orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in ("opened", "closed"))
    opens = opens.withColumn("o_end", F.sum("q").over(for_open)).withColumn("o_begin", c("o_end") - c("q")).drop("q")
    closes = closes.withColumn("c_end", F.sum("q").over(for_close)).withColumn("c_begin", c("c_end") - c("q")).drop("q")
    met = opens.join(closes, ["symbol", "episode"]).withColumn("quantity", F.round(F.least("o_end", "c_end") - F.greatest("o_begin", "c_begin"), 9)).where("quantity > 0")
    return met.select("symbol", "side", "opened", "closed", "entry", "exit", "quantity", (c("quantity") * F.when(c("side") == "long", c("exit") - c("entry")).otherwise(c("entry") - c("exit"))).alias("pnl"))


def trailing_stop(df: DataFrame, pct: float = 0.05) -> DataFrame:
    """As ``stop_loss``, with a stop that follows the best close of the episode so far."""
    df = df.withColumn("_new", F.coalesce(c("signal") != lag("signal"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(so_far()))
    inside = Window.partitionBy("symbol", "_run").orderBy("ts")
    before, later = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(c("signal") > 0, c("low") <= F.max("close").over(before) * (1 - pct)).when(c("signal") < 0, c("high") >= F.min("close").over(before) * (1 + pct))
    df = df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int")).withColumn("_out", F.max("_hit").over(later))
    return df.withColumn("signal", F.when(c("_out") == 1, 0).otherwise(c("signal"))).drop("_new", "_run", "_hit", "_out")


#: Bars a year by time frame.
BARS_A_YEAR = {"1m": 252 * 390, "2m": 252 * 195, "5m": 252 * 78, "15m": 252 * 26, "30m": 252 * 13, "60m": 252 * 7, "1h": 252 * 7, "90m": 252 * 4, "1d": 252, "D": 252, "5d": 52, "1wk": 52, "1mo": 12, "3mo": 4}


def annual_factor(frame: Column) -> Column:
    """Bars a year of a time frame's name; 252 for any other."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in BARS_A_YEAR.items() for x in pair)), frame), F.lit(252))


def frame_metrics(bars: DataFrame) -> DataFrame:
    """Annualised return, volatility and Sharpe ratio by symbol and time frame, each with its frame's bars a year."""
    w = Window.partitionBy("symbol", "frame").orderBy("ts")
    rows = bars.withColumn("r", F.ln(ratio(c("close"), F.lag("close").over(w))))
    g = rows.groupBy("symbol", "frame").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).withColumn("factor", annual_factor(c("frame")))
    return g.select("symbol", "frame", "n", "factor", (c("m") * c("factor")).alias("annual_log"), (c("s") * F.sqrt("factor")).alias("volatility"), ratio(c("m") * c("factor"), c("s") * F.sqrt("factor")).alias("sharpe"))


def monte_carlo_summary(paths: DataFrame, ruin: float = -0.5) -> DataFrame:
    """Mean and worst drawdown, median end value and the share of paths that fall below ``ruin``."""
    return paths.agg(F.count("*").alias("simulations"), F.avg("max_drawdown").alias("avg_drawdown"), F.min("max_drawdown").alias("worst_drawdown"), F.percentile("end_value", 0.5).alias("median_end_value"), F.avg((c("max_drawdown") < ruin).cast("double")).alias("ruin_share"))


def trade_returns(df: DataFrame) -> DataFrame:
    """``ts, ret``: log returns of the trades, none below a loss of 99.99 %, in order of their opening and symbol."""
    rows = trades(df)
    order = Window.partitionBy(F.lit(1)).orderBy("opened", "symbol")
    return rows.select(F.row_number().over(order).alias("ts"), F.log1p(F.greatest("ret", F.lit(-0.9999))).alias("ret"))


def passing_symbols(measured: DataFrame, threshold: float = 0.3) -> DataFrame:
    return measured.where(c("sharpe") >= threshold)


def top_points(searched: DataFrame, n: int = 5) -> DataFrame:
    """The n points of the best Sharpe ratio, ties by number."""
    return searched.orderBy(F.desc("sharpe"), "param_id").limit(n)


def heat_map(searched: DataFrame, points: list[dict], across: str, down: str, value: str = "sharpe") -> DataFrame:
    """Mean of a result by two parameters, one down and one across."""
    table = searched.sparkSession.createDataFrame([(k, float(p[across]), float(p[down])) for k, p in enumerate(points)], f"param_id int, _x double, {down} double")
    columns = sorted({float(p[across]) for p in points})
    return searched.join(F.broadcast(table), "param_id").groupBy(down).pivot("_x", columns).agg(F.avg(value)).toDF(down, *(f"{across}_{x:g}" for x in columns))


def batch(bars: DataFrame, jobs: list[tuple[str, str, dict, list[str] | None]]) -> DataFrame:
    """One row for each job (name, strategy, parameters, symbols or all) with its portfolio's result.

    The jobs' returns are one long table keyed by job, so they run as one Spark job.
    """
    parts = []
    for name, strategy, params, symbols in jobs:
        some = bars if symbols is None else bars.where(c("symbol").isin(symbols))
        rets = portfolio(run(size(signals(some, strategy, **params)))).select(F.lit(name).alias("job_id"), F.lit(strategy).alias("strategy"), "ts", "ret")
        parts.append(rets)
    rets = parts[0]
    for part in parts[1:]:
        rets = rets.unionByName(part)
    return compare_runs(rets, ("job_id", "strategy"))


def compare_runs(returns: DataFrame, by: tuple[str, ...] = ("param_id",)) -> DataFrame:
    """Log return in total and a calendar year, Sharpe ratio and worst drawdown of each run."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("_c", F.sum("ret").over(w)).withColumn("_d", F.exp(c("_c") - F.max("_c").over(w)) - 1)
    days = F.datediff(F.max("ts"), F.min("ts"))
    return rows.groupBy(*by).agg(F.sum("ret").alias("log_return"), (F.sum("ret") * ratio(F.lit(365.0), days.cast("double"))).alias("annual_log"), (ratio(F.avg("ret"), F.stddev_samp("ret")) * YEAR**0.5).alias("sharpe"), F.min("_d").alias("max_drawdown"))


def rebased_curves(returns: DataFrame, by: tuple[str, ...] = ("param_id",)) -> DataFrame:
    """Log of each run's equity over its first value."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("_c", F.sum("ret").over(w))
    return rows.select(*by, "ts", (c("_c") - F.first("_c").over(w)).alias("log_equity"))


def targets(df: DataFrame, max_leverage: float = 1.0, band: float = 0.1) -> DataFrame:
    """The last target size of each symbol against what it holds: the action, and the target scaled to the leverage.  ``df`` has been run."""
    last = df.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "signal", "size", "position"), "ts").alias("l")).select("symbol", "l.*")
    now, held = c("size"), c("position")
    same = ((now > 0) & (held > 0)) | ((now < 0) & (held < 0))
    action = F.when((now > 0) & (held <= 0), "BUY").when((now < 0) & (held >= 0), "SELL_SHORT").when((now == 0) & (held != 0), "CLOSE").when(same & (F.abs(now - held) > band), "REBALANCE").otherwise("HOLD")
    total = F.sum(F.abs("size")).over(Window.partitionBy(F.lit(1)))  # one row a symbol
    scaled = F.when(total > max_leverage, now * max_leverage / total).otherwise(now)
    return last.select("symbol", "ts", "close", c("signal").cast("int").alias("signal"), action.alias("action"), held.alias("holds"), scaled.alias("target"))


def orders(wanted: DataFrame, positions: DataFrame, equity: float) -> DataFrame:
    """Whole shares for each target, what is held of ``positions(symbol, quantity)``, and the order between them; no order where both are equal."""
    shares = F.signum(c("target")) * F.floor(F.abs(ratio(F.lit(equity) * c("target"), c("close"))))
    rows = wanted.withColumn("target_shares", shares.cast("bigint")).join(positions, "symbol", "left").withColumn("held", F.coalesce("quantity", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("delta", c("target_shares") - c("held")).where("delta <> 0")
    return rows.select("symbol", "target_shares", "held", F.when(c("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").alias("quantity"))


def event_costs(df: DataFrame, bps: float = 7.0) -> DataFrame:
    """``events, gross_ret, cost, net_ret``: bar returns with the signal, less a cost for each entry and exit; a change into and out of a side at once is two events, and the first bar counts one."""
    before = lag("signal")
    changed = ~c("signal").eqNullSafe(before)
    events = (changed & (c("signal") != 0)).cast("int") + (changed & F.coalesce(before != 0, F.lit(True))).cast("int")
    df = df.withColumns({"events": events, "gross_ret": F.coalesce(c("signal") * (ratio(c("close"), lag("close")) - 1), F.lit(0.0))})
    return df.withColumn("cost", c("events") * bps / 10000).withColumn("net_ret", c("gross_ret") - c("cost"))


def split_metrics(df: DataFrame, test_start: str, periods: float = YEAR) -> DataFrame:
    """Growth, Sharpe, Sortino and Calmar ratios, worst drawdown, win rate of bars with a return, and events, by symbol and data set (train, test)."""
    by = ["symbol", "dataset"]
    df = df.withColumn("dataset", F.when(F.to_date("ts") < test_start, "train").otherwise("test"))
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = c("net_ret")
    grown = F.log1p(F.greatest(x, F.lit(-0.9999)))  # a loss of more than all is one of nearly all
    df = df.withColumn("_c", F.sum(grown).over(w)).withColumn("_d", F.exp(c("_c") - F.max("_c").over(w)) - 1)
    days = F.greatest(F.lit(1), F.datediff(F.max("ts"), F.min("ts"))).cast("double")
    growth, mean = F.exp(F.sum(grown) * 365 / days) - 1, F.avg(x) * periods
    return df.groupBy(*by).agg(
        growth.alias("cagr"), ratio(mean, F.stddev_samp(x) * periods**0.5).alias("sharpe"), ratio(mean, F.stddev_samp(F.when(x < 0, x)) * periods**0.5).alias("sortino"), F.min("_d").alias("max_drawdown"),
        F.abs(ratio(growth, F.min("_d"))).alias("calmar"), F.avg(F.when(x != 0, (x > 0).cast("double"))).alias("win_rate"), F.sum("events").alias("events"),
    )


def next_open(df: DataFrame, bps: float = 5.0, lag_bars: int = 1) -> DataFrame:
    """``active, raw_ret, net_ret`` of orders filled at the open after the signal: open to close on the entry, close to close while held, the gap on the exit, and a cost on entry and exit."""
    df = df.withColumn("active", F.coalesce(lag("signal", lag_bars), F.lit(0)))
    before, close1 = lag("active"), lag("close")
    enters = (c("active") != 0) & ~c("active").eqNullSafe(before)
    leaves = (c("active") == 0) & ~F.coalesce(before == 0, F.lit(False))
    raw = F.when(enters, ratio(c("close"), c("open")) - 1).when(leaves, ratio(c("open"), close1) - 1).when(c("active") != 0, ratio(c("close"), close1) - 1).otherwise(0.0)
    df = df.withColumns({"raw_ret": raw, "_e": (enters | leaves).cast("int")})
    return df.withColumn("net_ret", c("raw_ret") * c("active") - c("_e") * bps / 10000).drop("_e")


def ar_filter(bars: DataFrame, window: int = 60, deadband: float = 0.05, least_t: float = 2.0, quantile: float = 0.8, eps: float = 0.0) -> DataFrame:
    """``phi, phi_t, vol, high_vol, regime, score`` of log returns: a rolling regression on the return before, and volatility against its own rolling quantile."""
    df = bars.withColumn("ret", F.ln(ratio(c("close"), lag("close")))).withColumn("_x", lag("ret"))
    frame = by_time().rowsBetween(-(window - 1), 0)
    full = F.count("_x").over(frame) == window
    df = df.withColumns({"_vx": F.when(full, F.var_samp("_x").over(frame)), "_my": F.when(full, F.avg("ret").over(frame)), "_mx": F.when(full, F.avg("_x").over(frame)), "_cv": F.when(full, F.covar_samp("_x", "ret").over(frame))})
    df = df.withColumn("phi", ratio(c("_cv"), c("_vx") + eps)).withColumn("_e", c("ret") - (c("_my") - c("phi") * c("_mx")) - c("phi") * c("_x"))
    sse = roll(c("_e") * c("_e"), F.sum, window)
    df = df.withColumn("phi_t", ratio(c("phi"), F.sqrt(ratio(sse / (window - 2), (window - 1) * c("_vx")))))
    df = df.withColumn("vol", roll("ret", F.stddev_samp, window))
    long = max(252, 3 * window)
    limit = roll("vol", lambda v: F.percentile(v, quantile), long, least=max(20, window))
    strong = F.coalesce(F.abs("phi_t") >= least_t, F.lit(False))
    df = df.withColumns({"high_vol": F.coalesce(c("vol") > limit, F.lit(False)), "regime": F.when(strong & (c("phi") > deadband), "momentum").when(strong & (c("phi") < -deadband), "mean_reversion").otherwise("neutral"), "score": F.greatest(F.lit(-10.0), F.least(F.lit(10.0), c("phi") * F.abs("phi_t")))})
    return df.drop("_x", "_vx", "_my", "_mx", "_cv", "_e")


#: Points of the likelihood grid: return before, shock and memory.
GARCH_GRID = [(phi, alpha, beta) for phi in (-0.2, 0.0, 0.2) for alpha in (0.05, 0.1, 0.2) for beta in (0.7, 0.8, 0.9) if alpha + beta < 1]


def garch_fit(bars: DataFrame, window: int = 756, grid: list[tuple[float, float, float]] = GARCH_GRID) -> DataFrame:
    """``mu, phi, omega, alpha, beta, persistence, loglik``: the grid's point of the best likelihood on the last ``window`` log returns, with the variance the residuals have.

    All points of all symbols are one pass of a linear recurrence keyed by both.
    """
    rows = bars.withColumn("ret", F.ln(ratio(c("close"), lag("close")))).where("ret is not null")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(c("_k") <= window)
    rows = rows.withColumn("mu", F.avg("ret").over(Window.partitionBy("symbol"))).select("symbol", "ts", "ret", "mu", lag("ret").alias("_r1"))
    points = F.explode(F.array(*(F.struct(F.lit(k).alias("point"), *(F.lit(float(v)).alias(n) for n, v in zip(("phi", "alpha", "beta"), p, strict=True))) for k, p in enumerate(grid))))
    rows = rows.select("*", points.alias("p")).select("symbol", "ts", "ret", "mu", "_r1", "p.*")
    rows = rows.withColumn("e", c("ret") - c("mu") - c("phi") * F.coalesce("_r1", F.lit(0.0)))
    by = Window.partitionBy("symbol", "point")
    rows = rows.withColumn("var", F.var_pop("e").over(by)).withColumns({"omega": c("var") * (1 - c("alpha") - c("beta")), "_e1": F.lag("e").over(by.orderBy("ts"))})
    rows = rows.withColumns({"_a": F.when(c("_e1").isNull(), 0.0).otherwise(c("beta")), "_b": F.when(c("_e1").isNull(), c("var")).otherwise(c("omega") + c("alpha") * c("_e1") * c("_e1"))})
    rows = linear_scan(rows, {"h": (c("_a"), c("_b"))}, ("symbol", "point"))
    like = -0.5 * (F.ln(2 * F.lit(math.pi)) + F.ln("h") + c("e") * c("e") / c("h"))
    sums = rows.groupBy("symbol", "point").agg(F.sum(like).alias("loglik"), *(F.first(x).alias(x) for x in ("mu", "phi", "omega", "alpha", "beta")))
    best = sums.groupBy("symbol").agg(F.max_by(F.struct("mu", "phi", "omega", "alpha", "beta", "loglik"), F.struct(F.round("loglik", 6), -c("point"))).alias("b"))
    return best.select("symbol", "b.*").withColumn("persistence", c("alpha") + c("beta"))


def garch_regimes(bars: DataFrame, window: int = 756, quantile: float = 0.8, lookback: int = 252, strong: float = 1.0) -> DataFrame:
    """``cond_vol, z, vol_regime, regime, combined`` of every bar: conditional volatility by the fitted recurrence, against its own rolling quantile, beside the direction of ``ar_filter``."""
    fit = garch_fit(bars, window).select("symbol", "mu", c("phi").alias("_phi"), "omega", "alpha", "beta")
    rows = ar_filter(bars, eps=1e-12).join(fit, "symbol")
    rows = rows.withColumn("_e", c("ret") - c("mu") - c("_phi") * F.coalesce(lag("ret"), F.lit(0.0))).withColumn("_e1", lag("_e"))
    long_run = c("omega") / (1 - c("alpha") - c("beta"))
    rows = rows.withColumns({"_a": F.when(c("_e1").isNull(), 0.0).otherwise(c("beta")), "_b": F.when(c("ret").isNotNull(), F.when(c("_e1").isNull(), long_run).otherwise(c("omega") + c("alpha") * c("_e1") * c("_e1")))})
    rows = linear_scan(rows, {"_h": (c("_a"), c("_b"))})
    rows = rows.withColumn("cond_vol", F.when(c("ret").isNotNull(), F.sqrt("_h"))).withColumn("z", ratio(c("_e"), c("cond_vol") + 1e-12))
    limit = roll("cond_vol", lambda v: F.percentile(v, quantile), lookback, least=max(20, lookback // 3))
    rows = rows.withColumn("vol_regime", F.when(c("cond_vol").isNull(), "unknown").when(F.coalesce(c("cond_vol") > limit, F.lit(False)), "high_vol").otherwise("normal_vol"))
    weak = F.coalesce(F.abs("score") < strong, F.lit(True))
    combined = F.when((c("vol_regime") == "high_vol") & weak, "risk_off").when((c("regime") == "momentum") & (c("vol_regime") == "normal_vol"), "trend_ok").when(c("regime") == "mean_reversion", "mean_reversion_risk").otherwise("neutral")
    return rows.select("symbol", "ts", "cond_vol", "z", "vol_regime", "regime", combined.alias("combined"))


def weight_sweep(bars: DataFrame, candidates: int = 200, seed: int = 42, rate: float = 0.0) -> DataFrame:
    """Equal, least-variance and best-Sharpe long-only weights: ``kind, symbol, weight``.

    The optima are the best of a fixed table of candidates: each symbol alone, equal weights, and
    ``candidates`` draws spread evenly over all weightings, from digests of seed, number and place.
    A candidate's variance is a sum over the pairwise covariances of returns.
    """
    rets = bars.withColumn("ret", ratio(c("close"), lag("close")) - 1).where("ret is not null").select("symbol", "ts", "ret")
    a, b = (rets.select("ts", c("symbol").alias(n), c("ret").alias(f"r{n}")) for n in "ab")
    cov = a.join(b, "ts").groupBy("a", "b").agg((F.covar_samp("ra", "rb") * YEAR).alias("cov"))
    mean = rets.groupBy("symbol").agg((F.avg("ret") * YEAR).alias("mu"))
    named = mean.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("symbol")) - 1)  # one row a symbol
    named = named.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c("k").cast("string"), c("i").cast("string")).cast("binary")), 1, 8)
    drawn = -F.ln((F.conv(digits, 16, 10).cast("double") + 1) / 4294967297.0)
    each = named.withColumn("k", F.explode(F.sequence(-c("n"), F.lit(candidates)).cast("array<int>")))
    each = each.withColumn("_w", F.when(c("k") == 0, 1.0).when(c("k") < 0, F.when(c("i") == -c("k") - 1, 1.0).otherwise(0.0)).otherwise(drawn))
    each = each.withColumn("w", c("_w") / F.sum("_w").over(Window.partitionBy("k"))).select("k", "symbol", "mu", "w")
    left, right = each.select("k", c("symbol").alias("a"), c("w").alias("wa")), each.select("k", c("symbol").alias("b"), c("w").alias("wb"))
    variance = left.join(cov, "a").join(right, ["k", "b"]).groupBy("k").agg(F.sum(c("wa") * c("wb") * c("cov")).alias("variance"))
    found = each.groupBy("k").agg(F.sum(c("w") * c("mu")).alias("mean")).join(variance, "k").withColumn("sharpe", ratio(c("mean") - rate, F.sqrt("variance")))
    best = found.agg(F.min_by("k", F.struct(F.round("variance", 9), "k")).alias("min_variance"), F.max_by("k", F.struct(F.round("sharpe", 9), -c("k"))).alias("max_sharpe"), F.lit(0).alias("equal"))
    best = best.unpivot([], ["min_variance", "max_sharpe", "equal"], "kind", "k")
    return each.join(best, "k").select("kind", "symbol", c("w").alias("weight"))
