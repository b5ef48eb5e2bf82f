"""Instrument pairs: correlation by lag, hedge ratio, half-life and unit-root statistic of the spread, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.windows import by_time, ffill, ratio
from lodestar.operators import tiles

c = F.col


def grid_returns(bars: DataFrame, last: int | None = 1000) -> DataFrame:
    """Close and log return of every symbol at each of the last times (None: all) of the universe, filled forward: ``symbol, ts, i, close, ret``."""
    times = bars.select("ts").distinct()
    times = (times if last is None else times.orderBy(F.desc("ts")).limit(last)).withColumn("k", F.lit(1))
    times = times.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("ts"))).drop("k")  # one row a time
    symbols = bars.select("symbol").distinct()
    full = symbols.join(times if last is None else F.broadcast(times)).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    full = full.withColumn("close", ffill("close"))
    return full.withColumn("ret", F.ln(ratio(c("close"), F.lag("close").over(by_time())))).where("ret is not null").select("symbol", "ts", "i", "close", "ret")


def correlations(rows: DataFrame | tiles.Packed, least: float = 0.0) -> DataFrame:
    """Correlation of the returns of each two symbols (``a < b``), by products of tiles; packed rows can serve ``best_lags`` as well."""
    packed = rows if isinstance(rows, tiles.Packed) else tiles.pack(rows, 0)
    sums = tiles.lag_sums(packed, None, 0).withColumn("corr", tiles.correlation())
    return sums.select("a", "b", "corr", "n").where(F.abs("corr") >= least)


def best_lags(rows: DataFrame | tiles.Packed, pairs: DataFrame, max_lag: int = 20, least: int = 30) -> DataFrame:
    """For each pair the lag of the largest absolute correlation (the least lag on ties) and who leads, by products of tiles."""
    packed = rows if isinstance(rows, tiles.Packed) else tiles.pack(rows, max_lag)
    by_lag = tiles.lag_sums(packed, pairs.select("a", "b"), max_lag).withColumn("corr", tiles.correlation()).where((c("n") >= least) & c("corr").isNotNull())
    best = by_lag.groupBy("a", "b").agg(F.max_by(F.struct("lag", "corr"), F.struct(F.round(F.abs("corr"), 9), -c("lag"))).alias("x"))
    leader = F.when(c("x.lag") > 0, c("a")).when(c("x.lag") < 0, c("b"))
    return best.select("a", "b", c("x.lag").alias("lag"), c("x.corr").alias("corr"), leader.alias("leader"))


def spreads(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hedge alpha and beta of log prices, half-life and Dickey-Fuller statistic of the spread of each pair."""
    a, b = (rows.select(c("symbol").alias(n), "i", F.ln("close").alias(f"l{n}")) for n in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, ["b", "i"])
    fit = both.groupBy("a", "b").agg(F.regr_slope("la", "lb").alias("beta"), F.regr_intercept("la", "lb").alias("alpha"))
    w = Window.partitionBy("a", "b").orderBy("i")
    s = both.join(fit, ["a", "b"]).withColumn("s", c("la") - c("alpha") - c("beta") * c("lb"))
    s = s.withColumn("s1", F.lag("s").over(w)).where("s1 is not null").withColumn("d", c("s") - c("s1"))
    g = s.groupBy("a", "b").agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.count("*").alias("n"), F.regr_slope("d", "s1").alias("k"), F.regr_sxx("d", "s1").alias("sxx"), F.regr_syy("d", "s1").alias("syy"))
    rest = (c("syy") - c("k") * c("k") * c("sxx")) / (c("n") - 2)
    return g.select("a", "b", "alpha", "beta", "n", F.when(c("k") < 0, -F.ln(F.lit(2.0)) / c("k")).alias("half_life"), ratio(c("k"), F.sqrt(ratio(rest, c("sxx")))).alias("t")).withColumn("cointegrated", c("t") < -3.34)


def _cut(df: DataFrame) -> DataFrame:
    """``df`` computed, with nothing of its plan left: in the session's checkpoint folder, or else where the executors keep it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def clusters(pairs: DataFrame, symbols: DataFrame, threshold: float) -> DataFrame:
    """Connected groups of symbols whose returns correlate above the threshold: ``symbol, cluster, size``.

    Least labels travel along the edges, and on to the labels of labels, until nothing changes; the tables are as long as the list of symbols.
    Each round starts from a table, not from the plan of the rounds before, which the driver would hold several times over.
    """
    edges = pairs.where(c("corr") > threshold).select("a", "b")
    both = _cut(edges.unionByName(edges.select(c("b").alias("a"), c("a").alias("b"))))
    labels = _cut(symbols.select("symbol", c("symbol").alias("cluster")))
    while True:
        near = both.join(labels.withColumnsRenamed({"symbol": "b", "cluster": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        after = _cut(labels.join(near.withColumnRenamed("a", "symbol"), "symbol", "left").select("symbol", F.least("cluster", "near").alias("after"), "cluster"))
        if after.where("after <> cluster").isEmpty():
            return labels.withColumn("size", F.count("*").over(Window.partitionBy("cluster")))
        up = after.select(c("symbol").alias("after"), c("after").alias("up"))
        labels = _cut(after.join(up, "after", "left").select("symbol", F.coalesce("up", "after").alias("cluster")))


def factor_quantiles(bars: DataFrame, ahead: int = 5, q: int = 2) -> DataFrame:
    """Mean forward return by cross-sectional quantile of the last return."""
    rows = bars.withColumns({"f": ratio(c("close"), F.lag("close").over(by_time())) - 1, "fwd": ratio(F.lead("close", ahead).over(by_time()), c("close")) - 1}).where("f is not null and fwd is not null")
    rows = rows.withColumn("bin", F.ntile(q).over(Window.partitionBy("ts").orderBy("f", "symbol")))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("fwd").alias("fwd_mean"))
