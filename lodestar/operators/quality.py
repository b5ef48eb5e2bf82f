"""Quality checks of raw bars, cleaned outputs and table profiles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.windows import by_time, ratio

#: The checks by severity.
SEVERE = ("invalid_datetime", "missing_ohlc", "non_positive_ohlc", "ohlc_structure_violation", "duplicate_datetime")
WARNING = ("outlier_return", "flat_bar")
INFO: tuple[str, ...] = ()

#: Rows of a symbol in a chunk of the rolling medians.
CHUNK = 20_000


def robust_z(df: DataFrame, col: Column, name: str, window: int = 100, least: int = 30, scale: float = 1.4826, chunk: int = CHUNK) -> DataFrame:
    """``name``: distance of ``col`` from its rolling median in units of scale times the rolling median deviation.

    A symbol's rows are cut into chunks, each with the rows before it that its first windows reach
    into, and the medians of a chunk are rolled in one pass; no task holds more than a chunk.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    rows = df.withColumn("_x", col.cast("double")).withColumn("_i", F.row_number().over(w) - 1).withColumn("_c", F.floor(F.col("_i") / chunk))
    reach, given = 2 * (window - 1), df.columns
    spots = F.array(F.struct(F.col("_c").alias("c"), F.lit(True).alias("own")), F.when(F.col("_i") % chunk >= chunk - reach, F.struct((F.col("_c") + 1).alias("c"), F.lit(False).alias("own"))))
    rows = rows.select(*df.columns, "_x", "_i", F.explode(F.array_compact(spots)).alias("_s")).select(*df.columns, "_x", "_i", F.col("_s.c").alias("_c"), F.col("_s.own").alias("_own"))

    def roll(part: pa.Table) -> pa.Table:
        part = part.sort_by("_i")
        x = part.column("_x").to_pandas()
        away = (x - x.rolling(window, min_periods=least).median()).abs()
        spread = scale * away.rolling(window, min_periods=least).median()
        z = (away / spread.where(spread != 0)).to_numpy(float)
        out = part.select(given).append_column(name, pa.array(z, pa.float64(), from_pandas=True))
        return out.filter(part.column("_own"))

    made = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField(name, T.DoubleType())])
    return rows.groupBy("symbol", "_c").applyInArrow(roll, made)


def qc_checks(raw: DataFrame, window: int = 100, least: int = 30, z: float = 8.0) -> DataFrame:
    """Boolean columns for each check; ``raw`` has ``symbol, ts, seq, open, high, low, close, volume``."""
    prices = [F.col(x) for x in ("open", "high", "low", "close")]
    missing = prices[0].isNull() | prices[1].isNull() | prices[2].isNull() | prices[3].isNull()
    low_any = F.least(*prices) <= 0
    broken = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    df = raw.withColumns({
        "invalid_datetime": F.col("ts").isNull(), "missing_ohlc": missing, "non_positive_ohlc": F.coalesce(low_any, F.lit(False)), "ohlc_structure_violation": F.coalesce(~missing & broken, F.lit(False)),
        "flat_bar": F.coalesce((F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close")), F.lit(False)),
        "duplicate_datetime": F.col("ts").isNotNull() & (F.count("*").over(Window.partitionBy("symbol", "ts")) > 1),
    })
    move = F.abs(ratio(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("ts", "seq"))) - 1)
    df = df.withColumn("_move", move)
    df = robust_z(df, F.col("_move"), "_z", window, least).drop("_move")
    return df.withColumn("outlier_return", F.coalesce(F.col("_z") > z, F.lit(False))).drop("_z")


def masks(checked: DataFrame) -> DataFrame:
    some = lambda names: F.greatest(*(F.col(n) for n in names)) if len(names) > 1 else F.col(names[0])
    return checked.withColumns({"severe": some(SEVERE), "warning": some(WARNING)})


def qc_summary(checked: DataFrame) -> DataFrame:
    each = [F.sum(F.col(n).cast("bigint")).alias(n) for n in (*SEVERE, *WARNING, *INFO)]
    split = {"flagged": F.col("severe") | F.col("warning"), "severe_rows": F.col("severe"), "warning_rows": F.col("warning")}
    sums = {k: F.sum(v.cast("bigint")) for k, v in split.items()}
    shares = [x for k, v in sums.items() for x in (v.alias(k), (100.0 * v / F.count("*")).alias(f"{k}_pct"))]
    return masks(checked).groupBy("symbol").agg(F.count("*").alias("rows"), *shares, *each)


def qc_detail(checked: DataFrame) -> DataFrame:
    """A row for each bar and issue, with its severity."""
    issues = F.array(*(F.when(F.col(n), F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for s, names in (("severe", SEVERE), ("warning", WARNING), ("info", INFO)) for n in names))
    return checked.select("symbol", "ts", "seq", F.explode(F.array_compact(issues)).alias("i")).select("symbol", "ts", "seq", "i.issue", "i.severity")


def qc_daily(checked: DataFrame) -> DataFrame:
    return qc_detail(checked).groupBy("symbol", "issue", "severity", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


def qc_counts(checked: DataFrame) -> DataFrame:
    """Counts per check over all symbols, in one pass."""
    sums = checked.agg(F.count("*").alias("rows"), *(F.sum(F.col(n).cast("bigint")).alias(n) for n in (*SEVERE, *WARNING, *INFO)))
    return sums.unpivot("rows", [*SEVERE, *WARNING, *INFO], "check", "n").withColumn("pct", 100.0 * F.col("n") / F.col("rows"))


def clean(checked: DataFrame, mode: str = "severe") -> DataFrame:
    """Bars without severe faults, or without severe faults and warnings (``mode='warning'``)."""
    df = masks(checked)
    bad = F.col("severe") if mode == "severe" else F.col("severe") | F.col("warning")
    return df.where(~bad).select("symbol", "ts", "seq", "open", "high", "low", "close", "volume")


def drop_spikes(raw: DataFrame, col: str = "open", scale: float = 1.1, window: int = 100, least: int = 30, z: float = 8.0) -> DataFrame:
    return robust_z(raw, F.col(col), "_z", window, least, scale).where(F.coalesce(F.col("_z") <= z, F.lit(True))).drop("_z")


def keep_last(raw: DataFrame) -> DataFrame:
    """One bar for each symbol and time, the last by ``seq``."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc("seq"))
    return raw.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: missing values, distinct ones, and of numbers least, greatest, mean, zeros and negatives."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    aggs = [F.count("*").alias("rows")]
    for k, (n, number) in enumerate(kinds.items()):
        x = F.col(f"`{n}`")
        aggs += [F.count(x).alias(f"c{k}"), F.approx_count_distinct(x).alias(f"d{k}")]
        aggs += [F.min(x).cast("double").alias(f"l{k}"), F.max(x).cast("double").alias(f"h{k}"), F.avg(x).alias(f"a{k}"), F.sum((x == 0).cast("bigint")).alias(f"z{k}"), F.sum((x < 0).cast("bigint")).alias(f"n{k}")] if number else [F.lit(None).cast(t).alias(f"{p}{k}") for p, t in (("l", "double"), ("h", "double"), ("a", "double"), ("z", "bigint"), ("n", "bigint"))]
    wide = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(n).alias("column"), (F.col("rows") - F.col(f"c{k}")).alias("missing"), (100.0 * (F.col("rows") - F.col(f"c{k}")) / F.col("rows")).alias("missing_pct"), F.col(f"d{k}").alias("distinct_about"), F.col(f"l{k}").alias("least"), F.col(f"h{k}").alias("greatest"), F.col(f"a{k}").alias("mean"), F.col(f"z{k}").alias("zeros"), F.col(f"n{k}").alias("negatives")) for k, n in enumerate(kinds)))
    return wide.select("rows", F.explode(rows).alias("r")).select("rows", "r.*")


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The n most frequent values of each column, ties by value."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in columns))).alias("e")).select("e.*").where("value is not null")
    counts = long.groupBy("column", "value").count().withColumnRenamed("count", "n")
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def duplicate_rows(df: DataFrame) -> DataFrame:
    keys = [F.col(x) for x in df.columns]
    return df.groupBy(*keys).count().agg(F.sum("count").alias("rows"), (F.sum("count") - F.count("*")).alias("duplicates"))


def coverage(bars: DataFrame, n: int = 250) -> DataFrame:
    """Share of the last n times of the whole universe at which each symbol has a bar."""
    times = bars.select("ts").distinct().orderBy(F.desc("ts")).limit(n)
    return bars.join(F.broadcast(times), "ts", "left_semi").groupBy("symbol").agg((F.countDistinct("ts") / F.lit(float(n))).alias("coverage"))


def bar_size(bars: DataFrame) -> DataFrame:
    """Median distance of bars in seconds, its label, and bars a year."""
    step = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(by_time()))
    rows = bars.select("symbol", step.alias("step")).where("step is not null").groupBy("symbol").agg(F.percentile("step", 0.5).alias("seconds"))
    s = F.col("seconds")
    label = F.when(s < 300, "1m").when(s < 900, "5m").when(s < 1800, "15m").when(s < 3600, "30m").when(s < 14400, "1h").when(s < 86400, "4h").otherwise("D")
    return rows.withColumn("label", label).withColumn("per_year", 252.0 * F.when(s >= 86400, 1.0).otherwise(23400.0 / s))
