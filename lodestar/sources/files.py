"""Bar files: vendor columns by name, bar rows without header, merging and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The names that vendors give to each column.
NAMES = {
    "symbol": ("symbol", "raw_symbol", "instrument", "ticker"),
    "ts": ("ts_event", "timestamp", "datetime", "time", "date"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "price"),
    "volume": ("volume", "size", "qty", "quantity", "vol"),
    "tick_volume": ("tickvol", "tick_volume", "ticks"),
}
NEEDED = ("ts", "open", "high", "low", "close")
BAR_FILE = "date string, time string, open string, high string, low string, close string, tick_volume string, volume string, spread string"


def resolve(columns: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Which given column stands for which of ours, whatever the case; an error names all that are missing."""
    lower = {c.lower(): c for c in columns}
    found = {}
    for ours, names in NAMES.items():
        wanted = (overrides or {}).get(ours)
        hit = lower.get(wanted.lower()) if wanted else next((lower[n] for n in names if n in lower), None)
        if hit:
            found[ours] = hit
        elif wanted:
            raise ValueError(f"no column {wanted!r} for {ours}")
    missing = [n for n in NEEDED if n not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found


def to_bars(raw: DataFrame, overrides: dict[str, str] | None = None, volume: float = 0.0, tick_volume: float = 1.0) -> DataFrame:
    """Vendor rows as bars; what doesn't parse becomes null and drops the row if it is needed."""
    of = resolve(raw.columns, overrides)
    number = lambda n, default=None: F.coalesce(F.expr(f"try_cast(`{of[n]}` as double)"), F.lit(default)) if n in of else F.lit(default).cast("double")
    name = F.coalesce(F.col(f"`{of['symbol']}`").cast("string"), F.lit("UNKNOWN")) if "symbol" in of else F.lit("UNKNOWN")
    ts = F.expr(f"try_cast(`{of['ts']}` as timestamp)")
    out = raw.select(name.alias("symbol"), ts.alias("ts"), *(number(n).alias(n) for n in ("open", "high", "low", "close")), number("volume", volume).alias("volume"), number("tick_volume", tick_volume).alias("tick_volume"))
    return out.na.drop(subset=list(NEEDED))


def conversion_report(raw: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``given, written, dropped``: rows before and after ``to_bars``."""
    given, kept = raw.agg(F.count("*").alias("given")), to_bars(raw, overrides).agg(F.count("*").alias("written"))
    return given.join(kept).withColumn("dropped", F.col("given") - F.col("written"))  # one row each


def read_vendor(spark: SparkSession, path: str, overrides: dict[str, str] | None = None) -> DataFrame:
    return to_bars(spark.read.option("header", True).csv(path), overrides)


def read_bars(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """Bar files without header (an embedded one is dropped): date ``yyyy.MM.dd``, time ``HH:mm`` and seven numbers; the symbol is the file's name."""
    reader = spark.read.schema(BAR_FILE)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.csv(path).where(F.lower("date") != "date")
    number = lambda n: F.expr(f"try_cast({n} as double)").alias(n)
    out = rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("symbol"), F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm")).alias("ts"), *map(number, ("open", "high", "low", "close", "tick_volume", "volume", "spread")))
    return out.na.drop(subset=list(NEEDED))


def file_kind(spark: SparkSession, path: str) -> str:
    """``bars`` if the first field of the first line is a date with dots, else ``vendor``."""
    first = spark.read.text(path).limit(1).select(F.col("value").rlike(r"^\d{4}\.\d{2}\.\d{2},").alias("x")).first()
    return "bars" if first and first.x else "vendor"


def safe_name(symbol: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(symbol), r"[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("UNKNOWN"))


def write_bars(df: DataFrame, path: str, by: tuple[str, ...] = ("symbol",)) -> None:
    out = df.withColumn("symbol", safe_name(F.col("symbol"))) if "symbol" in by else df
    out.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def merge_keep_last(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables with one row for each symbol and time, the new table's where both have one."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc("_age"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_age")


def missing_ranges(have: DataFrame, start: str, end: str) -> DataFrame:
    """For each symbol what lies between the wanted range and the stored one: ``symbol, part, from_ts, to_ts``."""
    span = have.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    a, b = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    parts = F.array(F.when(a < F.col("first"), F.struct(F.lit("head").alias("part"), a.alias("from_ts"), F.col("first").alias("to_ts"))), F.when(F.col("last") < b, F.struct(F.lit("tail").alias("part"), F.col("last").alias("from_ts"), b.alias("to_ts"))))
    return span.select("symbol", F.explode(F.array_compact(parts)).alias("p")).select("symbol", "p.*")


def filled(df: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Lower-case names, gaps filled forward per symbol, then with 0."""
    df = df.toDF(*(c.lower() for c in df.columns))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})


def write_report(df: DataFrame, path: str, kind: str = "csv", header: bool = True, separator: str = ",") -> None:
    """A report as CSV (with or without header), Parquet or JSON lines."""
    out = df.write.mode("overwrite")
    if kind == "csv":
        out.option("header", header).option("sep", separator).csv(path)
    elif kind == "json":
        out.json(path)
    else:
        out.parquet(path)


def span_summary(bars: DataFrame) -> DataFrame:
    """Rows, first and last time of each symbol, as columns instead of parts of a file's name."""
    return bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def crosswalk(spark: SparkSession, groups: dict[str, dict[str, str]]) -> DataFrame:
    """``instrument_group, symbol, vendor_symbol`` of groups of instruments (forex, crypto, funds, futures, indexes), symbol by vendor's name."""
    rows = [(g, ours, theirs) for g, names in groups.items() for ours, theirs in names.items()]
    return spark.createDataFrame(rows, "instrument_group string, symbol string, vendor_symbol string")


def with_our_symbols(bars: DataFrame, names: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Bars of the chosen groups under our symbols; the list of names is a small table, so Spark sends it to all tasks by its own threshold."""
    some = names if groups is None else names.where(F.col("instrument_group").isin(groups))
    other = some.select(F.col("vendor_symbol").alias("symbol"), F.col("symbol").alias("_ours"), "instrument_group")
    return bars.join(other, "symbol").withColumn("symbol", F.col("_ours")).drop("_ours")
