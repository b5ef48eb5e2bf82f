"""Contracts: classification, roll dates by calendar and by volume, continuous series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The month codes of futures.
MONTHS = dict(zip("FGHJKMNQUVXZ", range(1, 13), strict=True))


def classify(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """``kind`` (spread, outright, unknown), and of outrights ``root, exp_year, exp_month``."""
    s = F.upper(F.col(symbol))
    outright = s.rlike("^[A-Z]+[FGHJKMNQUVXZ][0-9]{1,2}$")
    part = lambda k: F.when(outright, F.regexp_extract(s, "^([A-Z]+)([FGHJKMNQUVXZ])([0-9]{1,2})$", k))
    year = part(3).cast("int")
    full = F.when(year < 70, year + 2000).otherwise(year + 1900)
    month = F.element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), part(2))
    return df.withColumns({"kind": F.when(s.contains("-"), "spread").when(outright, "outright").otherwise("unknown"), "root": part(1), "exp_year": full, "exp_month": month})


def third_friday(year: Column, month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), "FRI"), 14)


def roll_dates(bars: DataFrame, crossover: int = 2, least_overlap: int = 3, days_before: int = 7) -> DataFrame:
    """For each contract but the last of its root: the day to leave it for the next one.

    By volume: the start of the first run of ``crossover`` common days on which the next contract
    trades more, if they have ``least_overlap`` common days; else the third Friday of the next
    contract's month less ``days_before`` days.  ``bars`` has ``root, contract, exp_year, exp_month, ts, volume``.
    """
    order = Window.partitionBy("root").orderBy("exp_year", "exp_month", "contract")
    contracts = bars.select("root", "contract", "exp_year", "exp_month").distinct()
    contracts = contracts.withColumns({"next": F.lead("contract").over(order), "next_year": F.lead("exp_year").over(order), "next_month": F.lead("exp_month").over(order)}).where("next is not null")
    daily = bars.groupBy("root", "contract", F.to_date("ts").alias("day")).agg(F.sum("volume").alias("volume"))
    front = contracts.join(daily, ["root", "contract"])
    other = daily.select("root", F.col("contract").alias("next"), "day", F.col("volume").alias("next_volume"))
    both = front.join(other, ["root", "next", "day"])
    run = Window.partitionBy("root", "contract").orderBy("day")
    both = both.withColumn("on", F.col("next_volume") > F.col("volume"))
    both = both.withColumn("group", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("length", F.sum(F.col("on").cast("int")).over(Window.partitionBy("root", "contract", "group").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    found = both.groupBy("root", "contract").agg(F.count("*").alias("overlap"), F.min(F.when(F.col("length") >= crossover, F.date_sub("day", crossover - 1))).alias("crossed"))
    out = contracts.join(found, ["root", "contract"], "left")
    calendar = F.date_sub(third_friday(F.col("next_year"), F.col("next_month")), days_before)
    by_volume = F.when(F.col("overlap") >= least_overlap, F.col("crossed"))
    return out.select("root", "contract", "exp_year", "exp_month", "next", F.coalesce(by_volume, calendar).alias("roll"), F.when(by_volume.isNotNull(), "volume").otherwise("calendar").alias("method"))


def continuous(bars: DataFrame, rolls: DataFrame) -> DataFrame:
    """The bars of each contract from the roll into it up to the roll out of it, the later contract on equal times."""
    order = Window.partitionBy("root").orderBy("exp_year", "exp_month", "contract")
    out = rolls.select("root", F.col("next").alias("contract"), F.col("roll").alias("begin"))
    ends = rolls.select("root", "contract", F.col("roll").alias("end"))
    contracts = bars.select("root", "contract", "exp_year", "exp_month").distinct().withColumn("rank", F.row_number().over(order))
    spans = contracts.join(out, ["root", "contract"], "left").join(ends, ["root", "contract"], "left").select("root", "contract", "rank", "begin", "end")
    day = F.to_date("ts")
    kept = bars.join(spans, ["root", "contract"]).where((F.col("begin").isNull() | (day >= F.col("begin"))) & (F.col("end").isNull() | (day < F.col("end"))))
    last = Window.partitionBy("root", "ts").orderBy(F.desc("rank"))
    return kept.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("root", "ts", "contract", "open", "high", "low", "close", "volume")


def merge_report(raw: DataFrame, cleaned: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Bars read, dropped as spikes, dropped as duplicates and written, per symbol."""
    counts = [d.groupBy("symbol").agg(F.count("*").alias(n)) for d, n in ((raw, "read"), (cleaned, "after_filter"), (deduplicated, "written"))]
    out = counts[0].join(counts[1], "symbol", "left").join(counts[2], "symbol", "left")
    return out.select("symbol", "read", (F.col("read") - F.coalesce("after_filter", F.lit(0))).alias("spikes"), (F.coalesce("after_filter", F.lit(0)) - F.coalesce("written", F.lit(0))).alias("duplicates"), F.coalesce("written", F.lit(0)).alias("written"))
