"""Bars, ticks, contracts and odds from the given tables, each as a Spark view and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.resample import daily

SYMBOLS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, symbols: int = SYMBOLS) -> DataFrame:
    """Line items as trades: ``symbol, ts, price, volume, seq``."""
    rows = table(spark, sf_dir, "lineitem")
    symbol = F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % symbols).cast("string"), 2, "0"))
    return rows.select(symbol.alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))


def bars(spark: SparkSession, sf_dir: str, symbols: int = SYMBOLS) -> DataFrame:
    """Daily bars of the trades: ``symbol, ts, open, high, low, close, volume``."""
    return daily(trades(spark, sf_dir, symbols))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: ``symbol, ts, price, volume, seq``."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(1.0)).alias("volume"), F.col("event_id").alias("seq"))


TRADES_SQL = f"""trades AS (
  SELECT 'S' || lpad((l_suppkey % {SYMBOLS})::VARCHAR, 2, '0') AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_quantity AS volume, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
BARS_SQL = f"""{TRADES_SQL},
bars AS (
  SELECT symbol, ts, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(volume) AS volume
  FROM trades GROUP BY symbol, ts)"""
TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, ts, value AS price, coalesce(json_extract_string(props, '$.k')::DOUBLE, 1.0::DOUBLE) AS volume, event_id AS seq FROM events)"""
