"""Bookmaker odds: nested events to rows, best prices, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
_OUTCOME = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("point", T.DoubleType())])
_MARKET = T.StructType([T.StructField("key", T.StringType()), T.StructField("outcomes", T.ArrayType(_OUTCOME))])
_BOOK = T.StructType([T.StructField("title", T.StringType()), T.StructField("markets", T.ArrayType(_MARKET))])
EVENT = T.StructType([T.StructField("home_team", T.StringType()), T.StructField("away_team", T.StringType()), T.StructField("commence_time", T.StringType()), T.StructField("bookmakers", T.ArrayType(_BOOK))])


def flatten(events: DataFrame, column: str = "json") -> DataFrame:
    """A row for each outcome of the JSON events: game, start, book, market, team (with its point), price, implied chance."""
    rows = events.select(F.from_json(column, EVENT).alias("e")).select("e.*", F.explode("e.bookmakers").alias("b"))
    rows = rows.select("home_team", "away_team", "commence_time", c("b.title").alias("book"), F.explode("b.markets").alias("m"))
    rows = rows.select("*", c("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    team = F.when(c("market").isin("spreads", "totals") & c("o.point").isNotNull(), F.concat_ws(" ", c("o.name"), c("o.point").cast("string"))).otherwise(c("o.name"))
    return rows.select(F.concat(c("away_team"), F.lit(" @ "), c("home_team")).alias("game"), F.try_to_timestamp("commence_time").alias("start"), "book", "market", team.alias("team"), c("o.price").alias("price"), F.try_divide(F.lit(1.0), c("o.price")).alias("implied"))


def by_book(odds: DataFrame, books: list[str]) -> DataFrame:
    return odds.groupBy("game", "team", "market").pivot("book", books).agg(F.avg("price"))


def best_prices(odds: DataFrame) -> DataFrame:
    """The highest price of each game, market and team, and the first book by name that offers it."""
    top = odds.groupBy("game", "market", "team").agg(F.max("price").alias("price"))
    return odds.join(top, ["game", "market", "team", "price"]).groupBy("game", "market", "team", "price").agg(F.min("book").alias("book"))


def snapshot(odds: DataFrame) -> DataFrame:
    """Average price, its rank within game and market, and favourite or underdog."""
    mean = odds.groupBy("game", "market", "team").agg(F.avg("price").alias("avg_price"), F.count("*").alias("quotes"))
    rank = F.row_number().over(Window.partitionBy("game", "market").orderBy(F.round("avg_price", 9), "team"))
    return mean.withColumn("rank", rank).withColumn("role", F.when(c("rank") == 1, "favourite").otherwise("underdog"))


def quoted_by(odds: DataFrame, book: str) -> DataFrame:
    """The rows of games that one book quotes."""
    return odds.join(odds.where(c("book") == book).select("game").distinct(), "game", "left_semi")


def with_snapshot(odds: DataFrame) -> DataFrame:
    """Every quote with the average, rank and role of its team; quotes without a game, market or team have none."""
    return odds.join(snapshot(odds), ["game", "market", "team"], "left")


def favourites(odds: DataFrame, book: str) -> DataFrame:
    """All books' quotes of the favourites, in the games that one book quotes."""
    return quoted_by(with_snapshot(odds), book).where("rank = 1")
