"""URL filter rules by expanded expressions and short hash prefixes.

A URL is expanded into every suffix of its host at a label boundary, joined with every
prefix of its path whose length some rule's path has.  Expressions and rules meet by an
equi-join on the first eight hex digits of their SHA-256; the full digests are compared
afterwards, and of the rules that fit the longest wins (then the longer host, then a block).

Defined cases: a null URL, or one without ``://``, has an empty host and path, which no rule
fits; repeated rows are judged alike; rules that repeat count once; no rules, or no rule that
fits: the default verdict; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import ascii_lower

PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.char_length(url))), F.lit(""))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All host suffixes with all path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; ``rules`` has ``host, path, verdict``."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect())  # as many as a path is long, at most
    if not lengths:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    of_rules = rules.select(F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_chars"), F.col("verdict").alias("rule_verdict"))
    of_rules = of_rules.distinct().withColumn("rule_digest", digest(F.col("rule"))).withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    kinds = rows.select("host", "path").distinct()
    mine = kinds.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
    mine = mine.withColumn("digest", digest(F.col("expression"))).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)).drop("expression")
    met = mine.join(of_rules, "short").where("digest = rule_digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), "host_chars", "rule_verdict", "rule")).alias("best"))
    # rows without a host fit no rule; they are dealt by their id instead of to one key
    spread = F.when(F.col("host") == "", F.concat(F.lit(" "), (F.xxhash64("page_id") % 4096).cast("string"))).otherwise(F.col("host"))
    best = best.select(F.col("host").alias("key"), "path", "best")
    out = rows.withColumn("key", spread).join(best, ["key", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
