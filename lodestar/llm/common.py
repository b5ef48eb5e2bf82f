"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words, space and the controls 09 to 0D.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none it is made here, which only a local master can do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's own setting for removing the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    With ``drop_shuffles`` the shuffle files that the write needed go when it ends, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or what comes of it when ``df`` has no column called so."""
    while name in df.columns:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the text '' (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def connected(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``edges(a, b)``; root is the least node reachable.

    Each round every node hooks onto its least neighbour, two pointer jumps shorten the
    chains, and the graph is contracted to the roots, so the nodes at least halve.  The
    rounds' tables go through the shared folder; nothing is collected but one emptiness bit.
    """
    live = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        hook = cut(hook, "hook")
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("a", F.col("pp").alias("p"))
        hook = cut(hook, "hook")
        if found is None:
            found = hook.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = hook.select(F.col("a").alias("root"), F.col("p").alias("to"))
            found = found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        found = cut(found, "roots")
        for end in ("a", "b"):
            to = hook.select(F.col("a").alias(end), F.col("p").alias("to"))
            live = live.join(to, end).withColumn(end, F.col("to")).drop("to")
        live = cut(live.where("a <> b").distinct(), "edges")
    if found is None:
        found = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
