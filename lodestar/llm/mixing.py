"""Mixing sources to target weights by capped water-filling.

A source's target is its share of all words by weight, clamped at ``max_epochs`` times its
size; what clamped sources leave is shared again by weight among the others until none is
above its cap.  A document is taken whole as often as its source's ratio of target to size
is whole; for the fraction, documents are taken once more in a seeded order until the
target is met, the last one with as many of its words as are missing.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source
of its own, ordered last; rows of one id are ordered by size, rows without an id by their texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, 0, 1, ... in ``order``: a range shuffle, then places within each part."""
    parts = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    before = parts.groupBy("part").count()  # a row for each partition
    before = before.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("place", within - 1).join(F.broadcast(before), "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """``sources`` (with ``weight`` and ``source_size``) and the double ``target``; one row of sums a round."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    totals = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = float(totals[0] or 0), None
    free = float(totals[1] or 0)
    rest = total
    while free > 0:
        level = rest / free
        over = F.col("weight") * F.lit(level) > cap
        got = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        now_rest, now_free = total - (got[0] or 0.0), float(got[1] or 0)
        if now_free == free:
            break
        rest, free = now_rest, now_free
    share = F.lit(0.0) if level is None else F.least(F.col("weight") * F.lit(level), cap)
    return sources.withColumn("target", share.cast("double"))


def _size() -> Column:
    return word_count(F.col("text"))


def _draw(seed: str) -> Column:
    """The seeded place of a row; rows without an id are told apart by their texts."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def _slots(rows: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """For each ``of`` (source) and ``of_slot`` of ``rows`` the source's sums and target, and the words of the slots before."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(water_fill(cut(sources.withColumn("weight", weight), "sources"), max_epochs), "targets")
    ratio = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    sources = sources.withColumn("epochs", F.coalesce(F.floor(ratio), F.lit(0)))
    sources = sources.withColumn("words", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size"))
    # the seeded order, cut by its first three hex digits: sums of 4096 slots a source, then places within a slot
    slots = rows.groupBy("source", F.substring("draw", 1, 3).alias("slot")).agg(F.sum("size").alias("slot_size"))
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("source", "slot", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0)).alias("ahead"))
    key = slots.join(sources.select(F.col("source").alias("of"), "source_size", "target", "epochs", "words"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return key.withColumnsRenamed({"source": "of", "slot": "of_slot"})


def _taken(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` (with ``doc_id, source, size, draw``) with their source's sums and ``taken``; each row is counted where it stands, none is joined back."""
    rows = rows.withColumn("slot", F.substring("draw", 1, 3))
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("of_slot")))
    inside = Window.partitionBy("source", "slot").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - before))
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + once_more).cast("bigint"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    The weights repeat over the sources in code point order, null last.
    """
    rows = cut(docs.select("doc_id", "source", _size().alias("size"), _draw(seed).alias("draw")), "sizes")
    return _taken(rows, _slots(rows, weights, max_epochs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size, source_size, target, taken``.

    Columns of ``docs`` with one of those names give way.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    slots = _slots(cut(docs.select("source", _size().alias("size"), _draw(seed).alias("draw")), "sizes"), weights, max_epochs)
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), "doc_id", "source", _size().alias("size"), _draw(seed).alias("draw"))
    return _taken(rows, slots).where("taken > 0").select("row.*", "size", "source_size", "target", "taken")
