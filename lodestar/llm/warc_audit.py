"""Merkle fixity audit of two replicas of a WARC archive.

Each replica gets a tree of its own, from its own records.  A file holds the records of
``FILE_IDS`` ids, in order of ranges of ``RANGE_IDS`` ids, then of id and SHA-256 digest; a
record's offset is the sum of the lengths before it in its file.  The leaves are the records'
digests; above them stand slices, ranges, files and groups of ``FANOUT`` nodes, up to one root.  A
node's digest is that of its children's names, lengths and digests in the order of their offsets,
and so covers where each of them begins within the node; a node that only moved in its file keeps
its digest.  The audit compares the roots and goes down only into nodes that differ, or that one
replica lacks, to the records that do: leaves under equal nodes are never brought together.

Ranges are cut by ids and not by bytes, so that a record lost or added changes its own range and
the nodes above it, and not all that follow.  A range of very many records (copies of one id, or
records without id) is sliced by the first digits of the digests.

Defined cases: null urls and bodies count as empty; records of one id that are equal on both sides
are met first, what is left of the id is paired in the order of digests; records without id are a
file of their own; equal replicas or empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut

FILE_IDS, RANGE_IDS = 1000, 16
FANOUT = 64
#: Records of a range from which on it is sliced in 256 parts, and those in 256 again.
SLICED = 1024
#: The file of records without id.
NO_ID = -(1 << 62)
#: The names of a record's nodes, from its file down.
PATH = ["file", "range", "slice", "subslice"]


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC response record as text."""
    body = F.coalesce(body, F.lit(""))
    lines = ["WARC/1.0", "WARC-Type: response"]
    head = [F.lit("\r\n".join(lines) + "\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit(""))]
    return F.concat(*head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def digests(pages: DataFrame) -> DataFrame:
    """``page_id, length, digest, file, range`` of each record, in the shared folder."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    place = F.floor(F.col("page_id") / FILE_IDS), F.floor(F.pmod("page_id", F.lit(FILE_IDS)) / RANGE_IDS)
    file, span = (F.coalesce(p.cast("bigint"), F.lit(other)) for p, other in zip(place, (NO_ID, 0), strict=True))
    return cut(pages.select("page_id", F.octet_length(text).cast("bigint").alias("length"), F.sha2(text.cast("binary"), 256).alias("digest"), file.alias("file"), span.alias("range")), "records")


def sliced(records: DataFrame, crowded: DataFrame) -> DataFrame:
    """``records`` with ``slice, subslice``, which are empty but in crowded ranges."""
    found = records.join(crowded, ["file", "range"], "left")
    digits = [F.when(F.col("crowded"), F.substring("digest", at, 2)).otherwise("") for at in (1, 3)]
    return found.select(*records.columns, digits[0].alias("slice"), digits[1].alias("subslice"))


def _line(n: int) -> Callable[[Column], Column]:
    return lambda kid: F.concat_ws(" ", *(F.coalesce(kid[f"k{i}"].cast("string"), F.lit("-")) for i in range(n)))


def tree(records: DataFrame, groups: int) -> list[DataFrame]:
    """The levels from the root down to the slices: the names of the node and its parents, ``length, digest``, each in the shared folder."""
    names = [[*(f"group{g}" for g in range(groups - 1, 0, -1)), *PATH]]
    names = [["root", *names[0][:k]] for k in range(len(names[0]), -1, -1)]
    below = records.withColumns({f"group{g}": F.floor(F.col("file") / FANOUT**g) for g in range(1, groups)} | {"root": F.lit(0)})
    order, levels = ["page_id", "digest"], []
    for own in names:
        kids = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate([*order, "length", "digest"])))))
        named = F.transform(kids, _line(len(order) + 2))
        below = cut(below.groupBy(*own).agg(F.sum("length").alias("length"), F.sha2(F.array_join(named, "\n").cast("binary"), 256).alias("digest")), "tree")
        levels.append(below)
        order = [own[-1]]
    return levels[::-1]


def differing(a: DataFrame, b: DataFrame, own: list[str], bad: DataFrame | None) -> DataFrame:
    """Nodes under ``bad`` that differ or that one side lacks: names and where each side's begins in its file."""
    sides = []
    for side, nodes in (("a", a), ("b", b)):
        kids = nodes.withColumn("start", F.lit(0).cast("bigint"))
        if bad is not None:
            kids = nodes.join(bad, own[:-1])
            if "file" in own[:-1]:  # offsets count within a file
                before = F.sum("length").over(Window.partitionBy(*own[:-1]).orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, -1))
                kids = kids.withColumn("start", F.col(f"start_{side}") + F.coalesce(before, F.lit(0)))
            else:
                kids = kids.withColumn("start", F.lit(0).cast("bigint"))
        sides.append(kids.select(*own, F.col("start").alias(f"start_{side}"), F.struct("length", "digest").alias(f"of_{side}")))
    return sides[0].join(sides[1], own, "full").where(~F.col("of_a").eqNullSafe(F.col("of_b"))).select(*own, "start_a", "start_b")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """``page_id, copy, file, offset_a, length_a, digest_a, offset_b, length_b, digest_b, fault`` of every record that differs.

    ``fault`` is ``damaged``, ``missing`` (in the second replica) or ``extra`` (only there); what
    a replica lacks is null, a lacking digest empty.  ``copy`` counts the differing records of an id.
    """
    records = [digests(first), digests(second)]
    both = records[0].select("file", "range").unionByName(records[1].select("file", "range"))
    crowded = both.groupBy("file", "range").count().where(F.col("count") > SLICED).select("file", "range", F.lit(True).alias("crowded"))
    ends = both.where(F.col("file") != NO_ID).agg(F.min("file"), F.max("file")).first()
    width, groups = max((ends[1] - ends[0] + 1) if ends[0] is not None else 1, 1), 1
    while FANOUT**groups < width:
        groups += 1
    records = [cut(sliced(r, cut(crowded, "crowded")), "records") for r in records]
    trees = [tree(r, groups) for r in records]
    bad = None
    for a, b in zip(*trees, strict=True):
        bad = cut(differing(a, b, [c for c in a.columns if c not in ("length", "digest")], bad), "bad")
    left = []
    for side, rows in zip("ab", records, strict=True):
        found = rows.join(bad.drop("root", *(c for c in bad.columns if c.startswith("group"))), PATH)
        order = Window.partitionBy(*PATH).orderBy("page_id", "digest")
        before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
        equal = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("length"))
        left.append(found.select("page_id", "file", (F.col(f"start_{side}") + F.coalesce(before, F.lit(0))).alias("offset"), "length", "digest", equal.alias("nth")))
    same = left[0]["page_id"].eqNullSafe(left[1]["page_id"]) & (left[0]["digest"] == left[1]["digest"]) & (left[0]["nth"] == left[1]["nth"])
    copy = F.row_number().over(Window.partitionBy("page_id").orderBy("digest", "nth"))
    a, b = (x.join(y, same, "left_anti").withColumn("copy", copy).drop("nth") for x, y in (left, left[::-1]))
    a, b = (x.toDF(*(f"{c}_{side}" for c in x.columns)) for side, x in zip("ab", (a, b), strict=True))
    met = a.join(b, F.col("page_id_a").eqNullSafe(F.col("page_id_b")) & (F.col("copy_a") == F.col("copy_b")), "full")
    fault = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("damaged")
    digest = lambda side: F.coalesce(f"digest_{side}", F.lit("")).alias(f"digest_{side}")
    return met.select(
        F.coalesce("page_id_a", "page_id_b").alias("page_id"), F.coalesce("copy_a", "copy_b").alias("copy"), F.coalesce("file_a", "file_b").alias("file"),
        "offset_a", "length_a", digest("a"), "offset_b", "length_b", digest("b"), fault.alias("fault"),
    )
