"""Document fingerprints: 128-bit SimHash with Spark expressions only.

Terms are pairs of neighbouring words (the last word stands alone); a term's weight is the
number of its bytes, at most 16, so long and rare terms outvote short and common ones.  Two
64-bit hashes of a term vote on 128 signed bits.  The votes are added up as 64 sums, each of
which holds the votes on two bits in the halves of a long, in one hash aggregate with partial
sums before the shuffle.

``search`` finds for each query all fingerprints within a Hamming radius by permuted block
tables: of ``blocks`` blocks at least two are untouched by ``blocks - 2`` flipped bits, so
there is a table for each two blocks, keyed by their bits, and what meets in any table is
compared in full.

Defined cases: null text counts as empty and has fingerprint zero; texts are read whole, up
to 2**27 words; repeated rows are documents of their own, ordered by text among equal ids;
a null id comes first; the next document of the last is the first, so a single document is
its own next; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import ascii_lower, cut, word_array

BITS = 128
_LANES = 32  # sums for each 64-bit hash; lane j holds the votes on bits j and j + 32


def terms(text: Column) -> Column:
    """Structs ``(word, next)``; the next of the last word is null."""
    words = word_array(ascii_lower(text))
    return F.arrays_zip(words.alias("word"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("next"))


def fingerprints(texts: DataFrame, *key: str) -> DataFrame:
    """``key, high, low`` for the column ``text`` of each distinct key; one shuffle of the partial sums."""
    pairs = texts.select(*key, word_array(ascii_lower(F.col("text"))).alias("words"))
    pairs = pairs.select(*key, F.inline_outer(F.arrays_zip("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("following"))))
    pairs = pairs.toDF(*key, "word", "following")
    weight = F.when(F.col("word").isNull(), 0).otherwise(F.least(F.octet_length("word") + F.coalesce(F.octet_length("following"), F.lit(0)), F.lit(16))).cast("bigint")
    votes = pairs.select(*key, weight.alias("w"), F.xxhash64("word", "following").alias("h0"), F.xxhash64("following", F.lit(7), "word").alias("h1"))
    lane = lambda h, j: F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x100000001)) * F.col("w"))
    sums = votes.groupBy(*key).agg(F.sum("w").alias("w"), *(lane(F.col(f"h{k}"), j).alias(f"s{k}_{j}") for k in (0, 1) for j in range(_LANES)))

    def half(k: int) -> Column:
        out = F.lit(0).cast("bigint")
        for j in range(_LANES):
            for up, count in ((0, F.col(f"s{k}_{j}").bitwiseAND(F.lit(0xFFFFFFFF))), (32, F.shiftrightunsigned(F.col(f"s{k}_{j}"), 32))):
                out = out.bitwiseOR(F.when(count * 2 > F.col("w"), F.shiftleft(F.lit(1).cast("bigint"), j + up)).otherwise(F.lit(0).cast("bigint")))
        return out

    return sums.select(*key, half(0).alias("high"), half(1).alias("low"))


def apart(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    return F.bit_count(a_high.bitwiseXOR(b_high)) + F.bit_count(a_low.bitwiseXOR(b_low))


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, text, next_text, part, place, next_part, next_place`` in ascending order of doc_id.

    The ids are cut into ``parts`` ranges at their quantiles; each range's first document is
    also sent to the range before it, so that one shuffle brings every text to its next.
    What comes to the driver is a bound and a first id for each range.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(key.cast("bigint").alias("at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("at")
    cuts = ids.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(x).cast("bigint") for x in sorted(set(cuts))))
    part = F.size(F.filter(bounds, lambda b: b <= F.col("at"))) if cuts else F.lit(0)
    heads = [(r[0], r[1]) for r in ids.groupBy(part.alias("part")).agg(F.min("at")).orderBy("part").collect()]
    after = {p: heads[(i + 1) % len(heads)][0] for i, (p, _) in enumerate(heads)}
    ahead = F.create_map(*(F.lit(x) for p, _ in heads for x in (p, after[p]))) if heads else F.create_map(F.lit(0), F.lit(0))
    before = F.create_map(*(F.lit(x) for i, (_, first) in enumerate(heads) for x in (first, heads[i - 1][0]))) if heads else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
    spots = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.when(before[F.col("at")].isNotNull(), F.struct(before[F.col("at")].alias("part"), F.lit(True).alias("guest")))))
    dealt = rows.select("at", "doc_id", "text", F.explode(spots).alias("spot")).select("at", "doc_id", "text", "spot.part", "spot.guest")
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    order = Window.partitionBy("part").orderBy("guest", "at", "doc_id", "text")  # all columns dealt are used, so plans that need fewer reuse the exchange
    seen = dealt.select("part", "guest", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"), F.lead("guest").over(order).alias("next_guest")).where("not guest")
    return seen.select(
        "doc_id", "text", "next_text", "part", "place",
        F.when(F.col("next_guest"), ahead[F.col("part")]).otherwise(F.col("part")).alias("next_part"),
        F.when(F.col("next_guest"), F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by as many of the first code points of ``other``, or all."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, high, low, edited_high, edited_low, next_high, next_low``, in the shared folder."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, min(parts, 4000))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    about = rows.select("part", "place", "next_part", "next_place", "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = rows.select("part", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("of")).select("part", "place", "of.kind", "of.text")
    found = fingerprints(both, "part", "place", "kind")
    wide = found.groupBy("part", "place").agg(*(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{n}{c}") for k, n in ((0, ""), (1, "edited_")) for c in ("high", "low")))
    wide = cut(about.join(wide, ["part", "place"]), "fingerprints")
    following = wide.select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("high").alias("next_high"), F.col("low").alias("next_low"))
    return wide.join(following, ["next_part", "next_place"]).drop("part", "place", "next_part", "next_place")


def search(queries: DataFrame, base: DataFrame, radius: int = 4) -> DataFrame:
    """``q_high, q_low, high, low, bits``: each distinct query with every distinct fingerprint of ``base`` within the radius, itself included.

    Both are tables of ``high, low``; rows with one fingerprint are met once, through ``members``.
    """
    blocks = radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def piece(lo: int, hi: int) -> Column:
        """Bits lo..hi of the 128, of which ``high`` has the last 64."""
        out = None
        for name, base_bit in (("low", 0), ("high", 64)):
            a, b = max(lo, base_bit), min(hi, base_bit + 64)
            if a < b:
                part = F.shiftrightunsigned(name, a - base_bit).bitwiseAND(F.lit((1 << (b - a)) - 1))
                out = part if out is None else out.bitwiseOR(F.shiftleft(part, a - lo))
        return out

    pieces = [piece(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    tables = F.explode(F.array(*(F.struct(F.lit(k).alias("table"), pieces[i].alias("x"), pieces[j].alias("y")) for k, (i, j) in enumerate(combinations(range(blocks), 2))))).alias("t")
    both = [d.select("high", "low").distinct().select("high", "low", tables).select("high", "low", "t.*") for d in (queries, base)]
    mine, theirs = both[0].withColumnsRenamed({"high": "q_high", "low": "q_low"}), both[1]
    near = apart(F.col("q_high"), F.col("q_low"), F.col("high"), F.col("low")) <= radius
    bits = apart(F.col("q_high"), F.col("q_low"), F.col("high"), F.col("low")).alias("bits")
    return mine.join(theirs, ["table", "x", "y"]).where(near).select("q_high", "q_low", "high", "low", bits).distinct()


def members(rows: DataFrame) -> DataFrame:
    """``high, low, least_id, documents``: the documents of each distinct fingerprint by their least id and number."""
    return rows.groupBy("high", "low").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("documents"))


def nearest(found: DataFrame, documents: DataFrame) -> DataFrame:
    """For each query of ``search`` the fingerprints and documents within the radius, and the least id, distance and number of the nearest other fingerprint's documents."""
    met = found.join(documents, ["high", "low"])
    other = F.when(F.col("bits") > 0, F.struct("bits", "least_id", "documents"))
    sums = met.groupBy("q_high", "q_low").agg(F.count("*").alias("matches"), F.sum("documents").alias("near_documents"), F.min(other).alias("other"))
    return sums.select(F.col("q_high").alias("high"), F.col("q_low").alias("low"), "matches", "near_documents", F.col("other.least_id").alias("nearest_id"), F.col("other.bits").alias("nearest_bits"))
