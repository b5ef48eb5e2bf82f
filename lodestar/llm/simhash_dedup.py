"""Near-duplicates by SimHash with tiled exact comparison.

Distinct fingerprints are put into tiles by population counts.  Two fingerprints at Hamming
distance r have population counts that differ by r at most, so pairs of tiles further apart are
skipped, and every other pair of tiles is compared exactly with numpy exclusive-or and bit
counts.  A pair of tiles gives back a spanning forest of its links, never all pairs.

``near_duplicates`` votes with the XXH64 of three-word shingles, repeats included, on 64 bits,
and tiles by the counts of both halves.  ``keep_one`` is for a similarity of word sets: distinct
shingles of five words vote on ``BITS`` bits, where two sets of Jaccard similarity s differ in
about ``acos(2s / (1 + s)) / pi`` of the bits, and the radius is that of the similarity asked
for, with ``MARGIN`` standard deviations more.

Defined cases: null text counts as empty; an empty text has fingerprint zero, which links
like any other; a text of fewer words than a shingle is one shingle; repeated rows share a
fingerprint and a class; an empty table gives an empty table; other columns are ignored.  A
row with a null id takes part and names its class by the least id that is not null, if any.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodestar.llm.common import connected, cut, unused
from lodestar.llm.tokens import END_OF_TEXT, mix, token_hashes

TILE = 32768
_BLOCK = 1 << 16
#: Bits of a fingerprint for a similarity, fingerprints in one of its tiles, and standard deviations that its radius has to spare.
BITS, WIDE_TILE, MARGIN = 1024, 65536, 1.5
#: Standard deviations to spare in the first 64 bits, which are compared before the rest: about one pair in 10,000 at the similarity asked for is beyond.
GATE_MARGIN = 4.0
_CHUNK = 1 << 22


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total, ones, step = len(words) - width + 1, np.zeros(64, np.int64), _BLOCK
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, step):
        part = words[at : at + step + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        votes = np.array([digest(g, seed) for g in grams], np.uint64).astype(">u8")
        ones += np.unpackbits(votes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", width, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


class _Forest:
    """Groups of the members of two tiles, kept as stars around their least member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.root[i] != self.root[j]
        if apart.any():
            self.waiting.append((i[apart], j[apart]))
            self.size += int(apart.sum())
            if self.size > _BLOCK:
                self.settle()

    def settle(self) -> np.ndarray:
        i, j = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*self.waiting, strict=True) if self.waiting else ((), ())))
        self.waiting, self.size = [], 0
        while True:
            ri, rj = self.root[i], self.root[j]
            apart = ri != rj
            if not apart.any():
                return self.root
            np.minimum.at(self.root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _quarter_counts(x: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], 1).astype(np.int16)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges between all fingerprints of ``a`` and ``b`` (``None``: within ``a``) at most ``radius`` bits apart."""
    other = a if b is None else b
    shift = 0 if b is None else len(a)
    forest = _Forest(len(a) + (0 if b is None else len(b)))

    def compare(rows: np.ndarray, cols: np.ndarray) -> None:
        step = max(1, _BLOCK // max(1, len(cols)))
        right = other[cols]
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(a[some][:, None] ^ right[None, :]) <= radius)
            i, j = some[i], cols[j]
            if b is None:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                forest.link(i, j + shift)

    if len(a) * len(other) <= 1 << 22:
        compare(np.arange(len(a)), np.arange(len(other)))
    else:  # inside large tiles, counts of the four quarters skip most of the rest
        mine, theirs = _quarter_counts(a), _quarter_counts(other)
        kinds, which = np.unique(mine, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))
        for k, kind in enumerate(kinds):
            near = np.nonzero(np.abs(theirs - kind).sum(axis=1) <= radius)[0]
            compare(order[ends[k - 1] if k else 0 : ends[k]], near)
    nodes = a if b is None else np.concatenate([a, b])
    root = forest.settle()
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def tile_pairs(spark: SparkSession, groups: list[tuple[int, int]], near: list[tuple[int, int]]) -> DataFrame:
    """Pairs ``x, y`` of tiles, x <= y, of groups (first tile, tiles) that are near; the tiles of a group are all near."""
    rows = [(*groups[i], *groups[j]) for i, j in near]
    wide = spark.createDataFrame(rows, "base_x bigint, subs_x bigint, base_y bigint, subs_y bigint")
    wide = wide.withColumn("x", F.explode(F.sequence("base_x", F.expr("base_x + subs_x - 1"))))
    return wide.withColumn("y", F.explode(F.sequence("base_y", F.expr("base_y + subs_y - 1")))).where("x <= y").select("x", "y")


def compare_tiles(tiles: DataFrame, pairs: DataFrame, compare: Callable[[pa.Array, pa.Array | None], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges ``a, b`` that ``compare`` gives for each pair; a tile is sent once to each pair it is in, and pairs are dealt evenly.

    ``tiles`` has ``tile`` and ``data``, written before.
    """

    def run(group: pa.Table) -> pa.Table:
        data = group.sort_by("tile").column("data").combine_chunks()
        a, b = compare(data[0], data[1] if len(data) > 1 else None)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    ends = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    parts = 4 * int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.join(tiles, "tile").repartition(parts, "x", "y").groupBy("x", "y").applyInArrow(run, "a bigint, b bigint")


def links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that keep all that ``radius`` connects connected."""
    spark = prints.sparkSession
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    fps = prints.select("fp").distinct().withColumns({"hi": F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int"), "lo": F.bit_count(low).cast("int")})
    sizes = {(r.hi, r.lo): -(-r["count"] // tile) for r in fps.groupBy("hi", "lo").count().collect()}  # 33 x 33 rows at most
    kinds = sorted(sizes)
    base = np.concatenate([[0], np.cumsum([sizes[k] for k in kinds])]).tolist()
    place = {k: i for i, k in enumerate(kinds)}
    near = [(i, place[hi + x, lo + y]) for i, (hi, lo) in enumerate(kinds) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x, y) >= (0, 0) and (hi + x, lo + y) in place]
    where = spark.createDataFrame([(*k, base[i], sizes[k]) for k, i in place.items()], "hi int, lo int, base bigint, subs bigint")
    tiles = fps.join(F.broadcast(where), ["hi", "lo"]).groupBy((F.col("base") + F.pmod(F.xxhash64("fp"), "subs")).alias("tile")).agg(F.collect_list("fp").alias("data"))

    def compare(a: pa.ListScalar, b: pa.ListScalar | None) -> tuple[np.ndarray, np.ndarray]:
        sides = [None if x is None else x.values.to_numpy().view(np.uint64) for x in (a, b)]
        return tile_links(*sides, radius)

    return compare_tiles(cut(tiles, "tiles"), tile_pairs(spark, [(base[i], sizes[k]) for k, i in place.items()], near), compare)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, tile: int = TILE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; component_id is the least doc_id reachable over links."""
    prints = cut(fingerprints(docs, width, seed), "prints")
    roots = connected(links(prints, radius, tile))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(classes.join(names, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


# --- fingerprints for a similarity of word sets

#: For each byte its bits, each in a byte of its own, so that one addition counts eight votes.
_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)
_MOST = 255  # votes that a byte can count


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text, text by text, and their numbers."""
    hashes, sizes = token_hashes(texts)
    words = hashes[np.delete(np.arange(len(hashes)), np.cumsum(sizes) - 1)]
    have = sizes - 1
    room = np.where(have > 0, np.maximum(have, width), 0)  # a text of fewer words is filled up to one shingle
    padded = np.full(int(room.sum()), END_OF_TEXT, np.uint64)
    padded[np.arange(len(words)) + np.repeat(np.cumsum(room) - room - np.cumsum(have) + have, have)] = words
    count = np.maximum(room - width + 1, 0) * (room > 0)
    first = np.arange(int(count.sum())) + np.repeat(np.cumsum(room) - room - np.cumsum(count) + count, count)
    grams = np.zeros(len(first), np.uint64)
    for k in range(width):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + padded[first + k])
    ends = np.cumsum(count)
    for a, b in zip(ends - count, ends, strict=True):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[(ends - count)[count > 0]] = True
    owner = np.repeat(np.arange(len(count)), count)
    return grams[fresh], np.bincount(owner[fresh], minlength=len(count))


def wide_fingerprints(texts: pa.Array, width: int = 5) -> np.ndarray:
    """Rows of ``BITS`` bits as uint64: a bit is one if more than half of the distinct shingles set it."""
    grams, count = shingles(texts, width)
    out = np.zeros((len(count), BITS // 64), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    pieces = -(-count[some] // _MOST)  # runs of votes that don't overflow
    owner = np.repeat(np.arange(len(some)), pieces)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(count[some]) - count[some])[owner] + turn * _MOST
    for word in range(out.shape[1]):
        votes = np.empty((len(starts), 64), np.uint8)
        for at in range(0, len(starts), 2048):
            own = starts[at : at + 2048]
            last = starts[at + 2048] if at + 2048 < len(starts) else len(grams)
            bits = mix(grams[own[0] : last] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            lanes = _LANES[bits.view(np.uint8).reshape(-1, 8)]
            votes[at : at + 2048] = np.add.reduceat(lanes, own - own[0], axis=0).view(np.uint8)
        sums = np.add.reduceat(votes.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
        out[some, word] = np.packbits(sums * 2 > count[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def share_apart(similarity: float) -> float:
    """The share of bits in which two sets of this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float, bits: int, margin: float) -> int:
    share = share_apart(similarity)
    return int(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def wide_links(a: np.ndarray, b: np.ndarray | None, radius: int, gate: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges, as places in ``a`` followed by ``b``, between rows at most ``radius`` bits apart, and ``gate`` in the first 64."""
    other, shift = (a, 0) if b is None else (b, len(a))
    forest = _Forest(len(a) + (0 if b is None else len(b)))
    left, right = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(other[:, 0])
    rows, cols = 16, 8192
    for low in range(0, len(left), rows):
        some = left[low : low + rows, None]
        for at in range(low // cols * cols if b is None else 0, len(right), cols):
            part = right[None, at : at + cols]
            hits = np.flatnonzero(np.bitwise_count(some ^ part) <= gate)
            if not len(hits):
                continue
            i, j = hits // part.shape[1] + low, hits % part.shape[1] + at
            if b is None:
                keep = i < j
                i, j = i[keep], j[keep]
            near = np.bitwise_count(a[i] ^ other[j]).sum(axis=1, dtype=np.int64) <= radius
            if near.any():
                forest.link(i[near], j[near] + shift)
    root = forest.settle()
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def pop_groups(counts: list[tuple[int, int]], tile: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Groups ``(first tile, tiles, least, most)`` of neighbouring population counts of about ``tile`` fingerprints, and each count's group."""
    groups: list[tuple[int, int, int, int]] = []
    of, held = [], tile
    for pop, n in counts:
        if held + n > tile:
            first = groups[-1][0] + groups[-1][1] if groups else 0
            groups.append((first, -(-n // tile), pop, pop))
            held = 0
        groups[-1] = (*groups[-1][:3], pop)
        held += n
        of.append(len(groups) - 1)
    return groups, of


def similar(prints: DataFrame, similarity: float, tile: int = WIDE_TILE) -> DataFrame:
    """Edges ``a, b`` between the names of distinct ``fp`` of ``prints(name, fp, ones)``, by the radius of the similarity."""
    spark = prints.sparkSession
    radius, gate = radius_for(similarity, BITS, MARGIN), radius_for(similarity, 64, GATE_MARGIN)
    kinds = prints.groupBy("name").agg(F.first("fp").alias("fp"), F.first("ones").alias("ones"))
    counts = [(r.ones, r["count"]) for r in kinds.groupBy("ones").count().orderBy("ones").collect()]  # BITS + 1 rows at most
    groups, of = pop_groups(counts, tile)
    near = [(i, j) for i in range(len(groups)) for j in range(i, len(groups)) if groups[j][2] - groups[i][3] <= radius]
    where = spark.createDataFrame([(ones, groups[g][0], groups[g][1]) for (ones, _), g in zip(counts, of, strict=True)], "ones int, base bigint, subs bigint")
    place = (F.col("base") + F.pmod(F.xxhash64("name"), "subs")).alias("tile")
    tiles = kinds.join(F.broadcast(where), "ones").groupBy(place).agg(F.collect_list(F.struct("name", "fp")).alias("data"))

    def compare(a: pa.ListScalar, b: pa.ListScalar | None) -> tuple[np.ndarray, np.ndarray]:
        sides = [None if x is None else np.frombuffer(b"".join(x.values.field("fp").to_pylist()), np.uint64).reshape(-1, BITS // 64) for x in (a, b)]
        names = np.concatenate([x.values.field("name").to_numpy() for x in (a, b) if x is not None])
        i, j = wide_links(*sides, radius, gate)
        return names[i], names[j]

    return compare_tiles(cut(tiles, "tiles"), tile_pairs(spark, [g[:2] for g in groups], near), compare)


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, tile: int = WIDE_TILE) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near copies one, that with the least id.

    SimHash finds the candidates: the components of its links at ``similarity`` of the sets of
    ``width``-word shingles.  Within each, texts are compared by the exact similarity of these sets,
    and only what is linked so is a class, so no document goes for a false link.  Rows are told
    apart by SHA-256 of id and text, so a class of rows without ids keeps one of them, too,
    and of equal rows one stays.  Empty texts are copies of each other and of nothing else.
    """
    from lodestar.llm.jaccard_join import TILE as EXACT_TILE  # it is built on this module's shingles
    from lodestar.llm.jaccard_join import compare, tiled

    row, turn = unused(docs, "row_key"), unused(docs, "row_turn")
    said = F.concat(F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("none")), F.lit("\n"), F.coalesce(F.concat(F.lit("text "), F.col("text")), F.lit("none")))
    keyed = docs.withColumn(row, F.unhex(F.sha2(said.cast("binary"), 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy())
            ends = np.searchsorted(sizes, np.arange(_CHUNK, int(sizes[-1]) if len(sizes) else 0, _CHUNK), "right").tolist()
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    found = wide_fingerprints(part.column(2), width)
                    names = [xxhash.xxh64_intdigest(r.tobytes()) for r in found]
                    ones = np.bitwise_count(found).sum(axis=1, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array([r.tobytes() for r in found], pa.binary()), pa.array(ones)], ["doc_id", "row", "name", "fp", "ones"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = cut(keyed.select("doc_id", F.col(row).alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row binary, name bigint, fp binary, ones int"), "prints")
    found = connected(similar(prints, similarity, tile))
    least = cut(prints.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")), "least")
    wanted = least.join(found.select(F.col("node").alias("name")), "name").select("name", F.col("least.row").alias(row))
    texts = cut(keyed.select(row, "text").join(wanted, row).groupBy("name").agg(F.first("text").alias("text")), "texts", drop_shuffles=True)
    lists = found.select(F.col("root").alias("list"), F.col("node").alias("name"))
    roots = connected(compare(tiled(lists, EXACT_TILE), texts, width, round(100 * similarity)))
    classes = least.join(roots.withColumnRenamed("node", "name"), "name", "left").select(F.coalesce("root", "name").alias("root"), "least")
    kept = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    rest = [f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, AtomicType)]
    once = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(row).orderBy(F.xxhash64(*rest)))).where(F.col(turn) == 1)
    return once.join(kept, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))
