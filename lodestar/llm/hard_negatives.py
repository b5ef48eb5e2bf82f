"""Hard negatives for anchors of an embedding table, by a secondary-sort shuffle.

Rows are scored against anchors in tiles: each tile of rows meets each block of anchors once,
as one matrix product of whole numbers.  A first pass keeps, for each anchor and tile, the best
rows of the anchor's label; the best of those are its positives, and each opens a window of
scores.  A second pass keeps, for each window and tile, the best rows of other labels in it, so
what is shuffled grows with anchors and tiles, never with all pairs.

The kept pairs are packed into keys (anchor, descending score, positives first, id) and sorted
by ``repartitionAndSortWithinPartitions``.  An iterator reads each anchor's pairs once, best
first: a positive opens its window, a row of another label goes to every open window that holds
its score and has room.  Only the open windows of one anchor are in memory.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part; every other row does, repeated rows each on their own; "other rows" of an anchor are those
of another id; a null id is no anchor and comes last among ties; shorter vectors count as
followed by zeros; components are taken within +-2^25 after scaling, so that scores are exact
longs up to 8,192 dimensions; labels and ids may be any whole numbers; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut

#: Rows of a tile and anchors of a block.
TILE, BLOCK = 16384, 1024
_LIMIT = float(1 << 25)
_PACKED = "n bigint, dim bigint, ids binary, nulls binary, labels binary, matrix binary"
_KEY = struct.Struct(">QIQBBQ")
_BIAS = 1 << 63


def usable(vectors: DataFrame, id_col: str, label: Column, vector: Column, anchor: Column, scale: float = 256.0) -> DataFrame:
    """``id, label, vec, anchor`` of the rows that take part; ``vec`` is scaled, and rounded down later on."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sound = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & sound).withColumn("vec", F.transform("vec", lambda x: x * scale))


def _pack(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> dict:
    """Rows in order of their ids, null last, as bytes; vectors floored and filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values, dim = vectors.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    matrix = np.zeros((len(sizes), dim))
    matrix[np.arange(dim)[None, :] < sizes[:, None]] = np.clip(np.floor(values), -_LIMIT, _LIMIT)
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    plain = ids.fill_null(0).to_numpy()
    order = np.lexsort((plain, nulls))
    return {"n": len(sizes), "dim": dim, "ids": plain[order].tobytes(), "nulls": nulls[order].astype(np.uint8).tobytes(), "labels": labels.to_numpy()[order].tobytes(), "matrix": matrix[order].tobytes()}


class _Side:
    def __init__(self, row: dict) -> None:
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.matrix = np.frombuffer(row["matrix"], np.float64).reshape(row["n"], row["dim"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; a shorter side counts as followed by zeros."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the earlier place first among ties."""
    n = len(scores)
    if n > k:
        edge = np.partition(scores, n - k)[n - k]
        above = np.flatnonzero(scores > edge)
        some = np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])
    else:
        some = np.arange(n)
    return some[np.lexsort((some, -scores[some]))]


def pack_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """``rows`` in packed tiles of at most ``tile`` rows of one partition; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, table.num_rows, tile):
                part = table.slice(at, tile).combine_chunks()
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in part.columns]
                yield pa.RecordBatch.from_pylist([_pack(*columns)])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= tile:
                yield from flush()
                held = []
        if sum(b.num_rows for b in held):
            yield from flush()

    packed = rows.select("id", "label", "vec").mapInArrow(run, _PACKED)
    return cut(packed.withColumn("tile", F.monotonically_increasing_id()), "tiles")


def pack_blocks(anchors: DataFrame, block: int) -> DataFrame:
    """``anchors`` in packed blocks of about ``block`` rows."""
    blocks = max(1, -(-anchors.count() // block))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        row = _pack(*(group.column(c).chunk(0) for c in ("id", "label", "vec")))
        return pa.Table.from_pylist([row | {"block": group.column("block")[0].as_py()}])

    dealt = anchors.select("id", "label", "vec", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
    return cut(dealt.groupBy("block").applyInArrow(run, f"{_PACKED}, block bigint"), "anchors")


def meet(tiles: DataFrame, blocks: DataFrame, compare: Callable[[_Side, _Side, dict], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """``block, pos, anchor_id, other_id, score`` for the rows that ``compare`` gives for each tile and block of anchors.

    Tiles are dealt into slots of about four; a slot meets each block once, with one copy of both.
    """
    spark = tiles.sparkSession
    slots, n = max(1, -(-tiles.count() // 4)), blocks.count()
    rows = tiles.withColumns({"slot": F.pmod(F.xxhash64("tile"), F.lit(slots)), "block": F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)).cast("array<bigint>"))})
    asked = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")))
    made = pa.schema([("block", pa.int64()), ("pos", pa.int64()), ("anchor_id", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in right.to_pylist():
            asking = _Side(row)
            for k in range(left.num_rows):
                side = _Side(left.slice(k, 1).to_pylist()[0])
                for pos, places, scores in compare(side, asking, row):
                    ids = pa.array(side.ids[places], mask=side.nulls[places])
                    m = len(places)
                    out.append(pa.RecordBatch.from_arrays([pa.array(np.full(m, row["block"])), pa.array(np.full(m, pos)), pa.array(np.full(m, asking.ids[pos])), ids, pa.array(scores)], schema=made))
        return pa.Table.from_batches(out, made).combine_chunks()

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = rows.repartition(parts, "slot", "block").groupBy("slot", "block")
    right = asked.repartition(parts, "slot", "block").groupBy("slot", "block")
    return left.cogroup(right).applyInArrow(run, "block bigint, pos bigint, anchor_id bigint, other_id bigint, score bigint")


def best_positives(tiles: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of its label for each anchor, best first."""

    def compare(side: _Side, asking: _Side, _: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for label in np.intersect1d(asking.labels, side.labels):
            same, mine = np.flatnonzero(side.labels == label), np.flatnonzero(asking.labels == label)
            for pos, scores in zip(mine, products(asking.matrix[mine], side.matrix[same]), strict=True):
                other = np.flatnonzero((side.ids[same] != asking.ids[pos]) | side.nulls[same])
                some = first(scores[other], k)
                yield int(pos), same[other[some]], scores[other[some]]

    turn = F.row_number().over(Window.partitionBy("block", "pos").orderBy(F.desc("score"), F.asc_nulls_last("other_id")))
    return meet(tiles, blocks, compare).withColumn("turn", turn).where(F.col("turn") <= k).drop("turn")


def best_negatives(tiles: DataFrame, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """For each anchor of ``asked`` and each score of its ``windows``, the first ``k`` rows of other labels inside."""

    def compare(side: _Side, asking: _Side, row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        windows: dict[int, list[int]] = {}
        for w in row["windows"] or ():
            windows.setdefault(w["pos"], []).append(w["score"])
        held = sorted(windows)
        for at in range(0, len(held), 128):
            some = held[at : at + 128]
            for pos, scores in zip(some, products(asking.matrix[some], side.matrix), strict=True):
                other = side.labels != asking.labels[pos]
                kept = []
                for score in set(windows[pos]):
                    inside = np.flatnonzero(other & (100 * scores >= low * score) & (100 * scores <= high * score))
                    kept.append(inside[first(scores[inside], k)])
                places = np.unique(np.concatenate(kept))
                yield pos, places, scores[places]

    return meet(tiles, asked, compare)


def packed_key(block: int, pos: int, score: int, negative: bool, other: int | None) -> bytes:
    """Bytes that sort by anchor, descending score, positives first, id with null last."""
    return _KEY.pack(block, pos, _BIAS - 1 - score, negative, other is None, _BIAS + (other or 0))


def open_windows(pairs: Iterator[tuple[bytes, int]], k: int, low: int, high: int) -> Iterator[tuple]:
    """Rows ``(anchor, positive, rank, negative, positive score, negative score)`` from sorted pairs of whole anchors."""
    at, windows = None, []
    for key, anchor in pairs:
        block, pos, score, negative, no_id, other = _KEY.unpack(key)
        if (block, pos) != at:
            at, windows = (block, pos), []
        score, other = _BIAS - 1 - score, None if no_id else other - _BIAS
        if not negative:
            windows.append([other, score, 0])
            continue
        for window in windows:
            if window[2] < k and low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], other, window[1], score


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors of ``usable`` rows."""
    spark = rows.sparkSession
    rows = cut(rows, "vectors")
    tiles, blocks = pack_tiles(rows, tile), pack_blocks(rows.where("anchor AND id IS NOT NULL"), block)
    found = cut(best_positives(tiles, blocks, positives), "positives")
    windows = found.groupBy("block").agg(F.collect_list(F.struct("pos", "score")).alias("windows"))
    asked = cut(blocks.join(windows, "block", "left"), "windows")
    pairs = found.withColumn("negative", F.lit(False)).unionByName(best_negatives(tiles, asked, negatives, low, high).withColumn("negative", F.lit(True)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda r: (packed_key(r.block, r.pos, r.score, r.negative, r.other_id), r.anchor_id))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:12]))
    mined = ordered.mapPartitions(lambda part: open_windows(part, negatives, low, high))
    made = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame(mined, made, verifySchema=False)
