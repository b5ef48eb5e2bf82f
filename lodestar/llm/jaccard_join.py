"""Jaccard join of word n-gram sets by partitioned universes and the pigeonhole principle.

Sizes fall into bands, each by 1 / similarity larger than the one before, so two similar sets
lie in one band or in neighbouring ones and meet in the space of the larger set's band.  Sets
that meet there and are similar differ in at most H elements.  A space deals the hashes of
elements into H + 1 + E segments: at most H of them can differ, so E + 1 or more hold the same
subset.  Each set is indexed by its subset of each segment that isn't empty; one with E or fewer
empty segments is sure to share such a subset with each partner.  Sets with more empty ones also
index the one-deletion neighbourhoods of their subsets, which count for two differences; what is
still not sure (small or very uneven sets) indexes its empty segments, too.  E is allocated by
cost: more segments make more signatures for all sets, fewer make more neighbourhoods for some.

Sets with a signature in common are candidates.  Each task's signatures go in packed runs to
buckets, where equal ones meet: 14 bytes for each signature, 48 bits of it and 64 of its set's
name, however many buckets there are.  Lists of sets that share several signatures count once.
In a first round each set is paired with the least one that it shares a list with.  In a second
one all sets of those lists that the links found so far leave in several classes are paired
between classes, lists with one least set as one, and large ones tile by tile.  Pairs count unless
their sizes, or the parities of their elements in some places, rule the similarity out; these
sketches are a fraction of the texts.  A second round's pairs are never written: each group gives
a forest of them, and the components of all forests are compared whole, so a text goes once to its
component and not once for each pair.  What is compared is so by the exact sizes of intersections,
as matrix products over the elements that at least two sets share, and gives a spanning forest of
its links.

Defined cases: null, empty and wordless texts have an empty set, size 0, and are linked with
nothing; a text of fewer words than a shingle is one shingle; equal sets are one node and link
their documents; repeated rows each keep a row; a row with a null id takes part and names its
class by the least id that is not null, if any; an empty table gives an empty table; other columns
are ignored.  Elements are 64-bit hashes of shingles, sets are told apart by 128 bits of their
elements (``whole``); candidates carry 64 bits of these (``name``), and where two sets clash there
both are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import connected, cut
from lodestar.llm.simhash_dedup import _Forest, shingles
from lodestar.llm.tokens import mix

#: Bytes of text that are handled at a time, and whose signatures are sent on together; bytes of text for each bucket, about.
_CHUNK, _SEND, BUCKET_BYTES = 1 << 22, 1 << 24, 1 << 24
#: Sets that are compared with each other at once, partners of a set that are compared with it at once, and elements of a product.
TILE, _PARTNERS, _COLUMNS = 512, 256, 4096
#: Bytes of a signature that are sent on, the lowest ones: the highest have chosen the bucket.
_SIGN = 6
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Bands:
    """Bands of sizes and their spaces for a similarity in per cent."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(self.starts[-1] * 100 // percent + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1

    @cache  # noqa: B019
    def plan(self, space: int) -> tuple[int, int]:
        """Segments of a space, and E: how many of them may be empty before neighbourhoods are needed."""
        most = self.starts[space + 1] - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        size = (self.starts[max(space - 1, 0)] + most) / 2
        costs = {}
        for spare in range(max(4, differ // 2)):
            segments = differ + 1 + spare
            each = size / segments
            mean = segments * math.exp(-each)  # of the empty segments, about normal
            spread = math.sqrt(mean * (1 - math.exp(-each))) + 1e-9
            late = 0.5 * math.erfc((spare + 0.5 - mean) / spread / math.sqrt(2))
            costs[spare] = segments + late * (size + segments)
        spare = min(costs, key=costs.get)
        return differ + 1 + spare, spare


@cache
def bands_of(percent: int) -> Bands:
    return Bands(percent)


def names_of(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole names of sets, 16 bytes each; ``elements`` are in order within each set."""
    ends = np.cumsum(sizes)
    raw = elements.tobytes()
    return np.array([xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], "V16")


def short_names(whole: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64`` makes of whole names."""
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in whole.tolist()], np.uint64).view(np.int64)


def signatures(elements: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the sets that they are of; the lowest bit of a signature tells a one-deletion neighbour.

    Sets of size 0 have none.
    """
    bands = bands_of(percent)
    own = bands.of(np.maximum(sizes, 1))
    found, owners = [], []
    for larger in (0, 1):  # each set is in the space of its band and in the next one, for larger partners
        space = own + larger
        kinds, which = np.unique(space, return_inverse=True)
        plans = np.array([bands.plan(int(k)) for k in kinds]).reshape(-1, 2)
        segments, spare = plans[which].T if len(kinds) else (np.zeros(0, np.int64),) * 2
        segments = np.where(sizes > 0, segments, 0)
        first = np.cumsum(segments) - segments
        owner = np.repeat(np.arange(len(sizes)), sizes)
        seed = mix(space.astype(np.uint64) + _ODD[0])[owner]
        place = ((mix(elements ^ seed) >> np.uint64(32)) * segments.astype(np.uint64)[owner] >> np.uint64(32)).astype(np.int64)
        slot = first[owner] + place
        value = mix(elements * _ODD[1] + seed)
        total = int(segments.sum())
        sums, counts = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        np.add.at(sums, slot, value)
        slot_owner = np.repeat(np.arange(len(sizes)), segments)
        slot_key = mix((np.arange(total) - first[slot_owner]).astype(np.uint64) * _ODD[2] + mix(space.astype(np.uint64))[slot_owner])
        sign = lambda s, at: mix(s + slot_key[at]) & ~np.uint64(1)
        full = counts > 0
        empty = np.bincount(slot_owner[~full], minlength=len(sizes))
        late = empty > spare
        unsure = 2 * (segments - empty) < segments - spare
        shown = full | unsure[slot_owner]
        found.append(sign(sums, np.arange(total))[shown])
        owners.append(slot_owner[shown])
        cut_out = np.flatnonzero(late[owner])
        found.append(sign(sums[slot[cut_out]] - value[cut_out], slot[cut_out]) | np.uint64(1))
        owners.append(owner[cut_out])
    return np.concatenate(found), np.concatenate(owners)


def sketches(elements: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set the parities of its elements in twice as many places or more, a power of two.

    An element in one of two sets alone flips one place, so two sets differ in as many elements
    as their sketches do in places, or more.
    """
    places = (1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * sizes, 1)))).astype(np.int64)) if len(sizes) else sizes
    first = np.cumsum(places) - places
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = first[owner] + (mix(elements ^ _ODD[2]) & (places[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(places.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[a // 8 : (a + n) // 8] for a, n in zip(first.tolist(), places.tolist(), strict=True)]


def not_ruled_out(sketch: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """For all pairs of sets whether sizes and sketches leave the similarity open; longer sketches are folded to the shorter one's places."""
    n, most = len(sizes), (sizes[:, None] + sizes[None, :]) * (100 - percent) // (100 + percent)
    open_ = np.abs(sizes[:, None] - sizes[None, :]) <= most
    length = np.array([len(x) // 8 for x in sketch])
    kinds = [(words, np.flatnonzero(length == words)) for words in np.unique(length)]
    for k, (words, rows) in enumerate(kinds):
        short = np.frombuffer(b"".join(sketch[i] for i in rows), np.uint64).reshape(len(rows), words)
        for longer, others in kinds[k:]:
            long = np.frombuffer(b"".join(sketch[i] for i in others), np.uint64).reshape(len(others), longer // words, words)
            folded = np.bitwise_xor.reduce(long, axis=1)
            apart = np.zeros((len(rows), len(others)), np.int64)
            for at in range(words):  # word by word, so that memory stays that of the result
                apart += np.bitwise_count(short[:, at, None] ^ folded[None, :, at])
            fit = open_[np.ix_(rows, others)] & (apart <= most[np.ix_(rows, others)])
            open_[np.ix_(rows, others)], open_[np.ix_(others, rows)] = fit, fit.T
    return open_


def likely(groups: DataFrame, kinds: DataFrame, percent: int, hubs_only: bool) -> DataFrame:
    """``hub, name`` of pairs in the groups whose sizes and sketches leave the similarity open.

    With ``hubs_only`` all distinct ones of ``list``, the hub, and the others; else a forest of
    stars with the components of those of different ``root``, between sides where a group has two.
    """
    by = [c for c in groups.columns if c not in ("side", "name", "root")]

    def run(group: pa.Table) -> pa.Table:
        names, side = group.column("name").to_numpy(), group.column("side").to_numpy()
        open_ = not_ruled_out(group.column("sketch").to_pylist(), group.column("n").to_numpy(), percent)
        if hubs_only:
            hub = names == group.column("list")[0].as_py()
            i, j = np.nonzero(open_ & hub[:, None] & ~hub[None, :])
        else:
            root = group.column("root").to_numpy()
            open_ &= root[:, None] != root[None, :]
            if side.any():
                open_ &= side[:, None] != side[None, :]
            forest = _Forest(len(names))
            forest.link(*np.nonzero(np.triu(open_, 1)))
            i = forest.settle()
            j = np.flatnonzero(i != np.arange(len(i)))
            i = i[j]
        return pa.table({"hub": pa.array(names[i]), "name": pa.array(names[j])})

    return groups.join(kinds.select("name", "n", "sketch"), "name").groupBy(*by).applyInArrow(run, "hub bigint, name bigint").distinct()


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    ends = np.searchsorted(sizes, np.arange(_CHUNK, int(sizes[-1]) if len(sizes) else 0, _CHUNK), "right").tolist()
    for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, whole, n, sketch`` for every row of ``docs``: the whole name, size and sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                elements, sizes = shingles(part.column(2), width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names_of(elements, sizes).tolist(), pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(sketches(elements, sizes), pa.binary())], ["doc_id", "text_key", "whole", "n", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key bigint, whole binary, n bigint, sketch binary")


def packed_signatures(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """``bucket, signs, names``: a task's signatures by bucket, and the names of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            signs, names = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            bucket = ((signs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            signs, names = signs[order].view(np.uint8).reshape(-1, 8)[:, :_SIGN], names[order]
            which, at = np.unique(bucket[order], return_index=True)
            parts = list(zip(at.tolist(), [*at[1:].tolist(), len(order)][: len(at)], strict=True))
            packs = [[x[a:b].tobytes() for a, b in parts] for x in (signs, names)]
            return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), *(pa.array(p, pa.binary()) for p in packs)], ["bucket", "signs", "names"])

        size, sent = 0, np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch, 0):
                elements, sizes = shingles(part.column(0), width)
                names = short_names(names_of(elements, sizes))
                fresh = np.zeros(len(names), bool)  # copies count once
                fresh[np.unique(names, return_index=True)[1]] = True
                fresh &= ~np.isin(names, sent)
                signs, owners = signatures(elements[np.repeat(fresh, sizes)], sizes[fresh], percent)
                held.append((signs, names[fresh][owners]))
                sent = np.append(sent, names[fresh])
                size += part.nbytes
                if size >= _SEND:
                    yield flush()
                    held, size, sent = [], 0, sent[:0]
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket bigint, signs binary, names binary")


def shared_lists(packs: DataFrame) -> DataFrame:
    """``list, name``: the members of each distinct list of sets that share a signature."""

    def run(group: pa.Table) -> pa.Table:
        names = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("names")])
        kinds, owners = np.unique(names, return_inverse=True)
        raw = np.zeros((len(names), 8), np.uint8)
        raw[:, :_SIGN] = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group.column("signs")]).reshape(-1, _SIGN)
        signs = raw.view(np.uint64).ravel()
        # of one set and signature one is enough, the subset itself before a neighbour
        order = np.lexsort((signs & np.uint64(1), owners, signs >> np.uint64(1)))
        signs, owners = signs[order], owners[order]
        same = (signs[1:] >> np.uint64(1)) == (signs[:-1] >> np.uint64(1))
        keep = np.append(True, ~(same & (owners[1:] == owners[:-1]))) if len(signs) else np.zeros(0, bool)
        signs, owners = signs[keep], owners[keep]
        starts = np.flatnonzero(np.append(True, (signs[1:] >> np.uint64(1)) != (signs[:-1] >> np.uint64(1)))) if len(signs) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(signs)))
        exact = np.add.reduceat((signs & np.uint64(1)) == 0, starts) if len(starts) else sizes  # neighbours alone prove nothing
        lists: dict[int, np.ndarray] = {}
        for at, n in zip(starts[(sizes > 1) & (exact > 0)].tolist(), sizes[(sizes > 1) & (exact > 0)].tolist(), strict=True):
            members = kinds[owners[at : at + n]]
            lists.setdefault(xxhash.xxh3_64_intdigest(members.tobytes()), members)  # lists that clash are one
        held = np.concatenate([np.zeros(0, np.int64), *lists.values()])
        ids = np.repeat(np.array(list(lists), np.uint64).view(np.int64), np.array([len(m) for m in lists.values()], np.int64))
        return pa.table({"list": pa.array(ids), "name": pa.array(held)})

    return packs.groupBy("bucket").applyInArrow(run, "list bigint, name bigint").distinct()


def similar_pairs(elements: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sets that reach the similarity."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(elements, kind="stable")
    ranked = elements[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    number = np.cumsum(fresh) - 1
    many = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.zeros(0, bool)
    column, row = number[many], owner[order][many]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    ends = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + _COLUMNS, _COLUMNS)) if len(column) else [0]
    for at, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        part = np.zeros((n, _COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at * _COLUMNS] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    near = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
    return np.nonzero(near)


def compare(groups: DataFrame, texts: DataFrame, width: int, percent: int, called: str = "name") -> DataFrame:
    """Edges ``a, b`` that keep connected what is similar among the sets of each of ``groups``, the rows of one list and pair of tiles.

    Edges are between the values of ``called``, a column of ``texts``.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        elements, sizes = shingles(group.column("text").chunk(0), width)
        forest = _Forest(len(sizes))
        forest.link(*similar_pairs(elements, sizes, percent))
        root = forest.settle()
        moved = np.flatnonzero(root != np.arange(len(root)))
        names = group.column(called).chunk(0)
        return pa.table({"a": names.take(pa.array(moved)), "b": names.take(pa.array(root[moved]))})

    kind = texts.schema[called].dataType.simpleString()
    return groups.join(texts, "name").groupBy("list", "tile_a", "tile_b").applyInArrow(run, f"a {kind}, b {kind}")


def tiled(lists: DataFrame, tile: int) -> DataFrame:
    """``lists`` with ``tile_a, tile_b, side``: those of at most a tile as they are, larger ones as all pairs of their tiles."""
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = lists.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("name"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "tiles")


def star_groups(pairs: DataFrame) -> DataFrame:
    """Groups for ``compare`` of each ``hub`` with the ``name`` of its pairs, not too many at once."""
    crowd = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(_PARTNERS)).cast("int").alias("parts"))
    dealt = pairs.join(crowd, "hub").select(F.col("hub").alias("list"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("tile_a"), "name")
    return dealt.select("list", "tile_a", F.lit(0).alias("tile_b"), F.lit(0).alias("side"), F.explode(F.array("name", "list")).alias("name")).distinct()


def join(docs: DataFrame, width: int = 5, percent: int = 80, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; component_id is the least doc_id reachable over links."""
    prints = cut(sets(docs, width), "sets", drop_shuffles=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    lists = cut(shared_lists(packed_signatures(docs, width, percent, buckets)), "lists", drop_shuffles=True)
    # sizes, sketches and one text of each set that is in a list
    wanted = lists.select("name").distinct()
    place = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("at")
    named = prints.where("n > 0").withColumn("name", F.xxhash64("whole"))
    kinds = named.join(wanted, "name", "left_semi").groupBy("name", "whole").agg(place, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    kinds = cut(kinds.select("name", "whole", "n", "sketch", F.col("at.doc_id").alias("id"), F.col("at.text_key").alias("key")), "kinds", drop_shuffles=True)
    key = lambda i, k: [F.col(i).isNull().alias("no_id"), F.coalesce(i, F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("row_id"), F.col(k).alias("text_key")]
    rows = docs.where("text IS NOT NULL").withColumn("key", F.xxhash64("text")).select(*key("doc_id", "key"), "text")
    texts = rows.join(kinds.select(*key("id", "key"), "name", "whole"), ["no_id", "row_id", "text_key"])
    # repeated rows count once; this needs no other shuffle
    texts = texts.groupBy("no_id", "row_id", "text_key").agg(*(F.first(c).alias(c) for c in ("name", "whole", "text"))).select("name", "whole", "text")
    texts = cut(texts, "texts", drop_shuffles=True)
    # first round: each set against the least one that it is in a list with
    hubs = lists.groupBy("list").agg(F.min("name").alias("hub"))
    pairs = lists.join(hubs, "list").where("name <> hub").groupBy("name").agg(F.min("hub").alias("hub")).select("hub", "name")
    pairs = cut(likely(star_groups(pairs), kinds, percent, hubs_only=True), "pairs", drop_shuffles=True)
    links = cut(compare(star_groups(pairs), texts, width, percent, "whole"), "links", drop_shuffles=True)
    # second round: lists that the links leave in several classes, those with one least set as one
    roots = connected(links).select(F.xxhash64("node").alias("name"), F.xxhash64("root").alias("root"))
    classes = lists.join(roots, "name", "left").select("list", "name", F.coalesce("root", "name").alias("root"))
    apart = classes.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("name").alias("hub")).where("low <> high").select("list", "hub")
    merged = classes.join(apart, "list").select(F.col("hub").alias("list"), "name", "root").distinct()
    pairs = cut(likely(tiled(merged, tile), kinds, percent, hubs_only=False), "pairs", drop_shuffles=True)
    near = connected(pairs.select(F.col("hub").alias("a"), F.col("name").alias("b"))).select(F.col("root").alias("list"), F.col("node").alias("name"))
    more = cut(compare(tiled(near, max(1, tile // 2)), texts, width, percent, "whole"), "links", drop_shuffles=True)
    roots = connected(links.unionByName(more)).withColumnRenamed("node", "whole")
    least = prints.where("n > 0").groupBy("whole").agg(F.min("doc_id").alias("least"))
    classes = least.join(roots, "whole", "left").select("whole", F.coalesce("root", "whole").alias("root"), "least")
    called = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(classes.join(called, "root").select("whole", "component_id"), "classes", drop_shuffles=True)
    linked = prints.where("n > 0").join(classes, "whole").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
