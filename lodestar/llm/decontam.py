"""Benchmark decontamination by the q-gram lemma and banded alignment.

An occurrence of an item of m characters with at most k edits shares at least
``m - q + 1 - k*q`` q-grams with the item, and all of them lie on k + 1 neighbouring
diagonals (text position less item position).  Diagonals are dealt into bands of
2(k + 1), each overlapping the next by half, so some band holds all of them; bands that
meet the bound are merged where they touch and verified by a banded alignment.

Texts and items are compared lower-cased, with all white space as a space, position by
position, so the spans are code points of the text as given.

Items shorter than a q-gram have no room for edits and are found where they occur as they are,
by the hashes of all passages of their length.

Defined cases: null or empty text has no match, a null or empty item is found nowhere; the whole
text is searched whatever its length, a text with very many shared q-grams window by window, so
that memory follows the window and the benchmark (bands still open are carried on, so the window
changes no count); repeated rows match each for itself; equal items each match; regions of one item that overlap count as one, the one with the fewest edits; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of benchmark text that one pass holds in memory; more are searched in blocks.
BLOCK_CHARS = 4_000_000
#: Pairs of q-grams of a text and the items that are counted at a time, about.
WINDOW_PAIRS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_ONE = 1 << 32  # an edit, above the start position in the alignment's combined value


def normal(text: str) -> np.ndarray:
    """Code points of ``text``, lower-cased one by one, white space as a space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13) | (codes == 0xA0)] = 32
    return codes


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value for each of the q-grams, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    power, block, width, out, done = _BASE, codes, 1, None, 0
    n = len(codes) - q + 1
    while True:
        if q & width:
            out = block[done : done + n] if out is None else out * np.uint64(power) + block[done : done + n]
            done += width
        if width * 2 > q:
            return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        block = block[:-width] * np.uint64(power) + block[width:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        width *= 2


def edit_budget(m: int, q: int, rate: float) -> int:
    """The edits allowed in an item of m characters, so that the lemma still asks for a q-gram; -1: too short for q-grams."""
    return min(int(m * rate), (m - q) // q) if m >= q else -1


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best ``(edits, start, end)`` of ``item`` in ``text`` on diagonals low..high, or None beyond the budget."""
    width = high - low + 1
    lane = np.arange(width, dtype=np.int64)
    first = lane + low  # text position that stands before row 0 on each diagonal
    far = np.int64(1) << 60
    row = np.where((first >= 0) & (first <= len(text)), np.maximum(first, 0), far)
    pad = np.full(max(0, -low), -1, np.int64)
    wide = np.concatenate([pad, text.astype(np.int64), np.full(max(0, high + len(item) - len(text)) + 1, -1, np.int64)])
    at = low + len(pad)
    for i, c in enumerate(item.astype(np.int64)):
        seen = wide[at + i : at + i + width]
        new = row + np.where(seen == c, 0, _ONE)
        new[seen < 0] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + _ONE)  # the item's character is missing in the text
        new = np.minimum.accumulate(new - lane * _ONE) + lane * _ONE  # the text has one more
        new[(first + i + 1 < 0) | (first + i + 1 > len(text))] = far
        row = new
        if (row >> 32).min() > budget:
            return None
    best = int(np.argmin(row >> 32))
    return int(row[best] >> 32), int(row[best] & (_ONE - 1)), int(first[best] + len(item))


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[object, str]], q: int, rate: float) -> None:
        self.q, self.ids = q, [k for k, _ in items]
        self.codes = [normal(t) for _, t in items]
        self.sizes = sizes = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(len(c), q, rate) for c in self.codes], np.int64)
        self.need = np.where(self.budget >= 0, sizes - q + 1 - self.budget * q, 1 << 60)
        hashes = [gram_hashes(c, q) for c in self.codes]
        keys = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.keys, self.start, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        bits = max(16, min(24, int(len(keys)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.gate = np.zeros(1 << bits, bool)
        self.gate[self.keys >> self.shift] = True
        self.least = int(self.need.min(initial=1 << 60))
        self.name = [gram_hashes(c, len(c))[0] if len(c) else np.uint64(0) for c in self.codes]
        short: dict[int, dict[int, list[int]]] = {}
        for j, c in enumerate(self.codes):
            if 0 < len(c) < q:
                short.setdefault(len(c), {}).setdefault(int(self.name[j]), []).append(j)
        self.short = {m: (np.array(sorted(known), np.uint64), [known[h] for h in sorted(known)]) for m, known in short.items()}  # by length: hashes in order and their items

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``(item, start, end, edits, shared)`` of every verified region."""
        if len(text) < self.q and not self.short:
            return []
        codes = normal(text)
        return self.find_short(codes) + self.find_long(codes)

    def find_short(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        out = []
        for m, (names, items) in self.short.items():
            grams = gram_hashes(codes, m)
            slot = np.minimum(np.searchsorted(names, grams), len(names) - 1)
            hits = np.flatnonzero(names[slot] == grams)
            free = dict.fromkeys(np.unique(slot[hits]).tolist(), 0)
            for k, at in zip(slot[hits].tolist(), hits.tolist(), strict=True):
                if at >= free[k]:
                    out.extend((j, at, at + m, 0, 0) for j in items[k] if np.array_equal(codes[at : at + m], self.codes[j]))
                    free[k] = at + m
        return out

    def postings(self, slot: np.ndarray) -> np.ndarray:
        """The places in the index of all that the slots hold, slot by slot."""
        count = self.count[slot]
        return np.repeat(self.start[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def bands(self, at: np.ndarray, slot: np.ndarray, busy: np.ndarray, base: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Bands, named ``item * span + band - base``, and how many of the q-grams of the text at ``at`` lie in each."""
        posting = self.postings(slot)
        item, diagonal = self.item[posting], np.repeat(at, self.count[slot]) - self.place[posting]
        keep = busy[item]
        item, diagonal = item[keep], diagonal[keep]
        key = item * span + (diagonal // (self.budget[item] + 1) - base)
        return np.unique(np.concatenate([key, key - 1]), return_counts=True)

    def find_long(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        if not len(self.keys) or len(codes) < self.q:
            return []
        grams = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.gate[grams >> self.shift])
        if len(at) < self.least:
            return []
        slot = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[slot] == grams[at]
        at, slot = at[same], slot[same]
        if len(at) < self.least:
            return []
        # an item with fewer of its own q-grams in the text than the bound can't be in it
        busy = np.bincount(self.item[self.postings(np.unique(slot))], minlength=len(self.ids)) >= self.need
        if not busy.any():
            return []
        before = np.concatenate([[0], np.cumsum(self.count[slot])])
        base = -int(self.sizes.max()) - 2
        span = len(codes) - base + 3
        key = shared = np.zeros(0, np.int64)
        found, k = [], 0
        while k < len(at):  # windows of the text; bands that later q-grams can lie in stay open
            stop = min(len(at), max(k + 1, int(np.searchsorted(before, before[k] + WINDOW_PAIRS))))
            more, n = self.bands(at[k:stop], slot[k:stop], busy, base, span)
            key, where = np.unique(np.concatenate([key, more]), return_inverse=True)
            shared = np.bincount(where, weights=np.concatenate([shared, n]), minlength=len(key)).astype(np.int64)
            owner, band, k = key // span, key % span + base, stop
            end = (band + 2) * (self.budget[owner] + 1) - 1 + self.sizes[owner] - self.q  # the last place of a q-gram in the band
            over = end < at[k] if k < len(at) else np.ones(len(key), bool)
            good = over & (shared >= self.need[owner])
            found.append((owner[good], band[good], shared[good]))
            key, shared = key[~over], shared[~over]
        owner, band, shared = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((band, owner))
        owner, band, shared = owner[order], band[order], shared[order]
        return self.verified(codes, owner, band, shared)

    def verified(self, codes: np.ndarray, owner: np.ndarray, band: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Neighbouring bands put together, aligned, and regions of one item that overlap put together."""
        out: list[tuple[int, int, int, int, int]] = []
        k = 0
        while k < len(owner):
            last = k
            while last + 1 < len(owner) and owner[last + 1] == owner[k] and band[last + 1] <= band[last] + 1 and band[last + 1] - band[k] < 4:
                last += 1
            j, budget = int(owner[k]), int(self.budget[owner[k]])
            low, high = int(band[k]) * (budget + 1), (int(band[last]) + 2) * (budget + 1) - 1
            # whatever these diagonals hold begins inside the whole copy found before, so it counts as one with it
            if not (out and out[-1][0] == j and out[-1][3] == 0 and high < out[-1][2]):
                found = self.align(codes, j, low, high, budget)
                if found:
                    edits, start, end = found
                    one = (j, start, end, edits, int(shared[k : last + 1].max()))
                    if out and out[-1][0] == j and start < out[-1][2] and out[-1][1] < end:
                        out[-1] = min(out[-1], one, key=lambda x: x[3])
                    else:
                        out.append(one)
            k = last + 1
        return out

    def align(self, codes: np.ndarray, j: int, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
        """The item against the stretch of the text that the diagonals cross."""
        item = self.codes[j]
        begin, stop = max(0, low), min(len(codes), high + len(item) + budget)
        whole = begin + np.flatnonzero(gram_hashes(codes[begin:stop], len(item)) == self.name[j])
        for at in whole[whole <= high].tolist():  # the first whole copy, if any
            if np.array_equal(codes[at : at + len(item)], item):
                return 0, at, at + len(item)
        found = align(item, codes[begin:stop], low - begin, high - begin, budget)
        return found and (found[0], found[1] + begin, found[2] + begin)


def blocks_of(benchmark: DataFrame, block_chars: int) -> list[Broadcast]:
    """The items in parts of about ``block_chars`` characters; tasks index a part when they meet it first."""
    items = benchmark.select("item_id", "text").where("length(text) > 0")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]
    return [benchmark.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()]) for part in parts]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, edits, shared_grams`` of every region that holds an item.

    The items go to the tasks in blocks of about ``block_chars`` characters: the size is
    counted first, and a larger benchmark takes more passes instead of a larger broadcast.
    """
    id_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {id_kind}, item_id {item_kind}, start int, end int, edits int, shared_grams int"
    doc_type, item_type = (to_arrow_type(d.schema[c].dataType) for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    out = None
    for shared in blocks_of(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, q, rate)
            for batch in batches:
                rows = [(d.as_py(), index.ids[j], s, e, n, g) for d, t in zip(batch.column(0), batch.column(1), strict=True) for j, s, e, n, g in index.find(t.as_py() or "")]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [doc_type, item_type, *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "start", "end", "edits", "shared_grams"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, row by row whatever their ids, with all their columns."""
    place = docs.columns.index("text")
    for shared in blocks_of(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, q, rate)
            for batch in batches:
                yield batch.filter(pa.array([not index.find(t.as_py() or "") for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
