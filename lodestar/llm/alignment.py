"""Alignment of two tokenizers over the same texts, by divide and conquer at shared cuts.

Byte offsets where tokens of both sides end are cuts.  An interval of tokens is halved at a cut
near its middle: the end of the middle token is looked up among the other side's ends by bisect,
then those next to it, outwards; both halves are handled alike, and an interval without a cut
inside is a leaf, a group of tokens of both sides over the same bytes.  All intervals of a level
are halved together by arrays, over many texts at once.

Links are pairs of tokens that end together.  Links are counted by pair of ids over the whole
corpus: texts are dealt into blocks, each counts its own pairs and asks for the corpus-wide counts
of just those, so neither the counts nor the texts are ever in one place; a text is encoded once.

Defined cases: texts that are null, empty, or not given back by either side's tokens byte for
byte have no tokens; strings of special tokens inside texts are plain text; texts are encoded
whole; repeated rows each count; an empty table gives an empty table; other columns are ignored;
null ids stay null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut

TOKENIZERS = "/opt/tokenizers"
#: Characters of a block, about, and texts that are encoded at a time.
BLOCK_CHARS, _CHUNK = 6_000_000, 1 << 21
#: Tokens on each side of the middle that are tried one by one before the interval is searched whole.
_NEAR = 16


class ByteSide:
    """Byte-level BPE from a tokenizer file, run by its merge ranks."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocab = {token: i for token, i in model["vocab"].items() if all(x in letters for x in token)}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[x] for x in token) if token in vocab else token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # ids say the same as the order of merges where those of merged tokens go up with it
        merged = [model["vocab"][x + y] for x, y in merges]
        self.ranks = None
        if merged == sorted(set(merged)):
            ranks = {self.bytes[i]: i for i in [*(vocab[x] for x in letters), *merged]}
            self.ranks = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranks is not None:
            return [self._one(" " + t) for t in texts]
        return [self.whole.encode(" " + t, add_special_tokens=False).ids for t in texts]

    def _one(self, text: str) -> list[int]:
        try:
            return self.ranks.encode_ordinary(text)
        except BaseException as fault:  # the fast engine panics on very long runs of one kind
            if isinstance(fault, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self.whole.encode(text, add_special_tokens=False).ids


#: Fixed value: how byte-level BPE of this kind splits texts before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PieceSide:
    """Pieces with byte fallback; the model adds the space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def _sides(folder: str, a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(f"{folder}/{a}"), PieceSide(f"{folder}/{b}")


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b``, both rising, of all ends that they share, in order.

    ``last_a`` and ``last_b`` are the places of ends known to be shared, rising: those of the texts.
    """
    cuts = [(last_a, last_b)]
    # an interval holds the tokens lo..hi of each side, and ends with a shared one
    lo_a, lo_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    live = (lo_a, last_a, lo_b, last_b)
    while len(live[0]):
        lo_a, hi_a, lo_b, hi_b = live
        more = (hi_a > lo_a) & (hi_b > lo_b)  # else a leaf: nothing can end inside on one side
        lo_a, hi_a, lo_b, hi_b = lo_a[more], hi_a[more], lo_b[more], hi_b[more]
        at_a, at_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        middle, open_ = (lo_a + hi_a - 1) // 2, np.arange(len(lo_a))
        for away in range(2 * _NEAR):
            step = (away + 1) // 2 * (1 if away % 2 else -1)
            probe = middle[open_] + step
            inside = (probe >= lo_a[open_]) & (probe < hi_a[open_])
            which, probe = open_[inside], probe[inside]
            found = np.searchsorted(ends_b, ends_a[probe])
            hit = ends_b[found] == ends_a[probe]
            at_a[which[hit]], at_b[which[hit]] = probe[hit], found[hit]
            open_ = open_[at_a[open_] < 0]
            if away % 2 == 0 and away:
                open_ = open_[np.maximum(middle[open_] - lo_a[open_], hi_a[open_] - 1 - middle[open_]) > away // 2]
            if not len(open_):
                break
        for k in open_:  # long stretches without a cut near the middle
            found = np.searchsorted(ends_b, ends_a[lo_a[k] : hi_a[k]])
            hits = np.flatnonzero(ends_b[found] == ends_a[lo_a[k] : hi_a[k]])
            if len(hits):
                best = hits[np.argmin(np.abs(hits + lo_a[k] - middle[k]))]
                at_a[k], at_b[k] = best + lo_a[k], found[best]
        split = at_a >= 0
        lo_a, hi_a, lo_b, hi_b, at_a, at_b = (x[split] for x in (lo_a, hi_a, lo_b, hi_b, at_a, at_b))
        cuts.append((at_a, at_b))
        live = (np.concatenate([lo_a, at_a + 1]), np.concatenate([at_a, hi_a]), np.concatenate([lo_b, at_b + 1]), np.concatenate([at_b, hi_b]))
    all_a, all_b = (np.concatenate(x) for x in zip(*cuts, strict=True))
    order = np.argsort(all_a, kind="stable")
    return all_a[order], all_b[order]


class Aligned:
    """Tokens, groups and links of some texts."""

    def __init__(self, texts: list[str | None], folder: str, a: str, b: str) -> None:
        side_a, side_b = _sides(folder, a, b)
        some = [k for k, t in enumerate(texts) if t]
        plain = [texts[k] for k in some]
        kept, ids_a, ids_b = [], [], []
        for k, text, xs, ys in zip(some, plain, side_a.encode(plain), side_b.encode(plain), strict=True):
            raw = b" " + text.encode()
            if b"".join(map(side_a.bytes.__getitem__, xs)) == raw == b"".join(map(side_b.bytes.__getitem__, ys)):
                kept.append(k)
                ids_a.append(xs)
                ids_b.append(ys)
        self.n = len(texts)
        self.n_a, self.n_b = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.n_a[kept], self.n_b[kept] = list(map(len, ids_a)), list(map(len, ids_b))
        self.a, self.b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        sizes_a, sizes_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (side_a, side_b))
        ends_a, ends_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])  # all texts end to end
        self.last_a, self.last_b = np.cumsum(self.n_a[kept]) - 1, np.cumsum(self.n_b[kept]) - 1
        self.cut_a, self.cut_b = shared_cuts(ends_a, ends_b, self.last_a, self.last_b)
        self.kept = kept
        self.n_groups = np.zeros(self.n, np.int64)
        done = np.searchsorted(self.cut_a, self.last_a, "right")
        self.n_groups[kept] = np.diff(done, prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides at each cut: the tokens that end together."""
        return self.a[self.cut_a], self.b[self.cut_b]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, ``''`` without tokens."""
        group_a, group_b = np.searchsorted(self.cut_a, np.arange(len(self.a))), np.searchsorted(self.cut_b, np.arange(len(self.b)))
        # a token's place in the order of groups, side A before B in each
        before_b = np.append(0, self.cut_b + 1)[group_a]
        place_a, place_b = np.arange(len(self.a)) + before_b, np.arange(len(self.b)) + (self.cut_a + 1)[group_b]
        out = np.empty(len(self.a) + len(self.b), np.int64)
        sign_a, sign_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sign_a[self.cut_a], sign_b[self.cut_b], sign_b[self.last_b] = 1, 2, 3
        out[place_a], out[place_b] = self.a * 4 + sign_a, self.b * 4 + sign_b
        words = list(map(_said().__getitem__, out.tolist()))
        ends, made = (self.last_a + self.last_b + 2).tolist(), [""] * self.n
        for k, lo, hi in zip(self.kept, [0, *ends], ends, strict=False):
            made[k] = hashlib.sha256(b"".join(words[lo:hi])).hexdigest()
        return made


@cache
def _said() -> list[bytes]:
    """Decimal ids followed by nothing but a comma, a bar, a semicolon, or nothing at all, by ``4 * id + sign``."""
    return [b"%d%s" % (i, sign) for i in range(1 << 16) for sign in (b",", b"|", b";", b"")]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def encode_blocks(docs: DataFrame, folder: str, a: str, b: str, block_chars: int) -> DataFrame:
    """A row for each block: its documents' own columns, its pairs of ids with their counts, and its links in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = docs.agg(F.sum(F.octet_length("text"))).first()
    n = max(1, -(-(sizes[0] or 0) // block_chars))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n, 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            found = [Aligned(r.column(1).to_pylist(), folder, a, b) for r in rows]
            pairs = np.concatenate([_pair(*x.links()) for x in found])
            own, where, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # the frequent ones have small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            own, counts = own[order], counts[order]
            planes = np.ascontiguousarray(rank[where].view(np.uint8).reshape(-1, 4).T).tobytes()
            wrap = lambda x: pa.array([x], pa.list_(x.type))
            columns = [wrap(pa.concat_arrays([r.column(0) for r in rows])), *(wrap(pa.array(np.concatenate([getattr(x, c) for x in found]))) for c in ("n_a", "n_b", "n_groups"))]
            columns += [wrap(pa.array([d for x in found for d in x.digests()], pa.string())), wrap(pa.array(own)), wrap(pa.array(counts.astype(np.int64))), pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts", "links"])

        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(np.nan_to_num(np.array([len(t) if (t := x.as_py()) else 0 for x in batch.column(1)], float)))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0.0
                to = max(at + 1, int(np.searchsorted(ends, done + _CHUNK, "right")))
                held.append(batch.slice(at, to - at))
                size += ends[to - 1] - done
                at = to
                if size >= block_chars:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    made = f"doc_id array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, pairs array<bigint>, counts array<bigint>, links binary"
    return docs.select("doc_id", "text").repartition(parts).mapInArrow(run, made)


def align(docs: DataFrame, folder: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = cut(encode_blocks(docs, folder, a, b, block_chars).withColumn("block", F.monotonically_increasing_id()), "blocks")
    asks = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "own")).select("block", "place", F.col("own.pairs").alias("pair"), F.col("own.counts").alias("count"))
    totals = cut(asks.groupBy("pair").agg(F.sum("count").alias("total")), "totals")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))
    totals = totals.withColumn("b", b_id).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    told = asks.select("block", "place", "pair").join(totals, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "total", "best")).alias("told"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                n_groups = row["n_groups"].values.to_numpy()
                told = row["told"].values
                size = 0 if told is None else len(told)
                total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
                if size:
                    place = told.field("place").to_numpy()
                    total[place], best[place] = told.field("total").to_numpy(), told.field("best").to_numpy(zero_copy_only=False)
                n = int(n_groups.sum())
                rank = np.ascontiguousarray(np.frombuffer(pa.decompress(row["links"].as_py(), 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32) if n else np.zeros(0, np.uint32)
                ends = np.cumsum(n_groups)
                sums = [np.diff(np.append(0, np.cumsum(x[rank]))[np.append(0, ends)]) for x in (best, total)]
                yield pa.RecordBatch.from_arrays([row["doc_id"].values, *(row[c].values for c in ("n_a", "n_b", "n_groups")), pa.array(n_groups), *map(pa.array, sums), row["groups_sha256"].values], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    made = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    rows = blocks.drop("pairs", "counts").join(told, "block", "left").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "told")
    return rows.mapInArrow(answer, made)
