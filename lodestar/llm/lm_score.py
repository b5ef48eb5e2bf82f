"""Language-model scores from a weighted backoff automaton over word trigrams.

The states are the contexts seen in training: the empty one, the start of a text, every word,
and every pair of neighbouring words.  A state h has an arc for each seen successor w,

    p(w | h) = (1 - f(h)) * c(h w) / c(h) + f(h) * p(w | h'),      p(w) = (c(w) + 1) / (N + V + 1),

and a failure arc of weight ``f(h) = theta / (c(h) + theta)`` to the state h', h without its first
word; so every state's weights sum to one, unknown words included.  The ``theta`` of an order is
found from training counts alone: leaving out each training token in turn, those whose n-gram
occurs once are met as unseen, and ``theta`` is where the failure weights of all contexts seen
twice or more add up to their number.  A text is read once from left to right: each token takes
the arc out of the state reached, or failure arcs down to a state that has one, adds the
log-probability, and moves to the longest seen context that ends with it.

The model is never in one place.  Documents are dealt into blocks of about ``BLOCK_TOKENS``
tokens; a block asks for the counts of just its own n-grams, by hash range; each range adds up
the counts of all blocks and answers each block; then the block builds the part of the automaton
that its texts can reach and walks them.  The number of ranges follows the n-grams asked for, not
the blocks.  Words are named by their kind and 61 bits of hash, pairs and triples by their kind and
by hashes 20 bits longer than the number of tokens, at least 40 bits, so that the chance of a clash
is one in a million for each at any size; counts of words (``n_known``, ``base_score``) don't hang on it.

Defined cases: null text counts as empty and has one token, the end; texts are read whole;
repeated rows are each counted and scored, and dealt to different blocks; with no training row
all words are unknown; an empty table gives an empty table; other columns are ignored; a null id
counts as the text ''.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import crc_mod
from lodestar.llm.tokens import END_OF_TEXT, mix, token_hashes

BLOCK_TOKENS = 1_000_000
#: N-grams that a hash range is asked for, about.
SPAN_KEYS = 3_000_000
_START = np.uint64(xxhash.xxh64_intdigest(b"start"))
#: Kinds of n-grams: a word, the end, the start of a text, a pair that can be a context, a pair with the end, a triple.
WORD, END, START, PAIR, LAST_PAIR, TRIPLE = range(6)
#: Counts of contexts are told apart up to 15, then by their number of binary digits.
_EXACT, _CLASSES = 16, 16 + 64
#: Slots of the sums over all ranges: tokens, kinds, singles of pairs and triples, then contexts and their counts by class for both.
TOKENS, KINDS, SINGLES, CONTEXTS = 0, 1, 2, 4


def packed(values: np.ndarray) -> bytes:
    """The bytes of uint64 values, all first bytes, then all second ones, ..., compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.uint64)


class Block:
    """The n-grams of a block of texts: ``keys`` in order, and where each token's own are among them."""

    def __init__(self, texts: pa.ChunkedArray, bits: int) -> None:
        self.bits = bits
        words, self.sizes = token_hashes(pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string()))
        self.first = np.cumsum(self.sizes) - self.sizes
        last = words == END_OF_TEXT
        before = np.roll(words, 1)
        before[self.first] = _START
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
        context = np.roll(pair, 1)
        self.third = np.ones(len(words), bool)  # tokens that have two before them, the start included
        self.third[self.first] = False
        triple = mix(context * np.uint64(0xD6E8FEB86659FD93) + words)[self.third]
        self.raw = np.concatenate([
            self._key(mix(words ^ np.uint64(0xA0761D6478BD642F)), np.where(last, END, WORD)),
            self._key(pair, np.where(last, LAST_PAIR, PAIR)),
            self._key(triple, TRIPLE),
            self._key(mix(np.full(len(self.sizes), _START)), START),
        ])

    def _key(self, x: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
        """From the top: the hash, the kind, and for words the rest of the hash, so that other names end in zeros."""
        rest = np.uint64(61 - self.bits)
        kind = np.asarray(kind, np.uint64)
        low = np.where(kind <= END, x & ((np.uint64(1) << rest) - np.uint64(1)), np.uint64(0))
        return (x >> np.uint64(64 - self.bits)) << np.uint64(64 - self.bits) | kind << rest | low

    def asked(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams and their counts in training texts."""
        on = np.repeat(train, self.sizes)
        mine = np.sort(self.raw[np.concatenate([on, on, on[self.third], train])])
        keys = np.unique(self.raw)
        at = np.searchsorted(mine, keys)
        return keys, np.diff(np.append(at, len(mine))).astype(np.uint64)

    def span_of(self, keys: np.ndarray, spans: int) -> np.ndarray:
        return (keys >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)

    def spread(self, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each token the counts of word, pair and triple, and of the contexts before it of one word and of two."""
        _, where = np.unique(self.raw, return_inverse=True)
        n = len(self.third)
        every = counts[where].astype(np.float64)
        word, pair = every[:n], every[n : 2 * n]
        triple = np.zeros(n)
        triple[self.third] = every[2 * n : 2 * n + int(self.third.sum())]
        one, two = np.roll(word, 1), np.roll(pair, 1)
        one[self.first] = every[-1] if n else 0  # the start of a text
        two[self.first] = 0
        return word, pair, triple, one, two


def concentration(contexts: np.ndarray, events: np.ndarray, singles: int) -> float:
    """``theta`` where ``c * theta / (c + theta)``, summed over contexts seen twice or more, meets the tokens met as unseen."""
    unseen = singles - contexts[1]
    n, total = contexts[2:].astype(np.float64), events[2:].astype(np.float64)
    if total.sum() <= 0:
        return 1.0
    each = total / np.maximum(n, 1)
    low, high = 1e-3, 1e9
    for _ in range(100):
        theta = float(np.sqrt(low * high))
        if (total * theta / (each + theta)).sum() < unseen:
            low = theta
        else:
            high = theta
    return theta


class Automaton:
    """Arc and failure weights of the states that the tokens of a block reach."""

    def __init__(self, sums: np.ndarray) -> None:
        self.tokens, kinds = int(sums[TOKENS]), int(sums[KINDS])
        self.all = self.tokens + kinds + 1
        by_class = sums[CONTEXTS:].reshape(2, 2, _CLASSES)
        self.theta = [concentration(by_class[k, 0], by_class[k, 1], int(sums[SINGLES + k])) for k in (0, 1)]

    def walk(self, block: Block, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base and model log10 probability of each text."""
        word, pair, triple, one, two = block.spread(counts)
        root = (word + 1) / self.all
        fail_one, fail_two = (theta / (c + theta) for theta, c in zip(self.theta, (one, two), strict=True))
        arc_one = (1 - fail_one) * pair / np.maximum(one, 1) + fail_one * root
        arc_two = (1 - fail_two) * triple / np.maximum(two, 1) + fail_two * arc_one
        # the state each token is met in: the pair before it where seen, else the word, else the empty context
        depth = np.where(two > 0, 2, np.where(one > 0, 1, 0))
        step = np.zeros(len(word))
        for level, has_arc, arc, fail in ((2, triple > 0, arc_two, fail_two), (1, pair > 0, arc_one, fail_one)):
            here = depth == level
            take, drop = here & has_arc, here & ~has_arc
            step[take] += np.log10(arc[take])
            step[drop] += np.log10(fail[drop])
            depth[take] = -1  # done
            depth[drop] = level - 1 if level == 1 else np.where(one[drop] > 0, 1, 0)
        base = np.log10(root)
        step[depth == 0] += base[depth == 0]
        add = lambda x: np.add.reduceat(x, block.first) if len(x) else np.zeros(0)
        return add((word > 0).astype(np.int64)), add(base), add(step)


def span_sums(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The sums of one range by slot, from its distinct n-grams."""
    kind, some = keys >> np.uint64(61 - bits) & np.uint64(7), counts > 0
    out = np.zeros(CONTEXTS + 4 * _CLASSES, np.int64)
    words = some & (kind <= END)
    out[TOKENS], out[KINDS] = counts[words].sum(), words.sum()
    for k, (lower, higher) in enumerate((((WORD, START), (PAIR, LAST_PAIR)), ((PAIR,), (TRIPLE,)))):
        out[SINGLES + k] = (np.isin(kind, higher) & (counts == 1)).sum()
        c = counts[some & np.isin(kind, lower)].astype(np.int64)
        group = np.where(c < _EXACT, c, _EXACT + np.frexp(c.astype(np.float64))[1])
        at = CONTEXTS + 2 * k * _CLASSES
        out[at : at + _CLASSES] = np.bincount(group, minlength=_CLASSES)
        out[at + _CLASSES : at + 2 * _CLASSES] = np.bincount(group, weights=c, minlength=_CLASSES)
    return out


def score_texts(docs: DataFrame, held_out: Column, block_tokens: int = BLOCK_TOKENS, span_keys: int = SPAN_KEYS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model learns from the rows for which ``held_out`` is false.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (~F.coalesce(held_out, F.lit(False))).alias("train"))
    sizes = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    about = (sizes[0] or 0) // 6 + sizes[1]  # tokens; only the sizes of blocks and ranges and the bits of names hang on it
    n, spans = max(1, -(-about // block_tokens)), max(1, -(-2 * about // span_keys))
    bits = min(61, max(40, 20 + int(about).bit_length()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by row, so repeated rows spread; the same exchange feeds both passes over the blocks
    blocks = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))).repartition(parts, "block")
    answers = "block bigint, span bigint, n bigint, counts binary, slot int, amount bigint"

    def ask(group: pa.Table) -> pa.Table:
        own = Block(group.column("text"), bits)
        keys, counts = own.asked(group.column("train").to_numpy())
        some, at = np.unique(own.span_of(keys, spans), return_index=True)
        ends = np.append(at[1:], len(keys))
        packs = [(packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(counts[a:b])) for a, b in zip(at, ends, strict=True)]
        block = group.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(some), pa.int64()), "span": pa.array(some.astype(np.int64)), "n": pa.array(ends - at), "keys": pa.array([k for k, _ in packs], pa.binary()), "counts": pa.array([c for _, c in packs], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_numpy()
        keys = [np.cumsum(unpacked(k.as_py(), n), dtype=np.uint64) for k, n in zip(group.column("keys"), sizes, strict=True)]
        kinds, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpacked(c.as_py(), n) for c, n in zip(group.column("counts"), sizes, strict=True)])
        sums = np.bincount(where, weights=counts).astype(np.uint64)
        back = [packed(s) for s in np.split(sums[where], np.cumsum(sizes)[:-1])]
        slots = span_sums(kinds, sums, bits)
        own, m, k = np.flatnonzero(slots), len(back), int(np.count_nonzero(slots))
        span = group.column("span")[0].as_py()
        # a row for each block that asked, and a row for each sum, dealt to a block without texts
        return pa.table({
            "block": pa.concat_arrays([group.column("block").combine_chunks(), pa.array([-1 - span] * k, pa.int64())]), "span": pa.array([span] * (m + k), pa.int64()),
            "n": pa.concat_arrays([pa.array(sizes, pa.int64()), pa.array([0] * k, pa.int64())]), "counts": pa.array([*back, *[b""] * k], pa.binary()),
            "slot": pa.array([*[-1] * m, *own], pa.int32()), "amount": pa.array([*[0] * m, *slots[own]], pa.int64()),
        })

    def answer(texts: pa.Table, totals: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in done})
        own = Block(texts.column("text"), bits)
        totals = totals.sort_by("span")
        counts = np.concatenate([unpacked(c.as_py(), n.as_py()) for c, n in zip(totals.column("counts"), totals.column("n"), strict=True)])
        sums = np.zeros(CONTEXTS + 4 * _CLASSES, np.int64)
        for s in totals.column("sums")[0].as_py():  # told with the first range
            if s["slot"] >= 0:
                sums[s["slot"]] = s["amount"]
        model = Automaton(sums)
        known, base, score = model.walk(own, counts)
        train = texts.column("train").to_numpy()
        columns = [texts.column("doc_id").combine_chunks(), pa.array(~train), pa.array(own.sizes), pa.array(known, pa.int64()), pa.array([model.tokens] * len(train), pa.int64()), pa.array(base), pa.array(score)]
        return pa.table(dict(zip([f.name for f in done], columns, strict=True)))

    from pyspark.sql.pandas.types import to_arrow_schema

    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    done = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    asked = blocks.groupBy("block").applyInArrow(ask, "block bigint, span bigint, n bigint, keys binary, counts binary")
    totals = asked.groupBy("span").applyInArrow(total, answers).repartition(parts, "block")
    # the sums of all ranges, as a subquery of one row; it uses all columns, so that it reads the exchange that the blocks' answers come from
    sums = totals.groupBy("slot").agg(F.sum("amount").alias("amount"), F.max("block").alias("block"), F.max("span").alias("span"), F.sum("n").alias("n"), F.sum(F.octet_length("counts")).alias("bytes"))
    sums = sums.agg(F.collect_list(F.struct("slot", "amount", "block", "span", "n", "bytes")).alias("sums"))
    turn = F.row_number().over(Window.partitionBy("block").orderBy("span"))
    told = totals.withColumn("turn", turn).withColumn("sums", F.when(F.col("turn") == 1, sums.scalar())).drop("turn")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, out)


def held_out_fold(docs: DataFrame) -> Column:
    return crc_mod(docs["doc_id"], 7) == 2
