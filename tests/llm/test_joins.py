"""Hard negatives, token alignment and the Jaccard join against brute force on small rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import alignment, hard_negatives, jaccard_join

VECTORS = "vec_id bigint, embedding array<float>, label int, score bigint, block string"
DOCS = "doc_id bigint, text string, source string, pairs string, block bigint"


# --- hard negatives


def brute_mine(rows, positives=5, negatives=3):
    kept = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, lab, v in kept:
        if i is None or i % 50:
            continue
        others = sorted(((-score(v, w), j is None, j or 0, j, lb) for j, lb, w in kept if j != i), key=lambda x: x[:3])
        for ps, _, _, p, _ in [o for o in others if o[4] == lab][:positives]:
            fit = [(n, -ns) for ns, _, _, n, lb in others if lb != lab and 50 * -ps <= 100 * -ns <= 95 * -ps][:negatives]
            out += [(i, p, k + 1, n, -ps, ns) for k, (n, ns) in enumerate(fit)]
    return Counter(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, 3, "x") for i, v, lab in rows], VECTORS)
    usable = hard_negatives.usable(df, "vec_id", F.col("label"), F.col("embedding"), F.col("vec_id") % 50 == 0)
    return Counter(tuple(r) for r in hard_negatives.mine(usable, **options).collect())


@pytest.mark.parametrize(("tile", "block"), [(7, 2), (16384, 1024)])
def test_mining_equals_brute_force(spark, tile, block):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], draw.randrange(3)) for i in range(-60, 120)]  # many ties, zero scores too
    rows += [(200, None, 1), (250, [0.5, None, 0.0, 1.0], 1), (300, [0.5, float("nan"), 0.0, 1.0], 1), (350, [float("inf")] * 4, 1), (400, [1.0] * 4, None)]
    rows += [(None, [1.0] * 4, 1), (None, [1.0] * 4, 2), (450, [1.0, 0.5], 1), (451, [], 2), (500, [1.0, 0.0, 0.0, 0.0, 2.0], 2), (600, [0.0] * 4, 9)]
    rows += [(650, [1.0, 0.5, 0.5, 0.0], 0)] * 2 + [(651, [1.0, 0.5, 0.5, 0.0], 0)] * 3 + [(652, [0.9, 0.5, 0.5, 0.0], 1)] * 2
    want = brute_mine(rows)
    assert sum(want.values()) > 40 and mined(spark, rows, tile=tile, block=block) == want


def test_mining_of_nothing_and_of_huge_values(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(50, None, 1)])
    assert not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])  # no anchor
    huge = [(50, [3e38, 1.0], 1), (51, [3e38, 0.0], 1), (52, [1e5, 0.0], 2)]
    limit = 1 << 25
    assert mined(spark, huge) == Counter({(50, 51, 1, 52, limit * limit, limit * 25_600_000): 1})


def test_keys_sort_as_asked():
    keys = [(b, p, s, k, i) for b in (0, 3) for p in (0, 9) for s in (-(2**60), -1, 0, 1, 2**60) for k in (False, True) for i in (-5, 0, 7, None)]
    want = sorted(keys, key=lambda x: (x[0], x[1], -x[2], x[3], x[4] is None, x[4] or 0))
    assert sorted(keys, key=lambda x: hard_negatives.packed_key(*x)) == want


# --- token alignment


def brute_align(rows):
    piece = alignment.PieceSide(f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    byte = alignment.ByteSide(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    plain = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    per, counts = [], Counter()
    for i, text in rows:
        a, b = (plain.encode(" " + text, add_special_tokens=False).ids, piece.encode([text])[0]) if text else ([], [])
        raw = [b"".join(side.bytes[x] for x in ids) for side, ids in ((byte, a), (piece, b))]
        if not text or raw != [(" " + text).encode()] * 2:
            per.append((i, None))
            continue
        ends = [np.cumsum([len(side.bytes[x]) for x in ids]).tolist() for side, ids in ((byte, a), (piece, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        at = [dict(zip(e, range(len(e)), strict=True)) for e in ends]
        links = [(a[at[0][c]], b[at[1][c]]) for c in cuts]
        counts.update(links)
        marks = [[0, *(at[k][c] + 1 for c in cuts)] for k in (0, 1)]
        said = ";".join("|".join(",".join(map(str, ids[marks[k][g] : marks[k][g + 1]])) for k, ids in enumerate((a, b))) for g in range(len(cuts)))
        per.append((i, (len(a), len(b), links, hashlib.sha256(said.encode()).hexdigest())))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if x is None else (i, x[0], x[1], len(x[2]), len(x[2]), sum(counts[p] == best[p[1]] for p in x[2]), sum(counts[p] for p in x[2]), x[3]) for i, x in per)


def test_alignment_equals_brute_force(spark):
    draw = random.Random(4)
    letters = "etaoin shrdlu  THE the and ing 0123 .,;\n\té ü ß 語 日本 🙂  "
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randrange(1, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "<|endoftext|> <s></s> <unk> <0x41>"), (104, "▁ under"), (105, "a\x00b"), (106, "ﬁne １２"), (107, "x" * 5000), (108, " " * 3000 + "y"), (109, "the same words " * 4000)]
    rows += [(110, "the same"), (110, "the same"), (None, "no id"), (None, None), (111, "é" * 900), (112, "🙂" * 700), (113, "﻿start")]
    docs = spark.createDataFrame([(i, t, "s", "p", 5) for i, t in rows], DOCS)
    for block_chars in (2000, 6_000_000):
        assert Counter(tuple(r) for r in alignment.align(docs, block_chars=block_chars).collect()) == brute_align(rows)


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None, "s", "p", 5)], DOCS)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 0.9, 1.0])
def test_halving_finds_all_shared_ends(share):
    draw = np.random.default_rng(5)
    ends_a, ends_b, last_a, last_b, at = [], [], [], [], 0
    for n in (1, 1, 2, 3, 200, 5000):
        both = draw.random(n) < share
        both[-1] = True
        ends_a += [at + 3 * k + (0 if b else 1) for k, b in enumerate(both)]
        ends_b += [at + 3 * k + (0 if b else 2) for k, b in enumerate(both) if b or draw.random() < 0.5]
        at += 3 * n
        last_a.append(len(ends_a) - 1)
        last_b.append(len(ends_b) - 1)
    a, b = np.array(ends_a), np.array(ends_b)
    cut_a, cut_b = alignment.shared_cuts(a, b, np.array(last_a), np.array(last_b))
    assert a[cut_a].tolist() == b[cut_b].tolist() == np.intersect1d(a, b).tolist()


# --- Jaccard join


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def brute_join(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return Counter((i, len(sets[k]), name[find(k)]) for k, (i, _) in enumerate(rows))


def varied(draw, base, edits):
    out = list(base)
    for _ in range(edits):
        at = draw.randrange(len(out))
        out[at : at + draw.choice([0, 1, 1])] = [f"v{draw.randrange(10**6)}"] * draw.choice([0, 1, 1])
    return out


@pytest.fixture(scope="module")
def crowd():
    draw = random.Random(8)
    text = lambda n, kinds=3000: [f"w{draw.randrange(kinds)}" for _ in range(n)]
    rows = [text(draw.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 30, 80, 300])) for _ in range(120)]
    for size in (5, 6, 8, 9, 10, 14, 20, 40, 90, 200, 600):  # chains of copies near the bound
        base = text(size)
        for _ in range(12):
            rows.append(base)
            base = varied(draw, base, draw.choice([1, 1, 2, max(1, size // 60), max(1, size // 45)]))
    shared = text(60)
    rows += [text(60) + shared + text(50) for _ in range(60)]  # one passage, no copies
    rows += [varied(draw, shared + shared[::-1] + text(5), 2) for _ in range(70)]  # a large group of near copies
    rows += [["a"] * n for n in (4, 5, 9, 50)] + [["x", "y"] * 40, ["x", "y"] * 41]
    out = [(k, " ".join(w)) for k, w in enumerate(rows)]
    out += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "ONE"), (9005, "Éa b"), (9006, "éa b"), (None, "one"), (None, "no id at all in this text"), (None, None), (7, out[7][1]), (7, out[7][1])]
    out += [(9100, " ".join(text(20000)))]
    out.append((9101, out[-1][1] + " tail of the long text"))
    return out


@pytest.mark.parametrize("tile", [16, 512])
def test_join_equals_brute_force(spark, crowd, tile):
    docs = spark.createDataFrame([(i, t, "s", "p", 5) for i, t in crowd], DOCS)
    want = brute_join(crowd)
    assert len({c for _, _, c in want}) < 0.85 * len(crowd)
    assert Counter(tuple(r) for r in jaccard_join.join(docs, tile=tile).collect()) == want


def test_join_of_nothing(spark):
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r) for r in jaccard_join.join(spark.createDataFrame([(1, None, "s", "p", 5)], DOCS)).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_sets_share_a_signature(percent):
    """Pigeonhole: whatever differs within the bound, an exact subset or a one-deletion neighbour is in common."""
    draw = random.Random(percent)
    for trial in range(400):
        n = draw.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 17, 25, 60, 150])
        a = [draw.getrandbits(64) for _ in range(n)]
        most = 2 * n * (100 - percent) // (100 + percent) + 1
        b = a[draw.randrange(min(n, most) + 1) :] + [draw.getrandbits(64) for _ in range(draw.randrange(most + 1))]
        if not b or 100 * len(set(a) & set(b)) < percent * len(set(a) | set(b)):
            continue
        elements = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (a, b)])
        signs, owners = jaccard_join.signatures(elements, np.array([len(a), len(b)]), percent)
        exact = [{int(s) >> 1 for s, o in zip(signs, owners, strict=True) if o == k and not int(s) & 1} for k in (0, 1)]
        every = [{int(s) >> 1 for s, o in zip(signs, owners, strict=True) if o == k} for k in (0, 1)]
        assert exact[0] & every[1] or every[0] & exact[1], (trial, n)


def test_pairs_are_those_of_the_sets():
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(40)]
    sets_ = [sorted({*draw.sample(base, draw.randrange(30, 41)), *(draw.getrandbits(64) for _ in range(draw.randrange(6)))}) for _ in range(50)]
    elements, sizes = np.array([x for s in sets_ for x in s], np.uint64), np.array(list(map(len, sets_)))
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if 100 * len(set(sets_[i]) & set(sets_[j])) >= 80 * len(set(sets_[i]) | set(sets_[j]))}
    got = set(zip(*(x.tolist() for x in jaccard_join.similar_pairs(elements, sizes, 80)), strict=True))
    assert got == want and 20 < len(want) < 1225


def test_signatures_take_as_many_bytes_in_many_buckets(spark):
    """Names were repeated for each bucket, so what was shuffled grew with their number, which grows with the input."""
    draw = random.Random(3)
    docs = spark.createDataFrame([(" ".join(f"w{draw.randrange(3000)}" for _ in range(200)),) for _ in range(60)], "text string").coalesce(1)
    size = lambda n: sum(len(x) for r in jaccard_join.packed_signatures(docs, 5, 80, n).collect() for x in r if isinstance(x, (bytes, bytearray)))
    assert size(4) == size(2000) > 0


def test_short_names_are_those_of_spark(spark):
    whole = jaccard_join.names_of(np.arange(40, dtype=np.uint64), np.array([3, 30, 0, 7]))
    got = spark.createDataFrame([(bytes(x),) for x in whole.tolist()], "whole binary").selectExpr("xxhash64(whole)").collect()
    assert [r[0] for r in got] == jaccard_join.short_names(whole).tolist()


def test_a_group_gives_a_forest_of_its_likely_pairs(spark):
    """All pairs of a group of near copies went on before, with a text for each."""
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(200)]
    sets_ = [np.sort(np.array([*base[k % 3 :], *(draw.getrandbits(64) for _ in range(k % 4))], np.uint64)) for k in range(40)]
    sizes = np.array([len(x) for x in sets_])
    kinds = spark.createDataFrame([(k, int(n), s) for k, (n, s) in enumerate(zip(sizes, jaccard_join.sketches(np.concatenate(sets_), sizes), strict=True))], "name bigint, n bigint, sketch binary")
    lists = spark.createDataFrame([(7, k, k // 2) for k in range(40)], "list bigint, name bigint, root bigint")
    got = [tuple(r) for r in jaccard_join.likely(jaccard_join.tiled(lists, 64), kinds, 80, hubs_only=False).collect()]
    hub = got[0][0]
    assert sorted(got) == [(hub, k) for k in range(40) if k != hub]


def test_sketches_rule_out_no_similar_pair():
    draw = random.Random(6)
    said = Counter()
    for _ in range(300):
        n = draw.choice([1, 2, 5, 20, 100, 700])
        a = [draw.getrandbits(64) for _ in range(n)]
        b = [*a[draw.randrange(n // 2 + 1) :], *(draw.getrandbits(64) for _ in range(draw.randrange(n // 3 + 2)))]
        sets_ = [np.sort(np.array(x, np.uint64)) for x in (a, b)]
        sizes = np.array([len(x) for x in sets_])
        apart = not jaccard_join.not_ruled_out(jaccard_join.sketches(np.concatenate(sets_), sizes), sizes, 80)[0, 1]
        near = 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
        assert not (near and apart)
        said[near, apart] += 1
    assert said[False, True] > 5 * said[False, False]
