"""Each operator against brute force on small rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import chat_format, decontam, fingerprint, license_scan, lm_score, mixing, simhash_dedup, tokens, toxicity, url_filter, warc_audit
from lodestar.llm.common import connected

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, fp string, score double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0 if t is None else len(t), 7, "x", 0.5) for i, t, s in rows], DOCS)


def words(seed, n, kinds=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(kinds)}é" if draw.random() < 0.1 else f"w{draw.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    rows = [(i, words(i, 30 + i), f"s{i % 3}") for i in range(40)]
    base = words(99, 400)
    rows += [(100 + k, base.replace("w7 ", f"q{k} ", 1), "s0") for k in range(6)]
    rows += [(200, base, None), (201, base, "s1"), (201, base, "s1"), (300, None, None), (301, "", "s2"), (302, " \t\n", "s2"), (303, "one", "s2"), (304, "One TWO", "s2"), (400, words(5, 30000), "s1"), (None, words(3, 33), "s1")]
    return rows


# --- near duplicates


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kinds = sorted(prints)
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in kinds}


def test_near_duplicates_equal_brute_force(spark, sample):
    small = [r for r in sample if r[0] != 400]
    got = simhash_dedup.near_duplicates(docs_of(spark, small), tile=8).collect()
    assert len(got) == len(small)
    prints = [brute_print(t) for _, t, _ in small]
    roots = brute_components(set(prints))
    least = {}
    for (i, _, _), p in zip(small, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], 1 << 60))
    want = Counter((i, p, least.get(roots[p])) for (i, _, _), p in zip(small, prints, strict=True))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want


@pytest.mark.parametrize("radius", [0, 3])
def test_tiles_lose_no_link(radius):
    draw = np.random.default_rng(3)
    a = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.array([int(x) ^ (1 << int(draw.integers(64))) ^ (1 << int(draw.integers(64))) for x in a[:30]], np.uint64)
    all_ = np.unique(np.concatenate([a, near]))
    x, y = simhash_dedup.tile_links(all_, None, radius)
    want = brute_components({int(v) for v in all_}, radius)
    got = {int(v): int(v) for v in all_}
    for u, v in zip(x, y, strict=True):
        got[int(u)] = int(v)
    for u in got:
        for v in got:
            assert (got[u] == got[v]) == (want[u] == want[v])


def test_quarter_counts_change_nothing(monkeypatch):
    draw = np.random.default_rng(4)
    a = draw.integers(0, 1 << 63, 2500, dtype=np.uint64)
    a = np.unique(np.concatenate([a, a[:200] ^ np.uint64(5)]))
    x, y = simhash_dedup.tile_links(a, None, 3)  # large enough for the quarters' way
    assert len(x) >= 200 and all((int(u) ^ int(v)).bit_count() <= 3 for u, v in zip(x[:50], y[:50], strict=True))


def test_connected_follows_chains(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_keep_one_keeps_each_class_once(spark, sample):
    docs = docs_of(spark, [*sample, (None, words(3, 33), "s9"), (None, "no id but a text of its own", "s1"), (None, "no id but a text of its own", "s1"), (None, "no id but a text of its own", "s2")])
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = kept.collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and set(range(40)) <= set(ids) and 201 not in ids and {300, 303} <= set(ids) and not {301, 302} & set(ids)
    assert [r.text for r in got if r.doc_id is None] == ["no id but a text of its own"]  # the other one is a copy of 3
    assert simhash_dedup.keep_one(docs.limit(0)).count() == 0


def grams_of(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_wide_fingerprints_equal_brute_force():
    import pyarrow as pa

    texts = [None, "", "one", "one Two", "a b c d e", words(1, 700, 50), "x " * 3000, words(2, 40), "one"]
    got = simhash_dedup.wide_fingerprints(pa.array(texts))
    hashes = {}
    for t in texts:
        for g in grams_of(t):
            hashes.setdefault(g, simhash_dedup.shingles(pa.array([g]), 5)[0][0])
    assert len(set(hashes.values())) == len(hashes)
    for t, row in zip(texts, got, strict=True):
        own = np.array([hashes[g] for g in grams_of(t)], np.uint64)
        for k in (0, 7, 15):
            bits = simhash_dedup.mix(own * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).tolist()
            assert int(row[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in bits) > len(bits))


@pytest.mark.parametrize("tile", [7, 65536])
def test_wide_tiles_lose_no_link(spark, tile):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, (12, 16), dtype=np.uint64)
    rows = [base[k % 12].copy() for k in range(60)]
    for k, r in enumerate(rows):
        flips = draw.permutation(1024)[: k * 4]
        for f in flips:
            r[f // 64] ^= np.uint64(1 << int(f % 64))
    rows += [np.zeros(16, np.uint64), np.full(16, (1 << 64) - 1, np.uint64)]
    radius, gate = simhash_dedup.radius_for(0.8, 1024, 1.5), simhash_dedup.radius_for(0.8, 64, 4.0)
    df = spark.createDataFrame([(k, bytearray(r.tobytes()), int(np.bitwise_count(r).sum())) for k, r in enumerate(rows)], "name bigint, fp binary, ones int")
    edges = [(r.a, r.b) for r in simhash_dedup.similar(df, 0.8, tile).collect()]
    want = {(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(rows[i] ^ rows[j]).sum() <= radius and np.bitwise_count(rows[i][0] ^ rows[j][0]) <= gate}

    def classes(pairs):
        root = list(range(len(rows)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    assert classes(edges) == classes(want) and len(edges) < 60 * max(1, len(rows) // tile)


def test_keep_one_finds_near_copies(spark):
    draw, rows = random.Random(11), []
    for g in range(40):
        base = words(7000 + g, 60 + 20 * g, 5000).split()
        rows.append((10 * g, " ".join(base), "s"))
        for k in range(1, 4):  # similarities from about 0.5 to 0.97
            t = list(base)
            for at in draw.sample(range(len(t)), 1 + k * k * len(t) // 90):
                t[at] = f"q{g}x{k}x{at}"
            rows.append((10 * g + k, " ".join(t), "s"))
    line = words(1, 40)  # a passage of many documents
    rows += [(5000 + k, words(k, 60, 5000) + " " + line, "s") for k in range(30)] + [(6000, "a b", "s"), (6001, "A  b", "s"), (6002, "", "s"), (6003, None, "s")]
    sets = {i: grams_of(t) for i, t, _ in rows}
    like = {(i, j): len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i in sets for j in sets if i < j and (i // 10 == j // 10 or i >= 5000)}
    kept = {r.doc_id for r in simhash_dedup.keep_one(docs_of(spark, rows)).collect()}
    near = {j for (i, j), v in like.items() if v >= 0.8}
    assert len(near) > 25 and len(near & kept) <= 0.1 * len(near)
    assert not {j for (i, j), v in like.items() if v >= 0.87} & kept
    far = {j for j in sets if j % 10 and j < 5000 and max(v for p, v in like.items() if j in p) < 0.65}
    assert len(far) > 25 and far <= kept and set(range(5000, 5030)) | {6000, 6002} <= kept and not {6001, 6003} & kept


# --- mixing


def test_mix_fills_water_and_repeats(spark, sample):
    got = mixing.mix(docs_of(spark, sample)).collect()
    assert len(got) == len(sample)
    sizes = Counter()
    for _, t, s in sample:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    by_size = {(r.source_size, round(r.target, 6)) for r in got}
    assert by_size == {(sizes[s], round(target[s], 6)) for s in order}
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    assert all(abs(taken[sizes[s]] - target[s]) <= 1 for s in order)
    assert Counter(got) == Counter(mixing.mix(docs_of(spark, sample[::-1])).collect())


def test_mixed_keeps_each_source_at_its_target(spark):
    """Repeated and null ids in several sources: a row keeps its own source's target, and sums meet the targets."""
    draw = random.Random(11)
    rows = [(draw.choice([None, 1, 2, k]), words(k, draw.randrange(1, 40)), f"s{k % 5}") for k in range(300)]
    rows += [(1, "same words here", f"s{k % 5}") for k in range(20)] + [(None, "same words here", f"s{k % 5}") for k in range(20)] + [(3, None, "s1"), (4, "x y", None)]
    taken = mixing.mixed(docs_of(spark, rows)).collect()
    target = {r.source: r.target for r in taken}
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    level, weight = dict.fromkeys(order, 0.0), {s: k % 3 + 1.0 for k, s in enumerate(order)}
    capped: set = set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        level = {s: 3.0 * size[s] if s in capped else weight[s] * rest / free for s in order}
        over = {s for s in order if level[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    sums = Counter()
    for r in taken:
        assert r.target == pytest.approx(level[r.source]) and r.source_size == size[r.source]
        assert r.size == len((r.text or "").split()) and 0 < r.taken <= 3 * r.size
        sums[r.source] += r.taken
    assert all(abs(sums[s] - target[s]) <= 1 for s in target) and set(target) == set(order)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


# --- decontamination


def test_contaminated_finds_planted_and_edited_passages(spark):
    draw = random.Random(1)
    text = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n))
    items = [(k, text(30)) for k in range(12)]
    rows, want = [], set()
    for d in range(60):
        body = text(draw.choice([0, 5, 200]))
        if d % 3 == 0:
            k = d % 12
            passage = list(items[k][1].upper() if d % 2 else items[k][1])
            for _ in range(min(d % 5, int(len(passage) * 0.08))):
                passage[draw.randrange(len(passage))] = "~"
            rows.append((d, body + " " + "".join(passage) + "\n" + text(20)))
            want.add((d, k))
        else:
            rows.append((d, body + items[d % 12][1][:40]))
    rows += [(900, None), (901, ""), (902, "abc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, "abc")], "item_id bigint, text string")
    want.add((902, 51))  # a short item is found as it is
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id != 51 or r.doc_id > 899} == want
    assert all("abc" in dict(rows)[r.doc_id].lower() for r in got if r.item_id == 51)
    again = decontam.contaminated(docs, bench, block_chars=500).collect()  # in blocks
    assert sorted(got) == sorted(again)
    kept = {r.doc_id for r in decontam.keep_clean(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {r.doc_id for r in got}


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_items_in_texts_equal_brute_force(spark):
    draw = random.Random(31)
    make = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    items = [(k, make(n, letters)) for k, (n, letters) in enumerate((n, letters) for n in (1, 2, 3, 5, 7, 8, 9, 17, 26, 40, 60) for letters in ("ab", "abcdefg é"))]
    items += [(90, "aaaaaaaa" * 5), (91, "AAAAAAAA" * 5), (92, None), (93, "")]
    rows = []
    for d in range(70):
        text = make(draw.randrange(120), "ab" if d % 2 else "abcdefg é")
        item = items[d % len(items)][1] or ""
        edited = "".join(draw.choice([c, c, c, c, c, c, c, c, c, c, "z", "", c + "q"]) for c in item)
        rows.append((d if d % 9 else None, text[:30] + (edited if d % 3 else item.upper()) + text[30:], "x", "y"))
    rows += [(7, rows[7][1], "x", "y"), (500, "a" * 300, "x", "y"), (501, None, "x", "y"), (502, "", "x", "y"), (503, " ", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, start string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    plain = lambda t: (t or "").lower()

    def holds(item, text):
        m = len(item)
        return m and (item in text if m < 8 else brute_edits(item, text) <= decontam.edit_budget(m, 8, 0.08))

    want = Counter((d, t, i) for d, t, _, _ in rows for i, item in items if holds(plain(item), plain(t)))
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, _, i in want}
    index = decontam.Index([(i, t) for i, t in items if t], 8, 0.08)
    for _, t, _, _ in rows:
        found = index.find(t or "")
        assert {index.ids[j] for j, *_ in found} == {i for i, item in items if holds(plain(item), plain(t))}
        for j, start, end, edits, _ in found:
            assert brute_edits(plain(items[[i for i, _ in items].index(index.ids[j])][1]), plain(t)[start:end]) == edits
    bench = bench.where("text is null or length(text) > 4")
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    clean = Counter(r for r in rows if not any(holds(plain(item), plain(r[1])) for _, item in items if len(item or "") > 4))
    assert Counter(map(tuple, kept.collect())) == clean and 5 <= sum(clean.values()) < len(rows) - 20
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.keep_clean(docs.limit(0), bench).count() == 0
    assert decontam.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_repetitive_texts_stay_within_memory(monkeypatch):
    import tracemalloc

    index = decontam.Index([(1, "a" * 300), (2, "ab" * 60), (3, "xyz " * 40)], 8, 0.08)
    tracemalloc.start()
    found = index.find("a" * 200_000 + "ab" * 30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {j for j, *_ in found} == {0, 1} and peak < 300e6  # all pairs at once would take 6 GB
    assert sum(e - s for j, s, e, _, _ in found if j == 0) > 190_000
    text = "q" * 50 + "ab" * 400 + "r" + "a" * 900 + "xyz " * 90
    whole = index.find(text)
    monkeypatch.setattr(decontam, "WINDOW_PAIRS", 3000)  # many windows
    assert [x[:4] for x in index.find(text)] == [x[:4] for x in whole]


def test_band_alignment_equals_full_alignment():
    draw = random.Random(5)
    for _ in range(60):
        item = "".join(draw.choice("ab") for _ in range(30))
        text = "".join(draw.choice("ab") for _ in range(10)) + "".join(c if draw.random() > 0.1 else draw.choice(["", "x", c + "y"]) for c in item) + "ab"
        a, b = decontam.normal(item), decontam.normal(text)
        found = decontam.align(a, b, -12, 24, 40)
        assert found[0] == brute_edits(item, text)
        assert brute_edits(item, text[found[1] : found[2]]) == found[0]


@pytest.mark.parametrize("q", [1, 3, 8, 11])
def test_gram_hashes_are_equal_for_equal_grams(q):
    codes = decontam.normal("abracadabra abracadabra")
    h = decontam.gram_hashes(codes, q)
    assert len(h) == 23 - q + 1
    grams = ["abracadabra abracadabra"[i : i + q] for i in range(len(h))]
    for i, x in enumerate(grams):
        for j, y in enumerate(grams):
            assert (x == y) == (h[i] == h[j])


# --- language model


def brute_theta(contexts, singles):
    """Where the failure weights of contexts seen twice or more add up to the tokens met as unseen; classes of counts as in the operator."""
    unseen, classes = singles - sum(c == 1 for c in contexts), {}
    for c in contexts:
        if c > 1:
            classes.setdefault(c if c < 16 else -c.bit_length(), []).append(c)
    if not classes:
        return 1.0
    low, high = 1e-3, 1e9
    for _ in range(100):
        mid = math.sqrt(low * high)
        if sum(sum(c) * mid / (sum(c) / len(c) + mid) for c in classes.values()) < unseen:
            low = mid
        else:
            high = mid
    return mid


def brute_scores(rows, held):
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([" ", *t], t, strict=False))
    three = Counter(p for t in train for p in zip([" ", *t], t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    ctx = Counter(x for t in train for x in [" ", *t[:-1]])
    theta2 = brute_theta([c for c in ctx.values()], sum(c == 1 for c in two.values()))
    theta3 = brute_theta([c for (_, w), c in two.items() if w != b""], sum(c == 1 for c in three.values()))
    out = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        base = score = 0.0
        for k, w in enumerate(t):
            p = (one[w] + 1) / (n + v + 1)
            base += math.log10(p)
            u = t[k - 1] if k else " "
            f = theta2 / (ctx[u] + theta2)
            p = (1 - f) * two[u, w] / max(1, ctx[u]) + f * p
            if k:
                uu = (t[k - 2] if k > 1 else " ", u)
                f = theta3 / (two[uu] + theta3)
                p = (1 - f) * three[(*uu, w)] / max(1, two[uu]) + f * p
            score += math.log10(p)
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return out


def by_value(rows):
    return sorted(rows, key=repr)


def test_window_changes_no_count(monkeypatch):
    draw = random.Random(8)
    items = ["".join(draw.choice("abc ") for _ in range(n)) for n in (40, 90, 200, 400)] + ["a" * 120]
    text = " ".join(draw.choice(items) if draw.random() < 0.3 else "".join(draw.choice("abc ") for _ in range(50)) for _ in range(60)) + "a" * 500
    index = decontam.Index(list(enumerate(items)), 8, 0.08)
    whole = index.find(text)
    assert len({w[0] for w in whole}) == len(items)
    for pairs in (1, 50, 700, 9000):
        monkeypatch.setattr(decontam, "WINDOW_PAIRS", pairs)
        assert index.find(text) == whole


def test_short_items_each_once_from_the_left():
    index = decontam.Index([(0, "aa"), (1, "ab"), (2, "aa"), (3, "b")], 8, 0.08)
    assert sorted(index.find("aaaab aab")) == sorted([(j, at, at + 2, 0, 0) for j in (0, 2) for at in (0, 2, 6)] + [(1, 3, 5, 0, 0), (1, 7, 9, 0, 0), (3, 4, 5, 0, 0), (3, 8, 9, 0, 0)])


def test_names_of_words_keep_their_hash():
    import pyarrow as pa

    short, long = (lm_score.Block(pa.chunked_array([pa.array(["one two three one", "", None, "two two"])]), bits) for bits in (40, 61))
    for block in (short, long):
        kinds = block.raw >> np.uint64(61 - block.bits) & np.uint64(7)
        assert np.bincount(kinds.astype(int)).tolist() == [6, 4, 4, 6, 4, 6]
    same = lambda b: np.sort(b.raw[:10][(b.raw[:10] >> np.uint64(61 - b.bits) & np.uint64(7)) == 0])
    assert len(np.unique(same(short))) == len(np.unique(same(long))) == 3
    low = np.uint64((1 << 21) - 1)
    assert np.count_nonzero(same(short) & low) and not np.any(short.raw[10:] & low)


def test_score_equals_brute_force(spark, sample):
    rows = [*((i, t) for i, t, _ in sample), (None, None), (700, "x" * 100 + " " + "Y" * 70 + " é\u00a0É z"), (701, "x" * 100), (702, "\x0b a\x0ca\x1c")]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    want = brute_scores(rows, held)
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    for parts, tokens in ((1, 10**6), (8, 900), (200, 3000)):  # parts without rows are no words
        got = lm_score.score_texts(docs.repartition(parts), lm_score.held_out_fold(docs), block_tokens=tokens, span_keys=5000)
        assert by_value((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()) == by_value(want)
    assert lm_score.score_texts(docs.limit(0), F.lit(False)).count() == 0
    assert {r.n_known for r in lm_score.score_texts(docs, F.lit(True)).collect()} == {0}


@pytest.mark.parametrize("piece", [5, 64, 1 << 22])
def test_token_hashes_do_not_hang_on_pieces(monkeypatch, piece):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "_PIECE", piece)
    texts = [None, "", "a B  c", " ", "long" * 40 + " a", "x\tb\nA ", "é É", "A" * 70, "a" * 70]
    hashes, sizes = tokens.token_hashes(pa.array(texts))
    words = [[w for w in (t or "").encode().lower().split()] + [None] for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    seen = {}
    for w, h in zip((w for t in words for w in t), hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    part, sizes = tokens.token_hashes(pa.array(texts).slice(2, 3))
    assert sizes.tolist() == [4, 1, 3] and part.tolist() == hashes.tolist()[2:10]


def test_state_weights_sum_to_one():
    import pyarrow as pa

    text = "a b a c a b d b a c"
    words = [*text.split(), ""]
    model = lm_score.Automaton(np.zeros(lm_score.CONTEXTS + 4 * 80, np.int64))
    model.theta, model.all = [0.7, 1.3], 11 + 5 + 1
    seen = Counter(words)

    def probability(before, w):
        block = lm_score.Block(pa.chunked_array([[f"{before} {w}".strip()] if w else [before]]), 50)
        train = lm_score.Block(pa.chunked_array([[text]]), 50)
        keys, counts = train.asked(np.array([True]))
        known = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        mine, _ = block.asked(np.array([True]))
        at = len(before.split()) if w else len(before.split())
        parts = block.spread(np.array([known.get(k, 0) for k in mine.tolist()], np.uint64))
        word, pair, triple, one, two = (x[at] for x in parts)
        f1, f2 = 0.7 / (one + 0.7), 1.3 / (two + 1.3)
        p = (word + 1) / model.all
        p = (1 - f1) * pair / max(one, 1) + f1 * p
        return (1 - f2) * triple / max(two, 1) + f2 * p

    for before in ("a b", "b a", "d", "c a", "q q", "q b"):
        assert sum(probability(before, w) for w in [*seen, "unknown"]) == pytest.approx(1)


# --- fingerprints


def brute_128(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return w


def test_fingerprint_columns(spark, sample):
    rows = [r for r in sample if r[0] is not None]
    got = fingerprint.fingerprint_with_edits(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t, _ in rows))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        edited = t[: len(t) - half] + ordered[(k + 1) % len(ordered)][1][:half]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {}
    for r in got:
        text = dict((i, t or "") for i, t in ordered)[r.doc_id]
        assert prints.setdefault(text, (r.high, r.low)) == (r.high, r.low)
    assert prints[""] == (0, 0)
    by_id = {r.doc_id: (r.high, r.low) for r in got}
    following = {ordered[k][0]: ordered[(k + 1) % len(ordered)][0] for k in range(len(ordered))}
    assert all((r.next_high, r.next_low) == by_id[following[r.doc_id]] for r in got if r.doc_id != 201)


def test_votes_equal_brute_force(spark):
    texts = ["alpha Beta gamma alpha beta", "solo", words(1, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    pairs = df.select("k", F.inline(fingerprint.terms(F.col("text")))).toDF("k", "word", "following")
    hashed = pairs.select("k", "word", "following", F.xxhash64("word", "following").alias("h0"), F.xxhash64("following", F.lit(7), "word").alias("h1")).collect()
    votes = {k: (np.zeros(64), np.zeros(64), 0) for k in range(3)}
    for r in hashed:
        weight = min(16, len(r.word.encode()) + len((r.following or "").encode()))
        a, b, w = votes[r.k]
        votes[r.k] = (a + weight * np.array([r.h0 >> i & 1 for i in range(64)]), b + weight * np.array([r.h1 >> i & 1 for i in range(64)]), w + weight)
    for r in fingerprint.fingerprints(df, "k").collect():
        a, b, w = votes[r.k]
        assert (r.high & (1 << 64) - 1, r.low & (1 << 64) - 1) == (sum(1 << i for i in range(64) if 2 * a[i] > w), sum(1 << i for i in range(64) if 2 * b[i] > w))


def test_search_finds_all_within_radius(spark):
    draw = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [draw.getrandbits(128) for _ in range(60)]
    base += [x ^ sum(1 << b for b in draw.sample(range(128), n)) for x in base[:20] for n in (1, 3, 4, 5)]
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in [*base, base[0]]], "high bigint, low bigint")
    queries = base[:20]
    unsigned = lambda r, x, y: (r[x] & (1 << 64) - 1) << 64 | r[y] & (1 << 64) - 1
    found = fingerprint.search(df.limit(20), df, 4)
    got = {(unsigned(r, "q_high", "q_low"), unsigned(r, "high", "low"), r.bits) for r in found.collect()}
    assert got == {(x, y, (x ^ y).bit_count()) for x in queries for y in set(base) if (x ^ y).bit_count() <= 4}
    numbered = df.withColumn("doc_id", F.monotonically_increasing_id())
    ids = {}
    for r in numbered.collect():
        ids.setdefault(unsigned(r, "high", "low"), []).append(r.doc_id)
    for r in fingerprint.nearest(found, fingerprint.members(numbered)).collect():
        x = unsigned(r, "high", "low")
        near = [(x ^ y).bit_count() for y in ids]
        other = sorted(((x ^ y).bit_count(), min(ids[y])) for y in ids if 0 < (x ^ y).bit_count() <= 4)
        assert r.matches == sum(n <= 4 for n in near) and r.near_documents == sum(len(v) for y, v in ids.items() if (x ^ y).bit_count() <= 4)
        assert (r.nearest_bits, r.nearest_id) == (other[0] if other else (None, None))


# --- toxicity


def test_toxicity_learns_words_and_patterns(spark):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        t = words(1000 + i, 60, 3000).split()
        if toxic:
            t[10] = draw.choice(["slur", "vile"]) if i % 2 else f"zqxi{draw.randrange(9999)}"
            t[20] = draw.choice(["slur,", "Vile"]) if i % 2 else f"zqxi{draw.randrange(9999)}"
        rows.append((i, " ".join(t), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None), (5001, "", "s")]
    docs, marks = docs_of(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows)
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[5000].score == got[5001].score < 0.5
    assert all(r.score == 0 for r in toxicity.toxicity(docs, marks.limit(0)).collect())
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), marks).where("held_out").join(marks, "doc_id").select("predicted", "toxic").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_of_odd_rows(spark):
    rows = [(i, ("vile " if i % 4 == 0 else "") + words(i, 40), "s") for i in range(200)] + [(i, "both", "s") for i in (3, 3)] + [(None, "vile vile", "s"), (900, "vile " + words(7, 60000), "s")]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(3, 1), (3, 0)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs_of(spark, rows), marks).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 3}) <= 2
    assert next(r for r in got if r.doc_id == 900).predicted == 1 and toxicity.toxicity(docs_of(spark, rows).limit(0), marks).count() == 0


# --- licences


def test_licence_scan_of_odd_rows(spark):
    line = "Licensed under the MIT license."
    tie = line + "\nLicensed under the Apache License, Version 2.0."
    rows = [(None, line, "s"), (1, line, "s"), (1, line, "s"), (2, tie, "s"), (3, None, "s"), (4, "\n\n", "s")]
    got = license_scan.scan(docs_of(spark, rows)).collect()
    assert len(got) == 6 and [r.family for r in got if r.doc_id in (None, 1)] == ["mit"] * 3
    both = next(r for r in got if r.doc_id == 2)
    assert {f.family for f in both.findings if f.confirmed} == {"mit", "apache-2.0"}
    surest = max((f.probability, f.family) for f in both.findings if f.confirmed)[1]
    assert both.family == surest and {r.family for r in got if r.doc_id in (3, 4)} == {"unknown"}
    assert license_scan.scan(docs_of(spark, []), license_scan.fit(docs_of(spark, rows))).count() == 0


def test_licences_are_found_and_confirmed(spark):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved."]
    want = ["mit", "apache-2.0", "gpl", "cc-by-nc", "all-rights-reserved"]
    rows = [(i, words(i, 80) + "\n\n" + (lines[i % 5] if i < 50 else "the license of the garden was reserved for rights"), "s") for i in range(100)]
    rows += [(200, None, "s"), (201, "", "s"), (202, words(3, 20000) + " " + lines[0], "s")]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert [got[i].family for i in range(50)] == [want[i % 5] for i in range(50)]
    assert all(got[i].findings[0].paragraph == 1 and got[i].findings[0].probability > 0.8 for i in range(50))
    assert all(got[i].family == "unknown" for i in range(50, 100))
    assert (got[200].n_paragraphs, got[201].n_paragraphs, got[202].family) == (0, 0, "mit")


def test_wrapped_licences_are_found(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License"
    apache = "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\thttp://www.apache.org/licenses/LICENSE-2.0"
    rows = []
    for i in range(80):
        notice = (mit, bsd, gpl, apache)[i % 4]
        rows.append((i, words(i, 60) + "\n\n" + (words(i + 500, 9) + "\n" if i % 3 else "") + notice + "\n" + words(i + 900, 12) + "\n\n" + words(i + 300, 40), "s"))
    rows.append((100, gpl.replace("#", "*") + "\nLicensed under CC BY 4.0.", "s"))
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert [got[i].family for i in range(80)] == [("mit", "bsd", "gpl", "apache-2.0")[i % 4] for i in range(80)]
    assert all(got[i].n_paragraphs == 3 and {f.paragraph for f in got[i].findings} == {1} for i in range(80))
    assert {f.family for f in got[100].findings if f.confirmed} == {"gpl", "cc-by"}


def test_licence_model_without_corpus(spark):
    model = license_scan.fit(docs_of(spark, []))
    assert model.scan("Nothing here.\nLicensed under the MIT license.")[1][0][1] == "mit"


# --- WARC


PAGES = "page_id bigint, url string, html string, digest string, file int, start int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], PAGES)


def brute_audit(first, second):
    sides = []
    for rows in (first, second):
        files = {}
        for i, u, b in rows:
            body = (b or "").encode()
            text = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
            files.setdefault(warc_audit.NO_ID if i is None else i // 1000, []).append((i or 0, hashlib.sha256(text).hexdigest(), len(text), i))
        found = []
        for f, records in files.items():
            at = 0
            for _, digest, n, i in sorted(records, key=lambda r: r[:3]):
                found.append((i, digest, f, at, n))
                at += n
        sides.append(found)
    out = []
    for i in {r[0] for s in sides for r in s}:
        mine = [[r for r in s if r[0] == i] for s in sides]
        both = Counter(r[1] for r in mine[0]) & Counter(r[1] for r in mine[1])
        rest = []
        for s in mine:
            drop, alone = Counter(both), []
            for r in sorted(s, key=lambda r: (r[1], r[3])):
                if drop[r[1]]:
                    drop[r[1]] -= 1
                else:
                    alone.append(r)
            rest.append(alone)
        for k in range(max(map(len, rest))):
            a, b = (s[k] if k < len(s) else None for s in rest)
            out.append((i, (a or b)[2], a and a[2:], a and a[1] or "", b and b[2:], b and b[1] or "", "missing" if b is None else "extra" if a is None else "damaged"))
    return out


@pytest.mark.parametrize("crowded", [3, 1024])
def test_audit_equals_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(warc_audit, "SLICED", crowded)
    rows = [(i, f"http://a/{i}", "body" * (i % 50)) for i in range(2500)] + [(-70, "n", "x"), (1_000_000_000, None, None), (7, "again", "y")]
    rows += [(None, "u", f"no id {k % 9}") for k in range(40)] + [(42, "u", "copy")] * 20 + [(8, "long", "z" * 300_000)]
    other = [(i, u, (b or "") + "!" if i in (77, 8) and u != "again" else b) for i, u, b in rows if i not in (1234, -70)] + [(9000, "u", "new"), (1235, "u", "one more"), (None, "u", "new"), (42, "u", "copy"), (42, "u", "other")]
    got = warc_audit.audit(pages_of(spark, rows), pages_of(spark, other[::-1])).collect()
    row = lambda r: (r.page_id, r.file, None if r.digest_a == "" else (r.file, r.offset_a, r.length_a), r.digest_a, None if r.digest_b == "" else (r.file, r.offset_b, r.length_b), r.digest_b, r.fault)
    want = brute_audit(rows, other)
    if crowded == 1024:
        assert Counter(map(row, got)) == Counter(want)
    else:  # slices lie in another order, so only the offsets differ
        assert Counter((r.page_id, r.digest_a, r.digest_b, r.fault) for r in got) == Counter((w[0], w[3], w[5], w[6]) for w in want)
    same = pages_of(spark, [*rows[:5], (None, None, None), rows[0]])
    assert warc_audit.audit(same, same).count() == 0 and warc_audit.audit(same.limit(0), same.limit(0)).count() == 0
    assert {r.fault for r in warc_audit.audit(same, same.limit(0)).collect()} == {"missing"} and warc_audit.audit(same.limit(0), same).count() == 7


def test_trees_are_their_own_and_equal_branches_are_left_alone(spark):
    rows = [(i, "u", "x" * 300) for i in range(200_000, 270_000, 20)]
    pages, other = pages_of(spark, rows), pages_of(spark, [r for r in rows if r[0] != 205_000])
    none = spark.createDataFrame([], "file bigint, range bigint, crowded boolean")
    a, b = (warc_audit.tree(warc_audit.sliced(warc_audit.digests(p), none), 3) for p in (pages, other))
    assert [level.count() for level in a[:4]] == [1, 1, 2, 70] and a[0].first().digest != b[0].first().digest
    bad, met = None, []
    for x, y in zip(a, b, strict=True):
        own = [c for c in x.columns if c not in ("length", "digest")]
        bad = warc_audit.cut(warc_audit.differing(x, y, own, bad), "bad")
        met.append(bad.count())
    assert met == [1] * len(met)  # a lost record changes one branch only, whatever its length
    assert warc_audit.differing(a[0], a[0], ["root"], None).count() == 0


# --- URLs


def test_judge_equals_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("a.b", "/x", "block"), ("b", "/x", "allow")]
    urls = ["http://example.net/en/1", "HTTP://M.Example.NET/en", "https://a.net?x", "x://net/", "ftp://example.com/de/#f", "http://badexample.com/de/", "nothing", "", None, "http://q.a.b/xyz", "http://q.b/xyz", "a://b://c/x", "http://example.net/EN/1", "http://É.net/"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate([*urls, urls[0]])] + [(0, urls[0], "h", "clash")], "page_id bigint, url string, html string, host string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:][: min([rest[end:].find(c) for c in "?#" if c in rest[end:]] or [len(rest)])]
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute(u)) for i, u in [*enumerate([*urls, urls[0]]), (0, urls[0])])
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge(pages, none, "block").collect()} == {"block"}


# --- chat


def test_chat_round_trip(spark):
    tricky = ["", None, "<|im_end|>", "a<", "|im_sep|>", "\\", "<\\|", "\\\\<|<|im_start|>assistant\nok", "é€", "new\nline<\\n|"]
    draw = random.Random(8)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "as\nsist", None]), draw.choice(tricky)) for c in range(30) for t in range(draw.randint(1, 7))]
    rows += [(77, t, "user" if t % 5 else "assistant", f"t{t}") for t in range(700)] + [(78, None, "user", "x"), (78, 3, "user", "a"), (78, 3, "user", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    done = chat_format.format_conversations(df).select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in done.collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        want = [t[2:] for t in turns]
        assert got[c][0] == want
        assert got[c][1] == "".join(x for r, x in want if r == "assistant")
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_merges_neighbours(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id bigint, turn bigint, role string, text string")
    assert chat_format.format_conversations(df).first().formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
