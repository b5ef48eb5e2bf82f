"""Licence scans by a trained paragraph classifier with template confirmation.

A paragraph is a run of lines between blank ones.  Each of its lines is judged by itself, and
also each window of neighbouring lines that a template may be wrapped over; of the findings of
one family in a paragraph the best is given, from more than one line only if confirmed.  A multinomial logistic regression over sparse word
n-grams (one to three words) gives each paragraph a licence family or ``unknown``.  It is fitted
on notices made from the templates below (words dropped, cut, put into corpus text) and on
corpus paragraphs and mixed-up notices as ``unknown``; a held-out part of them calibrates the
probabilities by one temperature.  A prediction is confirmed by the family's template whose
word pairs the paragraph holds best, if it holds ``CONFIRM`` of them.

Every n-gram of the model holds a word that at most a tenth of the other corpus paragraphs has, so a paragraph
without such a word has the intercept's probabilities, which are ``unknown``, and is passed
over at once; no text is cut.

Defined cases: null or empty text has no paragraphs; very long paragraphs are read whole;
repeated rows are scanned alike; an empty table gives an empty table, as the templates alone can
train the model; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Corpus paragraphs that the model is fitted on at most.
MAX_NEGATIVES = 3000
#: Characters of such a paragraph at most; longer ones are scanned but not learnt from.
MAX_CHARS = 5000
#: Notices made from each template.
VARIANTS = 60
#: Share of a template's word pairs that confirms a prediction.
CONFIRM = 0.8

#: The families and the public wording of their notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "all-rights-reserved": ("All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved."),
}
UNKNOWN = "unknown"
_EDGES = ".,;:!?()[]<>\"'*#%$&"
_TOKEN = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph)


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def notices(corpus: list[str], variants: int, seed: int = 7) -> tuple[list[list[str]], list[str]]:
    """Token lists and families of the training paragraphs."""
    draw = random.Random(seed)
    filler = [tokens(p) for p in corpus] or [[]]
    known = [(family, tokens(t.lower())) for family, texts in TEMPLATES.items() for t in texts]
    rows, families = [], []
    for family, words in known:
        for _ in range(variants):
            kept = [w for w in words if draw.random() > 0.06] if len(words) > 7 else list(words)
            if len(kept) > 14 and draw.random() < 0.3:
                at = draw.randrange(len(kept) // 3)
                kept = kept[at : at + 2 * len(kept) // 3]
            if draw.random() < 0.3:
                kept = draw.choice(filler)[:40] + kept
            rows.append(kept)
            families.append(family)
    pool = [w for _, words in known for w in words]
    for words in filler:
        rows.append(words)
        families.append(UNKNOWN)
    for _ in range(variants * 6):  # words of notices without their order
        mixed = draw.choice(filler)[:30] + draw.sample(pool, draw.randint(1, 6))
        draw.shuffle(mixed)
        rows.append(mixed)
        families.append(UNKNOWN)
    return rows, families


class Model:
    def __init__(self, slots: dict[str, int], weights: np.ndarray, intercept: np.ndarray, temperature: float) -> None:
        self.slots, self.weights, self.intercept, self.temperature = slots, weights, intercept, temperature
        self.families = [UNKNOWN, *TEMPLATES]
        self.longest = max(len(tokens(t.lower())) for texts in TEMPLATES.values() for t in texts)
        self.pairs = {f: [(t, self._pairs(tokens(t.lower()))) for t in texts] for f, texts in TEMPLATES.items()}

    @staticmethod
    def _pairs(words: list[str]) -> set[tuple[str, str]]:
        return set(zip(["", *words], [*words, ""], strict=True)) - {("", "")}

    def with_rare(self, rare: frozenset[str]) -> Model:
        self.rare = rare
        return self

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.slots[g] for g in grams(words) if g in self.slots]
        logit = (self.intercept + self.weights[at].sum(axis=0)) / self.temperature
        p = np.exp(logit - logit.max())
        return p / p.sum()

    def confirm(self, family: str, words: list[str]) -> tuple[str, float]:
        """The template of the family that the words hold best, and the share of its inner word pairs they hold."""
        inner = set(zip(words, words[1:], strict=False))
        scored = [(sum(p in inner for p in pairs if "" not in p) / max(1, sum("" not in p for p in pairs)), t) for t, pairs in self.pairs[family]]
        share, template = max(scored)
        return template, share

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, float, str, float, bool]]]:
        """The number of paragraphs, and what is found in which."""
        found, n = [], 0
        lines: list[str] = []
        told: list[bool] = []  # whether the line has a telling word

        def close() -> None:
            found.extend(self.judge(lines, told, n - 1))
            lines.clear()
            told.clear()

        for line in (text or "").lower().split("\n"):
            bare = line.split()
            if not bare:
                close()
                continue
            if not lines:
                n += 1
            lines.append(line)
            plain = {w.strip(_EDGES) for w in bare}
            # what has punctuation inside is split first
            told.append(not (self.rare.isdisjoint(plain) and all(w.isalnum() for w in plain)) and not self.rare.isdisjoint(tokens(line)))
        close()
        return n, found

    def windows(self, lines: list[str], told: list[bool]) -> Iterator[tuple[list[str], bool]]:
        """Words of each line and window with a telling word, and whether it is a window: of all lines that a template from any place in its first line can reach."""
        split: dict[int, list[str]] = {}
        after = [len(lines)] * (len(lines) + 1)  # the next telling line
        for i in range(len(lines) - 1, -1, -1):
            after[i] = i if told[i] else after[i + 1]
        for i in range(len(lines)):
            words, more, j = [], 0, i
            while after[i] < len(lines) and j < len(lines) and more < self.longest:
                if j not in split:
                    split[j] = tokens(lines[j])
                words = words + split[j]
                more += len(split[j]) if j > i else 0
                if after[i] <= j:
                    yield words, j > i
                j += 1

    def judge(self, lines: list[str], told: list[bool], paragraph: int) -> list[tuple[int, str, float, str, float, bool]]:
        best: dict[str, tuple[int, str, float, str, float, bool]] = {}
        for words, wrapped in self.windows(lines, told) if any(told) else ():
            p = self.probabilities(words)
            k = int(p.argmax())
            if k:
                family = self.families[k]
                template, share = self.confirm(family, words)
                one = (paragraph, family, float(p[k]), template, share, share >= CONFIRM)
                if (one[5] or not wrapped) and (family not in best or (one[5], share, one[2]) > (best[family][5], best[family][4], best[family][2])):
                    best[family] = one
        return list(best.values())


def fit(docs: DataFrame, max_negatives: int = MAX_NEGATIVES, variants: int = VARIANTS, rounds: int = 300) -> Model:
    """Fit and calibrate; of the corpus at most ``max_negatives`` paragraphs reach the driver."""
    # lines of about max_negatives documents, chosen by hash, so that what tasks send doesn't grow with the corpus
    some = docs.select("text", F.xxhash64("text").alias("draw")).where(F.pmod("draw", F.lit(1 << 30)) <= int((1 << 30) * min(1.0, max_negatives / max(1, docs.count()))))
    lines = some.select("draw", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line")).where(f"length(trim(line)) > 0 and length(line) <= {MAX_CHARS}")
    corpus = sorted(r[0] for r in lines.orderBy(F.xxhash64("draw", "at"), "line").limit(max_negatives).select("line").collect())
    notice_words = {w for texts in TEMPLATES.values() for t in texts for w in tokens(t.lower())}
    whole = [set(zip(t, t[1:], strict=False)) for texts in TEMPLATES.values() for t in (tokens(x.lower()) for x in texts)]

    def is_notice(p: str) -> bool:
        words = tokens(p)
        inner = set(zip(words, words[1:], strict=False))
        return any(len(w & inner) >= CONFIRM * len(w) for w in whole)

    corpus = [p for p in corpus if not is_notice(p)]
    heard = Counter(w for p in corpus for w in set(tokens(p)))
    rare = frozenset(w for w in notice_words if heard[w] <= max(2, len(corpus) // 10) and (len(w) > 2 or w in ("cc", "by")))
    rows, families = notices(corpus, variants)
    seen = Counter(g for words, family in zip(rows, families, strict=True) if family != UNKNOWN for g in grams(words) if not rare.isdisjoint(g.split(" ")) and all(w in notice_words for w in g.split(" ")))
    slots = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 5))}
    order = [UNKNOWN, *TEMPLATES]
    x = np.zeros((len(rows), len(slots)), np.float32)
    y = np.zeros((len(rows), len(order)), np.float32)
    for i, (words, family) in enumerate(zip(rows, families, strict=True)):
        x[i, [slots[g] for g in grams(words) if g in slots]] = 1
        y[i, order.index(family)] = 1
    test = np.arange(len(rows)) % 5 == 0
    weights, intercept = np.zeros((len(slots), len(order)), np.float32), np.zeros(len(order), np.float32)
    intercept[0] = 1
    a, b = x[~test], y[~test]
    move_w, move_i = np.zeros_like(weights), np.zeros_like(intercept)
    for _ in range(rounds):  # gradient steps with momentum
        z = a @ weights + intercept
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        move_w = 0.9 * move_w - 1.0 * (a.T @ (p - b) / len(a) + 1e-5 * weights)
        move_i = 0.9 * move_i - 0.2 * (p - b).mean(axis=0)
        weights, intercept = weights + move_w, intercept + move_i
    z, labels = x[test] @ weights + intercept, y[test].argmax(axis=1)

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), labels]).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)
    return Model(slots, weights, intercept, temperature).with_rare(rare)


_FOUND = "array<struct<paragraph:int,family:string,probability:double,template:string,similarity:double,confirmed:boolean>>"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_paragraphs, findings, family`` for every row; ``family`` is that of the surest confirmed finding, else ``unknown``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    item = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.string()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])
    names = [f.name for f in item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [shared.value.scan(t.as_py()) for t in batch.column(1)]
            best = [max(((f[2], f[1]) for f in found if f[5]), default=(0, UNKNOWN))[1] for _, found in done]
            findings = pa.array([[dict(zip(names, f, strict=True)) for f in found] for _, found in done], pa.list_(item))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in done], pa.int32()), findings, pa.array(best, pa.string())], ["doc_id", "n_paragraphs", "findings", "family"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs int, findings {_FOUND}, family string")
