"""Toxicity by weak supervision.

Voters are words (a lexicon) and beginnings and endings of words (patterns) that occur in
toxic training documents far more often than in others.  A generative label model with a
vote of 0 or 1 for each voter and document, given the hidden label, is fitted by
expectation-maximisation: it estimates each voter's accuracy on either class, and from the
votes' residuals the correlations of voters within a class, by which correlated voters
share one voice.  The human label is one more voter.  A linear classifier over the same
features is then trained on the posterior labels and scores every document; its intercept is
moved so that a score of 0.5 is where the training labels are told apart best, by classifiers
that have not seen them.

Only training rows are learnt from: those of ``labels`` whose crc32(doc_id as text) modulo 5
is not 0.  Of them at most ``max_train`` documents of each class are taken, by a hash of
the id; that bound and ``max_features`` bound what reaches the driver.  Scores use the text alone.

Defined cases: null text counts as empty, and an empty text scores what the intercept
gives; the whole text is read whatever its length; repeated rows score alike; labels with
null ids or null marks are left out, repeated labels count as toxic if any of them does;
without a toxic training row every score is 0; empty tables give an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import crc_mod, cut

#: Documents of each class that the model is fitted on at most.
MAX_TRAIN = 4000
#: Features kept at most, by their likelihood ratio.
MAX_FEATURES = 600
#: Lengths of the beginnings and endings of words that may vote.
SHORT, LONG = 3, 8
#: Bounds of the human label's accuracy, which is estimated like any voter's.
HUMAN = (0.9, 0.995)
#: Parts of the training sample, each scored by a classifier of the others to find where to decide.
FOLDS = 3
_EDGE = re.compile(r"^\W+|\W+$")
_FLUSH = 200_000


def word_features(word: str) -> list[str]:
    found = [f"={word}"]
    for n in range(SHORT, min(LONG, len(word)) + 1):
        found += (f"^{word[:n]}", f"${word[-n:]}")
    return found


def distinct_words(text: str | None) -> set[str]:
    bare = set((text or "").lower().split())
    return {w if w.isalnum() else _EDGE.sub("", w) for w in bare} - {""}


@dataclass
class Model:
    """Weights by feature; ``heads`` and ``tails`` say which words can have any."""

    features: list[str]
    weights: np.ndarray
    intercept: float

    def prepare(self) -> Model:
        self.slot = {f: i for i, f in enumerate(self.features)}
        self.words = {f[1:] for f in self.features if f[0] == "="}
        self.heads = {f[1 : 1 + SHORT] for f in self.features if f[0] == "^"}
        self.tails = {f[-SHORT:] for f in self.features if f[0] == "$"}
        return self

    def present(self, text: str | None) -> list[int]:
        slot, words, heads, tails = self.slot, self.words, self.heads, self.tails
        hits = set()
        for w in distinct_words(text):
            if w in words or w[:SHORT] in heads or w[-SHORT:] in tails:
                hits.update(slot[f] for f in word_features(w) if f in slot)
        return sorted(hits)

    def score(self, text: str | None) -> float:
        at = self.present(text)
        return float(1 / (1 + np.exp(-(self.intercept + self.weights[at].sum()))))


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple[DataFrame, float]:
    """``toxic, text`` of the sampled training rows, and the share of toxic ones among all training labels."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sums = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    some = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train) for k in (0, 1)]
    chosen = some[0].unionByName(some[1]).select(F.col("doc_id").alias("marked_id"), "toxic")
    # 2 * max_train rows at most are sent to all tasks
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("marked_id"))
    return cut(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "toxic-sample"), sums[1] / max(1, sums[0])


def pick_features(sample: DataFrame, pos: int, neg: int, max_features: int) -> list[str]:
    """The features that toxic documents surely have three times as often (by two standard errors), best first by likelihood ratio.

    A feature that holds another one, or is held by it, and occurs as often tells nothing new
    and is passed over.
    """
    least = max(3, pos // 50)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["feature", "neg", "pos"])

        seen: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for f in {f for w in distinct_words(text.as_py()) for f in word_features(w)}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    sums = sample.select("toxic", "text").mapInArrow(count, "feature string, neg bigint, pos bigint").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("pos") >= least)
    a, b = (F.col("pos") + 0.5) / (pos + 1.0), (F.col("neg") + 0.5) / (neg + 1.0)
    both = (F.col("pos") + F.col("neg") + 1.0) / (pos + neg + 2.0)
    gain = F.lit(0.0)
    for n, p in ((pos, a), (neg, b)):
        gain = gain + n * (p * F.log(p / both) + (1 - p) * F.log((1 - p) / (1 - both)))
    spread = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    telling = sums.where(F.log(a / b) - 2 * spread > F.log(F.lit(3.0))).withColumn("gain", gain)
    picked: dict[tuple[int, int], list[str]] = {}
    best = telling.orderBy(F.desc("gain"), F.length("feature"), F.desc("feature")).limit(8 * max_features).collect()
    out: list[str] = []
    for feature, n, p in ((r["feature"], r["neg"], r["pos"]) for r in best):
        same = picked.setdefault((n, p), [])
        if len(out) < max_features and not any(feature[1:] in s or s in feature[1:] for s in same):
            same.append(feature[1:])
            out.append(feature)
    return out


def label_model(votes: np.ndarray, marks: np.ndarray, weight: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each document, and each voter's share of a voice.

    ``votes`` is documents x voters of 0 and 1; ``marks`` the human label, which is one more
    voter, with a voice of its own and an accuracy within ``HUMAN``, and starts the rounds.
    """
    full = np.column_stack([votes, marks]).astype(np.float64)
    post = np.clip(marks.astype(np.float64), 0.02, 0.98)
    voice = np.ones(full.shape[1])
    for _ in range(rounds):
        w1, w0 = weight * post, weight * (1 - post)
        p1 = (w1 @ full + 0.5) / (w1.sum() + 1)
        p0 = (w0 @ full + 0.5) / (w0.sum() + 1)
        p1[-1], p0[-1] = np.clip(p1[-1], *HUMAN), 1 - np.clip(1 - p0[-1], *HUMAN)
        rest = full - post[:, None] * p1 - (1 - post)[:, None] * p0
        cov = (rest * weight[:, None]).T @ rest
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        tied = np.abs(cov / sd[:, None] / sd[None, :])
        tied[tied < 0.2] = 0
        np.fill_diagonal(tied, 1)
        voice = 1 / tied.sum(axis=1)
        voice[-1] = 1
        prior = np.clip((weight * post).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        logit = np.log(prior / (1 - prior)) + full @ (voice * np.log(p1 / p0)) + (1 - full) @ (voice * np.log((1 - p1) / (1 - p0)))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, voice


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's steps."""
    full = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    beta = np.zeros(full.shape[1])
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        slope = full.T @ (weight * (p - target)) + penalty * beta
        bend = (full * (weight * p * (1 - p))[:, None]).T @ full + np.diag(penalty + 1e-9)
        move = np.linalg.solve(bend, slope)
        beta -= move
        if np.abs(move).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    sample, share = training_sample(docs, labels, max_train)
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos:
        return Model([], np.zeros(0), -1e3)
    model = Model(pick_features(sample, pos, neg, max_features), np.zeros(0), 0.0).prepare()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [model.present(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.int32()))], ["doc_id", "toxic", "hits"])

    # 2 * max_train rows at most, in a fixed order
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "toxic", "text").mapInArrow(present, f"doc_id {kind}, toxic int, hits array<int>").orderBy("doc_id").collect()
    marks = np.array([r["toxic"] for r in rows], np.int8)
    x = np.zeros((len(rows), len(model.features)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["hits"]] = 1
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(marks == 1, share * len(rows) / pos, (1 - share) * len(rows) / max(1, neg))
    post, _ = label_model(x, marks, weight)
    model.weights, model.intercept = fit_linear(x, post, weight)
    model.intercept += decision_shift(x, post, marks, weight)
    return model


def decision_shift(x: np.ndarray, target: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> float:
    """What to add to the logit so that zero is where the marks of documents not learnt from are met best: by the weighted F measure that minds a missed toxic document twice as much."""
    part = np.arange(len(marks)) % FOLDS
    logit = np.zeros(len(marks))
    for k in range(FOLDS):
        mine = part == k
        if not mine.any() or not marks[~mine].any():
            return 0.0
        w, b = fit_linear(x[~mine], target[~mine], weight[~mine], rounds=10)
        logit[mine] = x[mine] @ w + b
    order = np.argsort(-logit, kind="stable")
    hit, all_ = np.cumsum((weight * marks)[order]), np.cumsum(weight[order])
    ends = np.append(np.flatnonzero(np.diff(logit[order])), len(order) - 1)  # the last of each run of equal logits
    score = 5 * hit[ends] / (all_[ends] + 4 * hit[-1])
    best = ends[int(np.argmax(score))]
    below = logit[order][best + 1] if best + 1 < len(order) else logit[order][best] - 1
    return -float((logit[order][best] + below) / 2)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value.prepare()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mine.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    found = scored(docs, fit(docs, labels, **bounds))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, in one pass and with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value.prepare()
        for batch in batches:
            yield batch.filter(pa.array([mine.score(t.as_py()) < 0.5 for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
