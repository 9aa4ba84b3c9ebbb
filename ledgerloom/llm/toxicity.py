"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import crc_class, keep_rows, map_rows, settle

#: Score from which a document counts as toxic; fixed by the contract.
THRESHOLD = 0.3
#: Labelled rows the model is learnt from at most, taken by a hash of their id.
TRAIN_ROWS = 2_000_000
#: A word stands for itself and for its beginnings of these lengths.
STEMS = (7, 5)
#: The prior, in documents: so many spread over the words as all texts use them, and so much for any word.
PRIOR, FLAT = 50.0, 0.5
#: Standard errors by which log-odds must lie above zero to count, for words and for beginnings.
Z_WORD, Z_STEM = 3.0, 4.5
#: What each word costs a passage, so that passages end: scores are negative on average.
DRIFT = 0.5
#: Expected number of chance passages as good, in a clean text, up to which a passage is significant.
SIGNIFICANT = 0.05

WORD = re.compile(r"\w+")


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from, to, score), left to right, in one pass (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float]] = []  # from, to, sum before, sum at the end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, end, low, high = i, i + 1, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((begin, end, low, high))
                break
            begin, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


@dataclass(frozen=True)
class Model:
    """Log-odds of the telling words, the extreme-value law of clean texts and the calibration."""

    odds: dict[str, float]
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, float, float] = (-2.0, 0.0, 0.0)  # without training rows: a low score for all
    tag: str = ""

    def token_score(self, word: str) -> float:
        s = self.odds.get(word)
        for n in STEMS:
            if s is None and len(word) > n:
                s = self.odds.get(word[:n] + "*")
        return -DRIFT if s is None else s - DRIFT

    def token_scores(self, text: str | None) -> list[float]:
        memory, scores = _remembered(self.tag), []
        words = WORD.findall(text.lower()) if text else []
        for k, w in enumerate(words):
            s = memory.get(w)
            if s is None:
                s = memory[w] = self.token_score(w)
            scores.append(s)
        return scores

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal-scoring passages as (first word, behind the last, score)."""
        scores = self.token_scores(text)
        return len(scores), segments(scores) if scores and max(scores) > 0 else []

    def evidence(self, text: str | None) -> tuple[int, float, float, int]:
        """Words, best passage score, the text's evidence and its significant passages.

        A passage of score S in a text of n words has the expected number
        E = K n exp(-lambda S) of chance equals. The evidence of a text is the sum
        of -ln E over its significant passages; without any, that of its best one.
        """
        n, found = self.passages(text)
        return n, *self.weigh(n, [s for _, _, s in found])

    def weigh(self, n: int, found: list[float]) -> tuple[float, float, int]:
        if not found:
            return 0.0, 0.0, 0
        best = max(found)
        logs = [self.rate * s - math.log(self.scale * n) for s in found]
        good = [x for x in logs if x >= -math.log(SIGNIFICANT)]
        return best, sum(good) if good else max(logs), len(good)

    def score(self, text: str | None) -> float:
        _, best, x, _ = self.evidence(text)
        return self.probability(best, x)

    def probability(self, best: float, evidence: float) -> float:
        z = sum(w * f for w, f in zip(self.weights, features(best, evidence)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_MEMORY: dict[str, dict[str, float]] = {}


def _remembered(tag: str) -> dict[str, float]:
    """Scores of words seen by this worker, for one model at a time; bounded."""
    if tag not in _MEMORY or len(_MEMORY[tag]) > 100_000:
        _MEMORY.clear()
        _MEMORY[tag] = {}
    return _MEMORY[tag]


def features(best: float, evidence: float) -> tuple[float, float, float]:
    """What the calibration sees: nothing found, or the evidence on a scale that flattens out."""
    return (1.0, 1.0 if best > 0 else 0.0, math.copysign(math.log1p(abs(evidence)), evidence) if best > 0 else 0.0)


def log_odds(words: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Log-odds ratio ``odds`` of toxic against clean documents that use a word, and its standard score ``z``.

    The Dirichlet prior is informative: a word gets as much of it as it is used at
    all. ``n_toxic`` and ``n_clean`` count documents, so a long text says a word once.
    """
    prior = FLAT + PRIOR * (F.col("n_toxic") + F.col("n_clean")) / (toxic + clean)
    t, c, mass = F.col("n_toxic") + prior, F.col("n_clean") + prior, PRIOR + 2 * FLAT
    odds = F.log(t / (toxic + mass - t)) - F.log(c / (clean + mass - c))
    return words.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / t + 1 / c))


def word_counts(train: DataFrame) -> DataFrame:
    """Toxic and clean documents that use each word, or a word with each beginning (marked by *)."""
    def run(texts: list, toxic: list) -> Iterator[tuple]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(texts, toxic):
            words = set(WORD.findall(text.lower())) if text else set()
            stems = {w[:n] + "*" for n in STEMS for w in words if len(w) > n}
            counts[label].update(words | stems)
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield from ((w, label, n) for label in (0, 1) for w, n in counts[label].items())
                counts[0].clear()
                counts[1].clear()
        yield from ((w, label, n) for label in (0, 1) for w, n in counts[label].items())

    rows = map_rows(train.select("text", "toxic"), run, 10_000, word="string", toxic="int", n="bigint")
    return rows.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n_toxic"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n_clean"))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Text and label of the labelled documents outside the held-out class, ``TRAIN_ROWS`` of them at most.

    A document with several labels is toxic if one says so. The labels are bounded
    before the join, so they can be sent to all workers and no text is shuffled.
    """
    marked = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (crc_class(key, 4) != 2))
              .groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("toxic")))
    n = marked.count()
    if n > TRAIN_ROWS:
        share = int(TRAIN_ROWS / n * 0.99 * 2**32)
        marked = marked.where(F.pmod(F.xxhash64("k"), F.lit(2**32)) < share)
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(marked), "k").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn log-odds, the extreme-value law and the calibration from the labelled rows.

    Labels, texts and nothing else are looked at. Counts come from Spark; what is
    collected is the lexicon, which the bound of ``TRAIN_ROWS`` texts bounds, and a
    few histograms.
    """
    train = settle(training_rows(docs, labels, key, text, label))
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model({})
    telling = F.when(F.col("word").endswith("*"), Z_STEM).otherwise(Z_WORD)
    lexicon = log_odds(word_counts(train).where("n_toxic > 1"), toxic, clean).where(F.col("z") >= telling)
    odds = {r["word"]: r["odds"] for r in lexicon.select("word", "odds").collect()}
    model = train.sparkSession.sparkContext.broadcast(Model(odds, tag=uuid.uuid4().hex))

    def run(texts: list, toxic: list) -> Iterator[tuple]:
        tally, words = Counter(), 0  # of clean texts, one row for all of them
        for text, label in zip(texts, toxic):
            scores = model.value.token_scores(text)
            hits = [s for s in scores if s > -DRIFT]
            if not label:
                tally.update(round(s, 2) for s in hits)
                words += len(scores)
            yield label, len(scores), [s for _, _, s in segments(scores)] if hits else [], None, None
        yield None, words, None, list(tally), list(tally.values())

    seen = settle(map_rows(train, run, 10_000, toxic="int", n="bigint", found="array<double>", scores="array<double>", times="array<bigint>"))
    rate = _rate(seen.where("toxic is null"))
    chance = F.sum(F.col("n") * F.exp(-rate * F.coalesce(F.array_max("found"), F.lit(0.0))))
    n, mass = seen.where("toxic = 0 and n > 0").agg(F.count("*"), chance).first()
    scale = n / mass if mass else 1.0
    weights = _calibrate(seen.where("toxic is not null"), Model(odds, rate, scale))
    return Model(odds, rate, scale, weights, uuid.uuid4().hex)


def _rate(tallies: DataFrame) -> float:
    """lambda > 0 at which the scores of the words of clean texts have E exp(lambda s) = 1."""
    total = tallies.agg(F.sum("n")).first()[0]
    both = tallies.select(F.explode(F.arrays_zip("scores", "times")).alias("b"))
    rows = both.groupBy(F.col("b.scores").alias("s")).agg(F.sum("b.times").alias("count")).collect()
    hit = sum(r["count"] for r in rows)
    if not hit:
        return 1.0
    s = np.array([-DRIFT, *(r["s"] for r in rows)])
    p = np.array([total - hit, *(r["count"] for r in rows)]) / total
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if p @ np.exp(np.minimum(mid * s, 600)) > 1 else (mid, high)
    return low


def _calibrate(seen: DataFrame, model: Model) -> tuple[float, float, float]:
    """Logistic weights for ``features``, from counts of the evidence in steps of 1/20."""
    law = Model({}, model.rate, model.scale)

    def run(labels: list, ns: list, founds: list) -> Iterator[tuple]:
        for y, n, found in zip(labels, ns, founds):
            best, x, _ = law.weigh(n, found)
            _, has, z = features(best, x)
            yield y, int(has), round(20 * z)

    rows = map_rows(seen.select("toxic", "n", "found"), run, toxic="int", has="int", z="int").groupBy("toxic", "has", "z").count().collect()
    x = np.array([(1.0, r["has"], r["z"] / 20) for r in rows])
    y, n = np.array([float(r["toxic"]) for r in rows]), np.array([float(r["count"]) for r in rows])
    w, ridge = np.zeros(3), 0.05 * np.eye(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text scores below ``THRESHOLD``, with all their columns.

    Whole texts are scored, of any length; null and empty ones have the score of
    texts without a passage; repeated rows go or stay together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda texts: [sent.value.score(t) < THRESHOLD for t in texts])


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score, predicted, n_words, passages, n_significant.

    ``passages`` are the significant ones as flat (first word, behind the last,
    score) triples. One pass over the documents beside the fit; nothing shuffled
    but word counts of labelled rows.
    Defined cases: null and empty texts have no passage and the score of such
    texts; without labels of both kinds all scores are low; repeated rows give
    repeated results; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))

    def run(keys: list, held: list, texts: list) -> Iterator[tuple]:
        model = sent.value
        limit = -math.log(SIGNIFICANT)
        for k, h, t in zip(keys, held, texts):
            n, found = model.passages(t)
            best, x, good = model.weigh(n, [s for _, _, s in found])
            score = model.probability(best, x)
            flat = [float(v) for p in found if model.rate * p[2] - math.log(model.scale * n) >= limit for v in p]
            yield k, h, score, int(score >= THRESHOLD), n, flat, good

    slim = docs.select(F.col(key).alias("doc_id"), (crc_class(key, 4) == 2).alias("held_out"), F.col(text).alias("text"))
    return map_rows(slim, run, doc_id="bigint", held_out="boolean", score="double", predicted="int", n_words="bigint",
                    passages="array<double>", n_significant="int")
