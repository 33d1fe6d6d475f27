"""Document quality by Bradley-Terry ranking on features of the text.

Features are figures about the whole text and the shares of its letter trigrams, hashed to
buckets.  Of each pair of a document labelled good and one labelled bad the good one is
preferred; the weights minimise the logistic loss on the difference of their features.  The
threshold is a quantile of the scores of all labelled documents: the share of bad ones among them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, stage

#: Labelled documents that the weights are fitted on, and pairs drawn from them: documented bounds.
LABELLED, PAIRS = 20_000, 40_000
#: Pairs in a step of the fit.
STEP = 4_096
#: Buckets of the letter trigrams, a power of two, and how large their shares are against the figures.
BUCKETS, SHARE = 256, 0.2
#: Raw scores are counted in steps of this size for the threshold, as far out as REACH.
GRAIN, REACH = 0.005, 50.0
CUT = 0.7
NOT_PROSE = re.compile(r"[^\w\s.,;:'\"?()\-]")
FEATURES = ("words", "word length", "capitals", "letters", "digits", "symbols", "odd ends", "variety", "top word", "repeated lines", "repeats", "line words", "stops", "capital words", "links", "long words", "runs")


def features(text: str) -> list[float]:
    """Figures about the whole text, each between 0 and about 1; all 0 for a text without a word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text)) or 1
    bare = len(NOT_PROSE.findall(text))
    ends = Counter(w[-1] for w in words)
    stops = sum(ends[c] for c in ".!?")
    odd = sum(k for c, k in ends.items() if not c.isalnum() and c not in ".,;:?)'\"")
    repeated = sum(c for w, c in Counter(zip(words, words[1:], strict=False)).items() if c > 1)
    return [
        min(1.0, log(1 + n) / 8),
        min(1.0, (size - n) / n / 20),
        sum(map(str.isupper, text)) / letters,
        letters / size,
        sum(map(str.isdigit, text)) / size,
        min(1.0, 4 * bare / size),
        odd / n,
        log(1 + len(counts)) / log(1 + n),
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        repeated / n,
        min(1.0, log(1 + n / len(lines)) / 6),
        min(1.0, 4 * stops / n),
        sum(len(w) > 1 and w.isupper() for w in words) / n,
        min(1.0, 10 * (text.count("://") + text.count("@")) / n),
        sum(len(w) > 25 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]


def trigram_shares(text: str) -> np.ndarray:
    """Square roots of the shares of the whole text's letter trigrams, by bucket; digits are alike."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(c) < 3:
        return np.zeros(BUCKETS)
    c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
    with np.errstate(over="ignore"):
        h = (c[:-2] + (c[1:-1] << np.uint64(21)) + (c[2:] << np.uint64(42))) * np.uint64(0x9E3779B97F4A7C15)
    return np.sqrt(np.bincount((h >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64), minlength=BUCKETS) / len(h))


def vector(text: str) -> np.ndarray:
    """All features of a whole text."""
    return np.concatenate([features(text), trigram_shares(text)])


def _widen(x: np.ndarray) -> np.ndarray:
    """What the score is linear in: standardised features, and how far each figure lies out."""
    x = np.clip(x, -4, 4)
    figures = x[..., : len(FEATURES)]
    return np.concatenate([figures, np.maximum(0, np.abs(figures) - 1.5), SHARE * x[..., len(FEATURES) :]], axis=-1)


@dataclass
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _widen((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold and above it."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold) + log(CUT / (1 - CUT)), -30, 30)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, rounds: int = 500, penalty: float = 1e-3, seed: int = 7) -> Ranking:
    """A ranking from features and labels; without both labels all documents score CUT."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES) + BUCKETS
    if not len(x) or good.all() or not good.any():
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k + min(k, len(FEATURES))), 0.0, 0.0)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = _widen((x - mean) / spread).astype(np.float32)
    rng = np.random.default_rng(seed)
    over, under = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    w = m = v = np.zeros(z.shape[1], np.float32)
    for t in range(1, rounds + 1):  # Adam on the mean of log(1 + exp(-w d)), a part of the pairs at a time
        some = np.arange(t * STEP, (t + 1) * STEP) % pairs if pairs > STEP else slice(None)
        d = z[over[some]] - z[under[some]]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = (z @ w).astype(float)
    return _cut(Ranking(mean, spread, w.astype(float), 0.0, 0.0), raw, good, np.ones(len(raw)))


def _cut(ranking: Ranking, raw: np.ndarray, good: np.ndarray, n: np.ndarray) -> Ranking:
    """The ranking with its threshold and slope by raw scores that occur ``n`` times each."""
    if not n[good].sum() or not n[~good].sum():
        return ranking

    def at(x: np.ndarray, n: np.ndarray, share: float) -> float:
        order = np.argsort(x, kind="stable")
        reached = np.cumsum(n[order])
        return float(x[order][min(np.searchsorted(reached, share * reached[-1], "right"), len(x) - 1)])

    apart = at(raw[good], n[good], 0.5) - at(raw[~good], n[~good], 0.5)
    return replace(ranking, threshold=at(raw, n, n[~good].sum() / n.sum()), slope=6 / max(apart, 1e-6))


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return np.array([vector(t) for t in b.column(1).to_pylist()], float).reshape(b.num_rows, len(FEATURES) + BUCKETS)


def _known(labels: DataFrame, learn_from: Column, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label), a row for each id that may be learned from."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna().where(learn_from)
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def _fit(docs: DataFrame, known: DataFrame, most: int) -> Ranking:
    """A ranking fitted on at most ``most`` documents of ``docs`` (doc_id, text) that ``known`` labels.

    Vectors reach the driver packed, two bytes a number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in _vectors(b).astype(np.float16)], pa.binary())], ["doc_id", "x"])

    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x binary")
    rows = sorted(found.join(F.broadcast(some), "doc_id").select("doc_id", "x", "label").collect())
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).astype(np.float32).reshape(len(rows), len(FEATURES) + BUCKETS)
    return fit_pairs(x, np.array([r["label"] > 0 for r in rows], bool))


def _raw(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, raw) of every whole text of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranking.raw(_vectors(b)), pa.float64())], ["doc_id", "raw"])

    return docs.mapInArrow(run, "doc_id long, raw double")


def _settled(ranking: Ranking, raw: DataFrame, known: DataFrame) -> Ranking:
    """The ranking with the threshold of all labelled documents: their scores are counted by steps
    of GRAIN, so the driver sees a bounded number of rows however many are labelled."""
    if not ranking.weights.any():
        return ranking
    step = F.round(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), "raw")) / GRAIN).cast("int")
    by_id = raw.groupBy("doc_id", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))  # an id on many rows is one row
    counted = by_id.join(known, "doc_id").groupBy("step", (F.col("label") > 0).alias("good")).agg(F.sum("n").alias("n")).toPandas()
    return _cut(ranking, counted["step"].to_numpy() * GRAIN, counted["good"].to_numpy(bool), counted["n"].to_numpy(float))


def _scored(raw: DataFrame, ranking: Ranking) -> DataFrame:
    t = F.lit(ranking.slope) * (F.col("raw") - F.lit(ranking.threshold)) + F.lit(log(CUT / (1 - CUT)))
    out = raw.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), t))))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> Ranking:
    """Weights and threshold from labelled documents where ``learn_from`` (over doc_id) holds.

    The weights are fitted on at most ``most`` labelled documents: those whose ids hash lowest.
    The threshold is that of all of them.  A document with several labels is good if one of
    them says so; null labels and null ids count for nothing, and of rows that share an id each
    counts.  With one kind of label alone all documents score CUT.
    """
    rows, known = documents(docs, id_col, text_col), _known(labels, learn_from, id_col, label_col)
    ranking = _fit(rows, known, most)
    return _settled(ranking, _raw(rows.where(learn_from), ranking), known)


def predict(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text and row, also of null ids, and of null and
    empty texts (no words, no trigrams)."""
    return _scored(_raw(documents(docs, id_col, text_col), ranking), ranking)


def rank(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> DataFrame:
    """What ``predict`` says of the rows of ``docs`` after ``learn`` from them, with each text read
    once for its score: raw scores are staged, and the threshold is applied to them."""
    rows, known = documents(docs, id_col, text_col), _known(labels, learn_from, id_col, label_col)
    ranking = _fit(rows, known, most)
    raw = stage(_raw(rows, ranking), "raw")
    return _scored(raw, _settled(ranking, raw, known))
