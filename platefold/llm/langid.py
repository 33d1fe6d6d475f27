"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A letter n-gram is bound by multiplying its
letters' vectors, each rotated by its place; a text is the bundle (sum) of its n-grams, and a
language's prototype the bundle of its texts.  The language whose prototype has the largest
cosine with a text is predicted.  How likely the text is written in it at all is told by the
cosine with the prototype less what all prototypes have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices
from .idstore import mix

NGRAM = 3
#: n-gram vectors that a worker remembers.
HELD = 24_000
#: Languages that can be learned; the prototypes are broadcast, so their number is bounded.
MOST_LANGUAGES = 2_000
GAP = 32
#: Spreads of chance that a text's likeness must exceed, and different n-grams from which a text tells its language fully.
NOISE, TELLING = 3.5, 80


class Hypervectors:
    """Vectors of ``size`` for letter n-grams, made when first asked for."""

    def __init__(self, size: int):
        self.size = size
        self.letters: dict[int, np.ndarray] = {}
        self.rows = np.zeros((HELD, size), np.int8)
        self.row_of: dict[int, int] = {}
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            bits = np.unpackbits(mix(np.arange(self.size // 64, dtype=np.uint64), c).astype("<u8").view(np.uint8))
            self.letters[c] = bits.astype(np.int8) * 2 - 1
        return self.letters[c]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's different n-grams over letters and gaps, and how often each occurs."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        letter = self.is_letter[c]
        if not letter.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        c = np.where(letter, c, GAP)
        c = np.concatenate([[GAP], c[(c != GAP) | np.concatenate([[True], c[:-1] != GAP])], [GAP]]).astype(np.uint64)
        key = sum(c[i : len(c) - NGRAM + 1 + i] << np.uint64(21 * (NGRAM - 1 - i)) for i in range(NGRAM))
        return np.unique(key, return_counts=True)

    def place(self, key: int) -> int:
        i = self.row_of.get(key)
        if i is None:
            if len(self.row_of) == HELD:
                self.row_of.clear()
            i = self.row_of[key] = len(self.row_of)
            v = np.ones(self.size, np.int8)
            for k in range(NGRAM):
                v = v * np.roll(self.letter(key >> 21 * (NGRAM - 1 - k) & 0x1FFFFF), NGRAM - 1 - k)
            self.rows[i] = v
        return i

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.size)
        for at in range(0, len(keys), HELD // 4):
            some = keys[at : at + HELD // 4].tolist()
            if len(self.row_of) + len(some) > HELD:
                self.row_of.clear()
            total += counts[at : at + HELD // 4].astype(np.float32) @ self.rows[[self.place(k) for k in some]].astype(np.float32)
        return total


_open: dict[int, Hypervectors] = {}


def hypervectors(size: int) -> Hypervectors:
    if size not in _open:
        _open[size] = Hypervectors(size)
    return _open[size]


def learn(docs: DataFrame, learn_from: Column, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of every language, from the rows where ``learn_from`` holds and lang is not null.

    Each task bundles its own rows by language; the bundles are whole numbers and are summed
    in Spark, so the prototypes do not depend on the order.  The driver gets ``size`` numbers
    for each language.
    """
    rows = docs.where(learn_from & docs[lang_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hv = hypervectors(size)
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, counts = hv.grams(text)
                if len(keys):
                    by.setdefault(lang, []).append((keys, counts))
            for lang, found in by.items():
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([c for _, c in found]))
                total[lang] = total.get(lang, 0) + hv.bundle(keys, counts)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.rint(v).astype(np.int64).tolist()], pa.list_(pa.int64()))], ["lang", "v"])

    sums = rows.mapInArrow(run, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, at, x in sums.toLocalIterator():
        if lang not in out and len(out) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        out.setdefault(lang, np.zeros(size))[at] = x
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, likeness, n_grams) of every whole text and row, also of null ids.

    score is the cosine, 0 at least; likeness the predicted language's cosine once the mean of the
    prototypes is taken away (with one language the cosine itself); n_grams how many different
    n-grams the text has.  ``und`` with zeros if the text is null, has no letter, or nothing was
    learned.  Of equal cosines the language first in order wins.
    """
    langs = sorted(prototypes)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    of_langs = unit(np.array([prototypes[x] for x in langs], float).reshape(len(langs), size))
    shared = docs.sparkSession.sparkContext.broadcast((of_langs, unit(of_langs - of_langs.mean(0)) if len(langs) > 1 else of_langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hv, (known, own) = hypervectors(size), shared.value
        for b in slices(batches):
            pred, score, likeness, n_grams = [], [], [], []
            for text in b.column(1).to_pylist():
                keys, counts = hv.grams(text)
                n_grams.append(len(keys))
                if not len(keys) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    likeness.append(0.0)
                    continue
                v = unit(hv.bundle(keys, counts))
                cosines = known @ v
                best = int(np.argmax(cosines))
                pred.append(langs[best])
                score.append(float(min(1.0, max(0.0, cosines[best]))))
                likeness.append(float(own[best] @ v))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(likeness, pa.float64()), pa.array(n_grams, pa.int64())], ["doc_id", "lang_pred", "score", "likeness", "n_grams"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, likeness double, n_grams long")


def written_in(likeness: Column, n_grams: Column, size: int = 1024) -> Column:
    """Whether a text is written in the language predicted for it.

    Letters of no learned language come to a likeness by chance alone, of spread 1 / sqrt(size)
    however long the text is; NOISE spreads rule it out.  A text of fewer than TELLING n-grams
    tells less, and as much less is asked of it.
    """
    return likeness > F.least(n_grams / TELLING, F.lit(1.0)) * (NOISE / size**0.5)
