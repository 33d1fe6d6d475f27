"""Bit-sliced search against a plain sum over all documents."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
from platefold.llm import bitslice
from platefold.llm import queries as Q

from ..conftest import SF
from ..oracle import assert_same

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(found), sum(c.total() for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = set()
    for i, text in items:
        scores = []
        for d, c in found:
            m = 100 - 25 + 25 * c.total() * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out |= {(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def found(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' item_id", "'y' term", "1 score", "2 `rank`").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' doc_id", "'y' c")
    return {tuple(r) for r in bitslice.search(bitslice.build_index(d), i, k).collect()}


def test_random(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß", "ſ", "日本", "a b"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: " ".join(r.choices(vocabulary, weights, k=n))
    docs = [(k, text(r.choice([0, 1, 5, 40]))) for k in range(400)] + [(k, "w0 w1, W0-w2") for k in range(1000, 1100)] + [(5000, text(30_000)), (None, "w0 w50"), (7, "w7 w7"), (7, "w7 w7"), (8, None)]
    items = [(k, text(r.choice([1, 3, 30]))) for k in range(80)] + [(100, None), (101, "..."), (102, "nowhere"), (103, "w0 " * 1000 + "w1"), (None, "w0")]
    assert found(spark, docs, items) == plain(docs, [x for x in items if x[0] is not None], 20)
    assert found(spark, docs, items[:7], 1) == plain(docs, items[:7], 1)


def test_small_shards_and_blocks(spark, monkeypatch):
    """Blocks of queries are cut on the driver; shards are made small by the rows' partitions."""
    monkeypatch.setattr(bitslice, "TERMS_AT_ONCE", 7)
    docs = [(k, f"a{k % 5} b{k % 7} c c") for k in range(90)]
    items = [(k, f"a{k} b{k} c") for k in range(6)]
    assert found(spark, docs, items, 5) == plain(docs, items, 5)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == set()
    assert found(spark, [(1, "a"), (2, "")], []) == set()
    assert found(spark, [(1, None), (2, " .")], [(1, "a")]) == set()


def test_slices_add_up():
    r = np.random.default_rng(1)
    n = 200
    row = {"ids": np.arange(n, dtype="<i8").tobytes(), "known": np.ones(n, np.uint8).tobytes(), "lengths": r.integers(5, 50, n).astype("<i8").tobytes(), "df": np.array([n, 3]), "docs": np.concatenate([np.arange(n), [0, 64, 199]]).astype("<u4").tobytes(), "tf": r.integers(1, 9, n + 3).astype("<u4").tobytes()}
    s = bitslice.Slices(row, n, 5000)
    total = s.sums([[(0, 12345), (1, 7)], [(1, 999)]], 48)
    bits = np.unpackbits(np.ascontiguousarray(total).view(np.uint8).reshape(48, 2, -1), axis=2, bitorder="little")[:, :, :n].astype(np.int64)
    scores = (bits << np.arange(48)[:, None, None]).sum(axis=0)
    impact = lambda lo, hi: 10**9 * s.tf[lo:hi].astype(int) // (1000 * s.tf[lo:hi].astype(int) + 12 * s.m[s.docs[lo:hi]])
    wanted = np.zeros((2, n), np.int64)
    wanted[0] += 12345 * impact(0, n)
    wanted[0, [0, 64, 199]] += 7 * impact(n, n + 3)
    wanted[1, [0, 64, 199]] += 999 * impact(n, n + 3)
    assert (scores == wanted).all()


def test_query(spark):
    assert_same(Q.queries()["op11_impact_search"](spark, SF), Q.oracle_sql()["op11_impact_search"], SF)
