"""Near copies against a brute force over all pairs."""

from __future__ import annotations

import random

import pytest
from platefold.llm import simhash


def groups(texts: dict[int, str], similarity: float = 0.8) -> dict[int, int]:
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: find(d) for d in texts}


def word(rng):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))


def family(rng, first, size, base, edits):
    """Different copies of a text, some words of each changed."""
    out = {}
    for d in range(first, first + size):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(0, edits)):
            w[at] = word(rng)
        out[d] = " ".join(w)
    return out


def grouped(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}


def test_crowded_families(spark):
    """Hundreds of copies far from any middle, and two families that share a passage."""
    rng = random.Random(3)
    base, passage = [word(rng) for _ in range(120)], [word(rng) for _ in range(90)]
    texts = family(rng, 0, 300, base, 6)
    for k in range(2):
        own = [word(rng) for _ in range(60)]
        texts |= family(rng, 1000 * (k + 1), 40, passage + own, 5)
    # chains: each link of a chain is near the one before only
    w = list(base)
    for d in range(5000, 5040):
        at = 3 * (d - 5000) % 110
        w[at : at + 3] = [word(rng) for _ in range(3)]
        texts[d] = " ".join(w)
    assert grouped(spark, texts) == groups(texts)


@pytest.mark.parametrize("edit", ["block", "scattered"])
def test_recall_by_kind_of_edit(spark, edit):
    """Pairs just above 0.8, by a passage added in one place or by single words changed."""
    rng = random.Random(edit)
    vocabulary = [word(rng) for _ in range(2000)]
    texts = {}
    for d in range(0, 400, 2):
        n = rng.choice((100, 300))
        w = [vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(n)]
        texts[d] = " ".join(w)
        if edit == "block":
            at, m = rng.randrange(n), int(n * 0.14)
            w[at:at] = [vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(m)]
        else:
            for at in rng.sample(range(n), max(1, n // 50)):
                w[at] = word(rng)
        texts[d + 1] = " ".join(w)
    expected = groups(texts)
    assert sum(expected[d] != d for d in texts) > 150
    assert grouped(spark, texts) == expected


def template_texts(rng, size, shared=150, own=42):
    base = [word(rng) for _ in range(shared)]
    return {d: " ".join(base + [word(rng) for _ in range(own)]) for d in range(size)}


def test_pages_of_one_template(spark):
    """Hundreds of pages with the same passage and enough text of their own, among them true copies and the bare passage."""
    rng = random.Random(11)
    texts = template_texts(rng, 300)
    for d in range(0, 300, 30):  # copies of some pages, a few words changed
        w = texts[d].split()
        for at in rng.sample(range(len(w)), 4):
            w[at] = word(rng)
        texts[1000 + d] = " ".join(w)
    w = texts[7].split()[:150]
    for d in range(2000, 2090):  # the passage with little beside it
        texts[d] = " ".join(w + [word(rng) for _ in range(rng.randint(0, 25))])
    assert grouped(spark, texts) == groups(texts)


@pytest.mark.parametrize("seed", range(3))
def test_templates_near_the_threshold(spark, seed):
    """Own text from far too much to almost none, before, after and around the passage."""
    rng = random.Random(seed)
    base = [word(rng) for _ in range(100)]
    texts = {}
    for d in range(260):
        before, after = ([word(rng) for _ in range(rng.choice((0, 2, 5, 10, 20)))] for _ in range(2))
        cut = rng.choice((0, 0, 5))
        texts[d] = " ".join(before + base[cut:] + after)
    expected = groups(texts)
    assert 1 < len(set(expected.values())) < 260
    assert grouped(spark, texts) == expected


def test_sketches_never_rule_out_what_is_alike():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 300, 5000):
        for share in (0.5, 0.75, 0.8, 0.85, 0.95, 1.0):
            base = rng.integers(0, 2**63, n, np.uint64)
            for m in (n, max(1, int(n * 0.85))):
                kept = base[: int(min(n, m) * share)]
                x, y = base, np.concatenate([kept, rng.integers(0, 2**63, m - len(kept), np.uint64)])
                both = len(np.intersect1d(x, y))
                may = simhash._may_be_alike(*(z for h in (x, y) for z in (np.frombuffer(simhash._sketch(h), "<u8"), len(np.unique(h)))), 0.8)
                assert may or both < 0.8 * (len(np.unique(x)) + len(np.unique(y)) - both)
                if n >= 300 and share == 0.5:
                    assert not may


def test_fingerprints_find_what_is_within_two_bits(spark, monkeypatch):
    """Without the shingle join, near copies of few differing bits are found by SimHash; unlike texts of one fingerprint are not linked."""
    rng = random.Random(8)
    vocabulary = [word(rng) for _ in range(3000)]
    texts = {}
    for d in range(0, 60, 2):
        w = rng.choices(vocabulary, k=600)
        texts[d], texts[d + 1] = " ".join(w), " ".join([*w, word(rng)])
    for d in (100, 101):
        texts[d] = "lorem ipsum dolor " * 50 + " ".join(word(rng) for _ in range(20))
    fp = {d: simhash.shingle_fingerprint(t) for d, t in texts.items()}
    close = {d: d - 1 if d < 100 and d % 2 and ((fp[d] ^ fp[d - 1]) & 2**64 - 1).bit_count() <= 2 else d for d in texts}
    assert sum(close[d] != d for d in texts) >= 10 and fp[100] == fp[101]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "_candidates", lambda *_: none)
    monkeypatch.setattr(simhash, "_links_to_pivots", lambda *_: none.toDF("src", "dst"))
    assert grouped(spark, texts) == close


def test_small_joins_and_stars_take_no_broadcasts_and_rounds(spark, monkeypatch):
    """Without a hot key nothing is broadcast; links that are stars already are not worked on; paths still come out right."""
    from platefold.llm import common, components

    left, right = spark.range(1000).selectExpr("id % 50 as k", "id"), spark.range(60).selectExpr("id as k", "20L as n")
    for how, rows in (("inner", 1000), ("left", 1000)):
        joined = common.join_hot(left, right, ["k"], "n", how)
        assert "broadcast" not in joined._jdf.queryExecution().analyzed().toString().lower() and joined.count() == rows
    staged = []
    monkeypatch.setattr(components, "stage", lambda df, name: staged.append(name) or common.stage(df, name))
    found = components.connected_components(spark.createDataFrame([(k * 10, k * 10 + j) for k in range(9) for j in range(1, 6)], "src long, dst long"))
    assert {(r["node"], r["component"]) for r in found.collect()} == {(k * 10 + j, k * 10) for k in range(9) for j in range(6)} and len(staged) == 1
    found = components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20] + [(70, 3), (3, 3)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {k: 0 if k <= 20 or k == 70 else 21 for k in [*range(41), 70]}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
