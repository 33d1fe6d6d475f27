"""The training-data operators against plain Python on small tables, with odd inputs."""

from __future__ import annotations

import bisect
import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers as P
from platefold.llm import bpe_count, components, idstore, langid, lm, lsm, packing, quality, search, simhash, spm, vocab
from platefold.llm import queries as Q
from tests.conftest import SF
from tests.oracle import assert_same

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "The the THE end.",
    "The the THE end.",
    "naïve café, Ünïcödé ß İ ΑΣ ς",
    "日本語 テスト 🙂🙂",
    "x\x00y\x1cz\x85w\x02 \x02",
    "tab\tand  two   spaces \n next",
    "<|endoftext|> in text<|endoftext|>",
    "▁▁a▁b <s> </s> <0x0A>",
    "it's don't 12345 67.8%!!",
    "a" * 5000,
    ("word " * 3000).strip(),
    "é" * 40 + " " + "ﬁ" * 3,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1), (3, "\n\n", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, kept int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def unite(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame([*links, (5, None)], "src long, dst long")).collect()}
    want = unite(links, {x for p in links for x in p})
    linked = {x for p in links if p[0] != p[1] for x in p}
    assert got == {n: want[n] for n in linked}


@pytest.mark.parametrize("crowd", [2, 32])
def test_hamming_components(spark, crowd):
    rng = random.Random(2)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = {*centers, 0}
    for _ in range(300):
        f = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    for distance in (1, 2):
        links = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= distance]
        got = [(r["src"], r["dst"]) for r in simhash.hamming_links(df, distance, crowd).collect()]
        assert unite(got, range(len(fps))) == unite(links, range(len(fps)))


def test_simhash_query(spark, texts):
    rows = {r["doc_id"]: r for r in Q.op1_simhash(spark, SF).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    want = unite([(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    assert {i: r["component_id"] for i, r in rows.items()} == want


def test_simhash_odd(odd, empty):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fp"] == 0 and by[0]["component_id"] == by[1]["component_id"] == 0 and by[6]["component_id"] == 5
    assert by[None]["component_id"] is None
    assert simhash.simhash_components(empty).count() == 0


def test_near_duplicate_groups(spark, empty):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows = []
    for k in range(60):
        w = rng.choices(vocabulary, k=200)
        rows.append(" ".join(w))
        v = list(w)
        v[rng.randrange(200)] = "changed"
        rows.append(" ".join(v))
        rows.append(" ".join(w).upper())
        rows.append(" ".join(rng.choices(vocabulary, k=150)))
    df = spark.createDataFrame([*enumerate(rows), (9998, None), (9999, ""), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert len(got) == len(rows) + 2 and got[9998] == got[9999] == 9998
    assert all(got[4 * k + 3] == 4 * k + 3 and got[4 * k + 2] == 4 * k for k in range(60))
    assert sum(got[4 * k + 1] == 4 * k for k in range(60)) >= 59
    assert simhash.near_duplicate_groups(empty).count() == 0


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = Q.op2_packing(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    check_sequences(rows)
    used = sum(r["length"] for r in rows)
    padded = sum({r["sequence_id"]: r["padded_to"] for r in rows}.values())
    assert used / padded > 0.98


def check_sequences(rows, window=1024):
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window


def test_packing_odd(odd, empty):
    rows = packing.pack(odd, P.path("byte_bpe_50k.json"), with_ids=True).collect()
    check_sequences(rows)
    assert {r["doc_id"] for r in rows} == {*range(len(ODD)), None}
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_packing_plan_uses_the_histogram():
    rng = random.Random(4)
    h = collections.Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000))
    plan = packing.solve(h)
    used = collections.Counter()
    for lengths, r in zip(plan.lengths, plan.repeats, strict=True):
        assert sum(lengths) <= 1024 and r > 0
        used.update({n: k * r for n, k in collections.Counter(lengths).items()})
    assert used == h
    assert sum(n * c for n, c in h.items()) / (1024 * sum(plan.repeats)) > 0.995


@pytest.mark.parametrize("most", [12, None])  # lists walked one by one, and windows of documents
def test_search_against_brute_force(spark, texts, docs, most):
    rows = search.search(docs, F.col("doc_id") % 20 == 0, most=most, block=4).collect()
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    df = collections.Counter(w for v in words.values() for w in set(v))
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    for q in (i for i in words if i % 20 == 0):
        count = collections.Counter(words[q])
        own = {w: idf[w] * (k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(words[q]) / mean))) for w, k in count.items()}
        order = sorted(count, key=lambda w: (df[w] <= 1, -round(own[w], 9), np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64)))
        found = []
        for i, v in words.items():
            tf = collections.Counter(v)
            s = sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(v) / mean)) for w in order[:most])
            if s > 0:
                found.append((-round(s, 9), i))
        got = [(-round(r["score"], 9), r["doc_id"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
        want = sorted(found)[:10]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def test_search_odd(odd, empty):
    rows = search.search(odd, F.col("doc_id") >= 0, k=3).collect()
    assert all(1 <= r["rank"] <= 3 and r["doc_id"] not in (0, 1, 2, 3) for r in rows)
    assert {r["doc_id"] for r in rows if r["query_id"] == 5 and r["rank"] <= 2} == {5, 6}
    assert search.search(empty, F.col("doc_id") >= 0).count() == 0


def test_lm_base_is_exact(spark, texts):
    rows = {r["doc_id"]: r for r in Q.op4_lm_scores(spark, SF).collect()}
    toks = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    c = collections.Counter(w for i, v in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in v)
    total, kinds = sum(c.values()), len(c)
    for i, v in toks.items():
        r = rows[i]
        assert r["n_tokens"] == len(v) and r["n_known"] == sum(c[w] > 0 for w in v) and r["train_tokens"] == total
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in v), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_filter_probed_by_shard_gives_the_same(docs):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    a, b = ({r["doc_id"]: r["score"] for r in lm.score(docs, train, head_words=800, **kw).collect()} for kw in ({}, {"broadcast_bytes": 0}))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_lm_large_filter_is_read_and_not_asked_by_shuffle(docs, monkeypatch):
    """The keys of all texts were shuffled to a filter too large to be broadcast, many times the input."""
    train = F.col("doc_id") % 3 > 0
    of = lambda **kw: {r["doc_id"]: r["score"] for r in lm.score(docs, train, head_words=800, **kw).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)
    whole, answers = of(), lm._answers
    monkeypatch.setattr(lm, "_answers", lambda *a: pytest.fail("keys were shuffled"))
    monkeypatch.setattr(lm, "ASKED_TOGETHER", 20_000, raising=False)
    read = of(broadcast_bytes=0)
    monkeypatch.setattr(lm, "_answers", answers)
    monkeypatch.setattr(lm, "_readable", lambda files: False, raising=False)
    assert read == pytest.approx(whole, abs=1e-9) and of(broadcast_bytes=0) == pytest.approx(whole, abs=1e-9)


def test_lm_score_against_exact_counts(spark, docs, texts):
    """The score by plain dictionaries of quantised counts, by the one of the weights that fits best;
    it does not depend on how many words workers know exactly."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got, other = ({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm.score(docs, train, head_words=n).collect()} for n in (500, 0))
    assert got.keys() == other.keys() and all(x == pytest.approx(y, rel=1e-9) for i in got for x, y in zip(got[i], other[i], strict=True))
    got = {i: s for i, (s, _, _) in got.items()}
    toks = {i: [None, *t.encode().lower().split(), None] for i, t in texts.items()}
    known = [v for i, v in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for v in known for w in v[1:])
    two = collections.Counter(x for v in known for x in itertools.pairwise(v))
    total, kinds, steps = sum(one.values()), len(one), lm.THRESHOLDS.tolist()

    def down(c):
        return steps[bisect.bisect_right(steps, c) - 1] if c else 0

    def up(c):
        return steps[bisect.bisect_right(steps, c)] - 1 if c else 0

    def score(v, share, power):
        s = 0.0
        for a, w in itertools.pairwise(v):
            p = (down(one[w]) + 0.5) / (total + 0.5 * (kinds + 1))
            n = up(one[a])
            m = share * max(n, 1) ** power
            s += math.log10((down(two[a, w]) + m * p) / (n + m))
        return s

    some = sorted(i for i in toks if len(toks[i]) < 300)[:40]
    off = {x: sum(abs(score(toks[i], *x) - got[i]) / len(toks[i]) for i in some) / len(some) for x in lm.WEIGHTS}
    assert min(off.values()) < 0.01  # false positives of the filter are all that is left


def test_log_frequency_filter():
    rng = np.random.default_rng(0)
    h, c = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.geometric(0.2, 5000)
    bloom = lm.LogFrequencyBloom([(lm.build_shard(h[h % np.uint64(2) == s], c[h % np.uint64(2) == s]), max(64, lm.BITS_PER_ENTRY * int(lm.level(c[h % np.uint64(2) == s]).sum()))) for s in (0, 1)])
    got = bloom.count(h)
    exact = lm.THRESHOLDS[lm.level(c) - 1]
    assert (got >= exact).all() and (got == exact).mean() > 0.97 and (exact <= c).all()
    assert (bloom.count(rng.integers(0, 2**63, 5000).astype(np.uint64)) == 0).mean() > 0.97


def test_lm_odd(odd, empty):
    rows = lm.score(odd, F.col("doc_id") >= 0).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 or r["n_tokens"] <= 1 for r in rows)
    assert lm.score(empty, F.col("doc_id") >= 0).count() == 0
    assert all(r["n_known"] == 0 for r in lm.score(odd, F.lit(False)).collect())


def test_token_counts_and_chunks(spark, odd, empty):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    alphabet = ["a", "b", " ", " ", "\n", "\t", "\x1d", "'s", "1", "!", "é", "▁", "<", "Σ", "日", "́", "\xa0", "　", "\x02", ".", ",", "The ", "<|endoftext|>"]
    some = [t for t in ODD if t is not None] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        lib = Tokenizer.from_file(P.path(name))
        want = [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in vocab.ChunkTokenizer(P.path(name)).encode(some)] == want
        if name[0] == "b":
            assert bpe_count.TokenCounter(P.path(name)).counts(some) == [len(x) for x in want]
    rows = bpe_count.token_counts(odd, P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == odd.count() and {r["doc_id"]: r["n_tokens"] for r in rows}[0] == 0
    assert bpe_count.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_token_count_query(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = Q.op5_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_sentencepiece_query(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = Q.op10_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_merging_is_by_rank_then_place():
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("b", "a"): 2}
    assert bpe_count.merged_count(list("ababab"), ranks) == 2
    assert bpe_count.merged_count(list("ba"), ranks) == 1
    assert bpe_count.merged_count([], ranks) == 0


def test_sentencepiece(spark, odd, empty):
    import sentencepiece

    rng = random.Random(6)
    alphabet = ["a", "b", " ", " ", "\n", "\x1d", "1", "!", "é", "▁", "<s>", "Σ", "日", "́", "　", "the ", "ing", "ation"]
    some = [t for t in ODD if t is not None] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [lib.encode(t, add_eos=True) for t in some]
    e = spm.BacktrackingEncoder(P.path("piece_bpe_32k.model"))
    assert [i for i, _ in e.encode_all(some)] == want and [e.encode(t)[0] for t in some] == want
    rows = spm.encode_decode(odd, P.path("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows if r["doc_id"] is not None}[5] == ODD[5]
    assert len(rows) == odd.count() and spm.encode_decode(empty, P.path("piece_bpe_32k.model")).count() == 0
    d = {r["doc_id"]: r for r in spm.digests(odd, P.path("piece_bpe_32k.model")).collect()}
    ids = lib.encode(ODD[7], add_eos=True)
    assert d[7]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert d[7]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and d[0]["n_tokens"] == 1


def test_language_id(spark, docs, odd, empty):
    rows = Q.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    known = langid.learn(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(odd, known).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and got[5]["lang_pred"] != "und"
    assert langid.learn(empty, F.lit(True)) == {} and {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}


def plain_bundle(text, size=1024):
    """Sum of a text's trigrams over letters and gaps, letter by letter; None without a letter."""
    if not any(c.isalpha() for c in text):
        return None
    s = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())) + " "
    letter = functools.cache(lambda c: langid.hypervectors(size).letter(ord(c)).astype(np.int64))
    total = np.zeros(size, np.int64)
    for gram, n in collections.Counter(zip(s, s[1:], s[2:], strict=False)).items():
        v = np.ones(size, np.int64)
        for k, c in enumerate(gram):
            v *= np.roll(letter(c), 2 - k)
        total += n * v
    return total


def test_language_query_against_plain_python(spark, docs):
    rows = docs.select("doc_id", "lang", "text").collect()
    bundles = {r["doc_id"]: plain_bundle(r["text"] or "") for r in rows}
    known = collections.defaultdict(lambda: np.zeros(1024, np.int64))
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and bundles[r["doc_id"]] is not None:
            known[r["lang"]] = known[r["lang"]] + bundles[r["doc_id"]]
    got = {r["doc_id"]: r for r in Q.op6_language_id(spark, SF).collect()}
    assert got.keys() == bundles.keys()
    for i, v in bundles.items():
        if v is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosines = {x: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for x, p in known.items()}
        assert math.isclose(got[i]["score"], max(0.0, max(cosines.values())), abs_tol=1e-5)
        assert max(cosines.values()) - cosines[got[i]["lang_pred"]] < 1e-5


def test_no_learned_language(spark, docs):
    """Letters by chance, another alphabet and another language's few words are not written in a learned language; documents are."""
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(3, 9)))
    few = [word("aeiouklmnpstvhjy") for _ in range(14)]
    kinds = [lambda: word("abcdefghijklmnopqrstuvwxyz"), lambda: word("абвгдежзиклмнопрстуф"), lambda: rng.choice(few)]
    rows = [(k, " ".join(kinds[k]() for _ in range(rng.randint(15, 200)))) for k in range(3) for _ in range(50)]
    known = langid.learn(docs, F.lit(True))
    written = langid.written_in(F.col("likeness"), F.col("n_grams"))
    odd = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), known)
    assert odd.where(written).count() <= 5
    found = langid.predict(docs, known).where("lang_pred <> 'und'")
    assert found.where(~written).count() <= 0.005 * found.count()


def test_one_language_and_ties(spark):
    rows = [(1, "the house", "b"), (2, "the house", "a"), (2, "the house", "a"), (None, "the house", None), (3, None, "a"), (4, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "v": F.lit(1)})
    got = langid.predict(docs, langid.learn(docs, F.lit(True))).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "a"), (1, "a"), (2, "a"), (2, "a"), (3, "und"), (4, "und")]
    alone = langid.predict(docs, langid.learn(docs.where("lang = 'b'"), F.lit(True)))
    assert alone.where("lang_pred = 'b' and score > 0.99 and likeness > 0.99").count() == 4


def test_exact_dedup_query(spark):
    assert_same(Q.op7_exact_dedup(spark, SF), Q.oracle_sql()["op7_exact_dedup"], SF)


def test_exact_dedup_odd(spark, odd, empty):
    rows = lsm.exact_groups(odd).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(rows) == odd.count() and by[0][0]["keep_id"] == by[1][0]["keep_id"] == 0 and by[1][0]["group_size"] == 2
    assert sorted(r["kept"] for r in by[3]) == [False, True] and by[6][0]["keep_id"] == 5
    assert by[0][0]["text_sha256"] == hashlib.sha256(b"").hexdigest() and lsm.exact_groups(empty).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_when_digests_collide(spark, odd, monkeypatch, keep):
    """Different texts behind one digest are told apart by their bytes."""
    plain = sorted(map(tuple, lsm.exact_groups(odd, keep=keep).drop("variants").collect()), key=repr)
    monkeypatch.setattr(lsm, "digest_of", lambda text: F.length(text).cast("long") % 3)
    rows = lsm.exact_groups(odd, keep=keep).collect()
    assert max(r["variants"] for r in rows) > 3
    assert sorted((tuple(r)[:-1] for r in rows), key=repr) == plain
    assert {r["keep_id"] for r in rows if r["doc_id"] in (5, 6)} == {5 if keep == "min" else 6}


def test_probe_filter(spark):
    held, others = (spark.range(a, a + 20_000).select(F.xxhash64("id").alias("digest")) for a in (0, 10**6))
    words, size = lsm.probe_filter(held, 20_000)
    assert lsm.probe(held, words, size).count() == 20_000
    assert lsm.probe(others, words, size).count() < 2_000


def test_index_compaction(spark):
    index = lsm.DigestIndex(spark, keep="min", fan_in=2, memtables=3)
    batches = [[(i, f"t{i % 7}") for i in range(k, k + 10)] for k in (20, 10, 0)]
    for b in batches:
        index.flush(spark.createDataFrame(b, "doc_id long, text string").repartition(4))
    assert len(index.runs) > 4
    before = sorted(map(tuple, index.entries().select("digest", "doc_id", "n").collect()))
    index.compact()
    assert len(index.runs) == 1 and sorted(map(tuple, index.entries().select("digest", "doc_id", "n").collect())) == before
    held = spark.createDataFrame([x for b in batches for x in b], "doc_id long, text string")
    seen = {r["doc_id"]: r["first_id"] for r in index.seen(spark.createDataFrame([(90, "t3"), (91, "new")], "doc_id long, text string"), held).collect()}
    assert seen == {90: 3, 91: None}


def test_quality(spark, odd, empty):
    rows = Q.op8_quality(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if labels.get(r["doc_id"]) is not None]
    assert sum(p == q for p, q in known) / len(known) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    none = quality.learn(empty, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r["predicted"] for r in quality.predict(odd, none).collect()} == {1}
    assert quality.predict(empty, none).count() == 0


def test_quality_query_against_plain_python(spark, texts):
    """Score and decision of every document by the same vectors and weights, the threshold from all labelled texts at once."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").dropna(subset=["quality"]).collect()}
    ids = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 4 != 2)
    x = np.array([quality.vector(texts[i]) for i in ids]).astype(np.float16).astype(np.float32)
    good = np.array([labels[i] > 0 for i in ids])
    r = quality.fit_pairs(x, good)
    raw = np.round(r.raw(np.array([quality.vector(texts[i]) for i in ids])) / quality.GRAIN) * quality.GRAIN
    threshold = np.sort(raw)[int((~good).sum())]
    slope = 6 / (np.sort(raw[good])[good.sum() // 2] - np.sort(raw[~good])[(~good).sum() // 2])
    got = {row["doc_id"]: row for row in Q.op8_quality(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        own = r.raw(quality.vector(t))
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-max(-30, min(30, slope * (own - threshold) + math.log(7 / 3))))), abs_tol=1e-6)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(row["predicted"], labels[i]) for i, row in got.items() if row["held_out"] and labels.get(i) is not None]
    assert sum(p == q for p, q in held) > 0.9 * len(held)


def test_quality_learns_from_letters(spark):
    """Texts of one shape, good or bad by their words alone, which no figure about the text tells."""
    rng = random.Random(9)
    good, bad = (["".join(rng.choices(a, k=6)) for _ in range(200)] for a in ("abcdefghij", "klmnopqrst"))
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=40))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"raw": F.lit("x"), "label": F.lit(1)})
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    found = {r["doc_id"]: r["predicted"] for r in quality.rank(docs, labels, F.lit(True)).collect()}
    assert sum(found[i] == int(i % 3 > 0) for i in range(120, 240)) >= 116
    once = {r["doc_id"]: r["predicted"] for r in quality.predict(docs, quality.learn(docs, labels, F.lit(True))).collect()}
    assert once == found


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (13, 1), (1, 0), (3, 0), (4, None), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = quality.rank(odd, labels, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[0] == score[1] == score[2] == score[3] and score[5] == score[6]
    assert min(score[i] for i in (7, 8, 13)) > max(score[i] for i in (1, 3))


def test_pairs_rank_the_good_first():
    rng = np.random.default_rng(1)
    x, good = rng.normal(size=(400, len(quality.FEATURES))), np.arange(400) % 4 > 0
    x[good, 0] += 3
    r = quality.fit_pairs(x, good, pairs=2000)
    s = r.score(x)
    assert s[good].mean() > s[~good].mean() + 0.3 and abs((s >= 0.7).mean() - good.mean()) < 0.02


def test_id_store(spark, texts, odd, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = Q.op9_id_store(spark, SF).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        ids = np.array([*lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = idstore.stage_path(spark, "test")
    idstore.write_ids(odd, P.path("word_bpe_49k.json"), path)
    back = idstore.read_documents(spark, path).collect()
    assert len(back) == odd.count() and {r["doc_id"] for r in back} == {*range(len(ODD)), None}
    plain = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in [*ODD, "no id", ODD[3]]]
    assert sorted(r["ids_crc32"] for r in back) == sorted(zlib.crc32(x.tobytes()) for x in plain)
    assert sorted(r["start"] for r in back) == np.cumsum([0, *(r["n_tokens"] for r in sorted(back, key=lambda r: r["start"]))])[:-1].tolist()
    least = spark.createDataFrame([(-(2**63), "least"), (None, "none"), (None, "none"), (-(2**63), "least")], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in idstore.write_and_read(least, P.path("word_bpe_49k.json")).collect()), key=str) == [-(2**63)] * 2 + [None] * 2
    got = {r["doc_id"]: r["ids"] for r in idstore.lookup(spark, path, [5, 7, 12345]).collect()}
    assert got == {i: [*lib.encode(ODD[i], add_special_tokens=False).ids, 1] for i in (5, 7)}
    assert idstore.write_and_read(empty, P.path("word_bpe_49k.json")).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = np.random.default_rng(n).choice(2**62, n, replace=False).astype(np.uint64) // np.uint64(2) * np.uint64(2)
        keys, copies = np.repeat(keys, 2), np.tile(np.array([0, 1], np.uint64), n)
        keys, copies = (np.array([*x], np.uint64) for x in zip(*sorted(set(zip(keys.tolist(), copies.tolist(), strict=True))), strict=True)) if n else (keys, copies)
        h = idstore.PerfectHash.from_bytes(idstore.PerfectHash.build(keys, copies, np.arange(len(keys)), np.arange(len(keys)) + 1).to_bytes())
        assert sorted(h.slots(keys, copies)) == list(range(len(keys)))
        found, at, count = h.find(keys, copies)
        assert found.all() and (at == np.arange(len(keys))).all() and (count == at + 1).all()
        assert not h.find(keys + np.uint64(1), copies)[0].any()
