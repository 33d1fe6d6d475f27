"""SimHash fingerprints and their exact Hamming join by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``distance // 2 + 1`` segments.  Two fingerprints that
differ in at most ``distance`` bits have a segment that differs in at most one bit, so each
fingerprint is indexed under every segment as it is and under every segment with one bit
wild.  Equal keys give candidates, which are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, join_hot, slices, small_batches, stage
from .components import connected_components
from .lm import _counts, pair, tokens

BITS, SEGMENT = 64, 32
#: Shingles whose bits are unpacked at a time; bounds memory on very long texts.
BLOCK = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit set, least bit first."""
    total = np.zeros(BITS)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def _pack(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def shingle_fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority fingerprint of a text's word shingles, repeats included, as a signed 64-bit int."""
    w = text.encode().lower().split()  # bytes: A-Z only, and splits at 0x20 and 0x09-0x0D only
    if not w:
        return 0
    shingles = [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)] or [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    return _pack(_ones(h) * 2 > len(h))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): the signed 64-bit fingerprint of every whole text.

    Null and empty texts, and texts without a word, have fingerprint zero.  Texts with fewer
    words than a shingle are one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [shingle_fingerprint(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segments(fps: DataFrame, column: str = "fp") -> DataFrame:
    """Rows of ``fps``, once per segment: ``value`` long holds the segment's index and its bits.

    Two segments of 32 bits serve distances up to 2 (and up to 3 by the same argument).
    """
    parts = F.array(*(F.expr(f"{i << SEGMENT}L | (shiftright({column}, {i * SEGMENT}) & {(1 << SEGMENT) - 1}L)") for i in range(BITS // SEGMENT)))
    return fps.withColumn("value", F.explode(parts))


def deletion_variants(values: DataFrame) -> DataFrame:
    """Rows of ``values`` (value, ... of :func:`segments`), once per wild bit: key long, bit int.

    ``key`` holds the wild position and the rest of the value; ``bit`` is what stands at the wild
    position.  Of different values at most two meet in a key, and they differ in that bit alone.
    """
    rows = values.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))))
    one = "shiftleft(1L, _p)"
    key = F.expr(f"shiftleft(cast(_p as bigint), {SEGMENT + 1}) | (value & ~{one})")
    return rows.withColumns({"key": key, "bit": F.expr(f"cast(value & {one} <> 0L as int)")}).drop("_p")


def hamming_links(fps: DataFrame, distance: int = 2, crowd: int = 32) -> DataFrame:
    """Links (src, dst) between rows of ``fps`` (node long, fp long, fp distinct), enough of
    them that two fingerprints within ``distance`` bits (1 or 2) are connected.

    Different segments are indexed once, however many fingerprints have them: under each wild
    bit, where two that differ in it meet, and as they are, where fingerprints with the same
    segment meet.  Only fingerprints of such segments are joined with their keys.

    Keys shared by 2 to ``crowd`` fingerprints are joined pair by pair and verified.  In a
    more crowded key that would be all pairs of a group, so each of its fingerprints is
    instead put into the ball of radius one around it: 65 values, itself and every single
    change.  Two fingerprints are within 2 bits exactly if their balls meet, and within 1
    exactly if one lies in the other's ball, so a star over each value links all of them,
    exactly and in linear space.
    """
    if distance not in (1, 2):
        raise ValueError("the distance must be 1 or 2")
    cut = segments(fps)
    values = stage(cut.groupBy("value").agg(F.count(F.lit(1)).alias("m")), "segments")
    # how many fingerprints have the segment with the wild bit clear, and set
    sides = [F.sum(F.when(F.col("bit") == b, F.col("m")).otherwise(0)).alias(f"m{b}") for b in (0, 1)]
    wild = deletion_variants(values).groupBy("key").agg(*sides).where("m0 > 0 and m1 > 0")
    clear, mask = f"(key & {(1 << SEGMENT + 1) - 1}L)", f"shiftleft(1L, cast(shiftright(key, {SEGMENT + 1}) as int))"
    both = wild.select(F.expr(f"inline(array(struct({clear} as value, m0 as m, key, 0 as bit, m0 + m1 as n), struct({clear} | {mask} as value, m1 as m, key, 1 as bit, m0 + m1 as n)))"))
    same = values.where("m > 1").selectExpr("value", "m", f"value | {SEGMENT << SEGMENT + 1}L as key", "2 as bit", "m as n")
    met = both.unionByName(same).groupBy("value").agg(F.max("m").alias("m"), F.collect_list(F.struct("key", "bit", "n")).alias("keys"))
    sized = stage(join_hot(cut, stage(met, "variants-met"), ["value"], "m").select("node", "fp", F.inline("keys")), "variants")
    pairs = F.expr(
        f"""flatten(transform(xs, (x, i) -> transform(filter(slice(xs, i + 2, {crowd}),
            y -> (x.bit = 2 or x.bit <> y.bit) and bit_count(x.fp ^ y.fp) <= {distance}),
            y -> struct(least(x.node, y.node) as src, greatest(x.node, y.node) as dst))))"""
    )
    near = sized.where(f"n <= {crowd}").groupBy("key").agg(F.collect_list(F.struct("bit", "node", "fp")).alias("xs")).select(F.inline(pairs))
    crowded = sized.where(f"n > {crowd}").select("node", "fp").distinct()
    change = F.explode(F.sequence(F.lit(0), F.lit(BITS)))
    star = crowded.withColumn("i", change).selectExpr("node", f"i = {BITS} own", f"case when i = {BITS} then fp else fp ^ shiftleft(1L, i) end value")
    center = "min(node)" if distance == 2 else "min(case when own then node end)"
    star = star.selectExpr(f"{center} over (partition by value) src", "node dst").where("src <> dst").selectExpr("least(src, dst) src", "greatest(src, dst) dst")
    return near.unionByName(star).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id, component_size) of every document.

    Fingerprints of word shingles link at ``distance`` or fewer bits and component_id is the
    least doc_id reachable.  Equal fingerprints are one class from the start, so copies are
    never paired.  Null and empty texts have fingerprint zero and link like any other; a row
    without an id keeps its fingerprint and is in no component of others; repeated rows stay.
    """
    fp = stage(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    classes = stage(fp.dropna(subset=["doc_id"]).groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")), "classes")
    found = connected_components(hamming_links(classes.select("node", "fp"), distance))
    labelled = stage(classes.join(found, "node", "left").select("fp", "rows", F.coalesce("component", "node").alias("component_id")), "labelled")
    sizes = labelled.groupBy("component_id").agg(F.sum("rows").alias("component_size"), F.count(F.lit(1)).alias("classes"))
    sized = stage(join_hot(labelled, sizes, ["component_id"], "classes"), "components")
    return join_hot(fp, sized, ["fp"], "rows", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("component_size")).alias("component_size")
    )


#: One in so many documents is looked at for shingles that many texts share, and as many of those are told to all.
SAMPLE, SEEN, COMMON = 16, 4, 200_000
#: Rows up to which a set of ids is broadcast.
BROADCAST_IDS = 500_000
#: One shared key more is asked for, and told, for every so many shingles of a text.
MORE = 20
#: Members from which a key is crowded, homes of a member of crowded keys, pivots of a home, and members that meet them in a task.
CROWD, HOMES, PIVOTS, AT_HOME = 64, 3, 32, 128
#: Bits of a sketch for each shingle, at least.
SKETCH = 4
#: Shingles whose columns are multiplied at a time.
COLUMNS = 8192
#: Pairs that one copy of a text serves.
PAIRS_TOGETHER = 500


def _shingle_hashes(text: str, words: int) -> np.ndarray:
    """The set of a text's word shingles as sorted hashes; a text of fewer words is one shingle."""
    t = tokens(text)
    t = t[:-1] if len(t) > 1 else t
    n = max(1, len(t) - words + 1)
    out = t[:n]
    for j in range(1, min(words, len(t))):
        out = pair(out, t[j : j + n])
    return np.unique(out)


def _sketch(hashes: np.ndarray) -> bytes:
    """A bitmap of the set, of a power of two of bits: each shingle sets one."""
    bits = max(64, 1 << (SKETCH * len(hashes) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(hashes >> np.uint64(20)) & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _may_be_alike(x: np.ndarray, n: int, y: np.ndarray, m: int, similarity: float) -> bool:
    """Whether two sketches of sets of n and m leave room for the similarity: a bit that only one has is a shingle that only one has.

    The longer one is folded to the length of the other; a place is the lowest bits of a hash in both.
    """
    k = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, k), axis=0) for z in (x, y))
    both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return both >= similarity * (n + m - both) - 1e-9


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) of every document with an id: groups of near copies.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity``; component_id is the least doc_id reachable.  Texts alike but for A-Z case
    and white space are one class from the start.  Null, empty and blank texts are one class.
    Each text of an id that is repeated with different texts is a node of its own; the id gets
    the least component of them.

    Candidates come from SimHash first: nodes whose fingerprints (:func:`fingerprints`) are equal or link in
    :func:`hamming_links` are compared, and those that are alike are in one component from then on.  Fingerprints
    of texts at ``similarity`` often differ in more bits than that, so the shingles find the rest, and
    make no pair of what the fingerprints have connected.

    All such pairs are found, short of equal 64-bit hashes of different shingles.  Shingles have
    one order for all texts; those that many documents of a sample share come last, which makes
    keys selective and decides nothing else.  Of a set of n shingles the first
    n - ceil(similarity n) + l are its keys, l = 1 + n div MORE: two sets that are alike share
    at least the lesser l of them, so pairs that share fewer are no candidates.  Candidates are
    verified on the texts.

    A key is wide for a text if so few of its shingles come before it that a text of the same size
    with no earlier shingle in common can still be alike.  Two texts for both of which a key is not
    wide do not have it as their first in common: the smaller one's shingles from there on are too few.
    So in keys of more than ``crowd`` texts only pairs with a wide member are made, and pages of one
    template with enough text of their own, for which its shingles are not wide, make none.

    Members of such keys meet pivots first: of a text's crowded keys with wide members those
    with the least hash, by HOMES different hashes, are its homes, and it is compared on whole sets with
    PIVOTS wide members of each.  That puts most of a family of copies in one component, at a cost
    in proportion to its members, and decides nothing else: what is connected by then makes no
    further pair, and all other pairs are made and counted, in groups of
    twice ``crowd`` members at most.  Of a key's members those of its largest component meet only the others.
    No task holds a whole key.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicate_groups(documents(docs, id_col, text_col).dropna(subset=["doc_id"]), words, similarity, crowd)


def _near_duplicate_groups(rows: DataFrame, words: int, similarity: float, crowd: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    seen = _counts(sample, lambda texts: np.concatenate([_shingle_hashes(t, words) for t in texts])).where(F.col("c") >= SEEN)
    seen = seen.orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    hashes, counts = seen.column("h").to_numpy().astype(np.int64).view(np.uint64), seen.column("c").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], counts[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for b in slices(batches):
            twins, fps, sizes, keys, sketches = [], [], [], [], []
            for t in b.column(1).to_pylist():
                fps.append(shingle_fingerprint(t))
                twins.append(xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split())) - 2**63)
                h = _shingle_hashes(t, words)
                sketches.append(_sketch(h))
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, often[at], 0), kind="stable")]
                sizes.append(len(h))
                keys.append(h[: len(h) - ceil(similarity * len(h) - 1e-9) + 1 + len(h) // MORE].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(twins, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "twin", "fp", "size", "keys", "sketch"])

    fp = stage(rows.mapInArrow(run, "doc_id long, twin long, fp long, size int, keys array<long>, sketch binary"), "near-keys")
    # a class of texts is a node, named by its twin hash: an id may have texts of several classes
    classes = stage(fp.groupBy("twin").agg(F.min("doc_id").alias("least"), F.min(F.struct("fp", "size", "keys", "sketch")).alias("m"), F.count(F.lit(1)).alias("rows")).select("twin", "least", "m.fp", "m.size", "m.keys", "m.sketch", "rows"), "near-classes")
    keyed = classes.select(F.col("twin").alias("node"), "size", F.posexplode("keys").alias("place", "key"))
    # keys are counted first; of those with the same members the first in the order of all texts stands for all, with their number
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("s"), F.min("place").alias("place")).where("n > 1")
    met = stage(met.groupBy("n", "s").agg(F.min_by("key", F.struct("place", "key")).alias("key"), F.count(F.lit(1)).alias("weight")).select("key", "n", "weight"), "near-met")
    # a text of this size has this share of its shingles in common with one of the same size that is alike
    share = 2 * similarity / (1 + similarity)
    wide = (F.col("size") - F.col("place")) + F.lit(1e-6) >= F.lit(share) * F.col("size")
    members = join_hot(keyed, met, ["key"], "n").withColumn("wide", (F.col("n") <= crowd) | wide).drop("place")
    members = stage(members, "near-members")
    # what a text misses as it does not meet its like
    narrow = members.where("not wide").groupBy("node").agg(F.sum("weight").alias("missed"))

    # ids that are repeated with different texts: of these only texts of the node's own class will do
    several = stage(fp.groupBy("doc_id").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b").select("doc_id"), "near-several")
    n_several = several.count()

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text): any text of each class."""
        wanted = stage(classes.join(nodes.distinct(), classes["twin"] == F.col("node")).select("node", F.col("least").alias("doc_id")), "near-wanted")
        found = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id")
        if n_several:
            some = F.broadcast(several) if n_several <= BROADCAST_IDS else several
            odd = found.join(some, "doc_id", "left_semi").mapInArrow(own_class, "node long, text string")
            found = found.join(some, "doc_id", "left_anti").select("node", "text").unionByName(odd)
        return found.groupBy("node").agg(F.min("text").alias("text"))

    def own_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text, node = b.column("text").to_pylist(), b.column("node").to_pylist()
            ok = [xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split())) - 2**63 == n for t, n in zip(text, node, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, y in zip(node, ok, strict=True) if y], pa.int64()), pa.array([t for t, y in zip(text, ok, strict=True) if y], pa.string())], ["node", "text"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[bytes, np.ndarray] = {}
            words_of = lambda raw: held[raw] if raw in held else held.setdefault(raw, np.frombuffer(raw, "<u8"))
            close = [_may_be_alike(words_of(x), n, words_of(y), m, similarity) for n, x, m, y in zip(*(b.column(c).to_pylist() for c in ("size_a", "sketch_a", "size_b", "sketch_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(close, pa.bool_())), b.column(1).filter(pa.array(close, pa.bool_()))], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            src, dst = [], []
            held: dict[str, np.ndarray] = {}  # a text that many are compared with is hashed once
            for a, c, ta, tc in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = (held.setdefault(t, h) for t in (ta, tc) for h in [held[t] if t in held else _shingle_hashes(t, words)])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    src.append(a)
                    dst.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def beside(pairs: DataFrame, x: str, y: str, what: DataFrame, total: int) -> DataFrame:
        """What ``what`` (node, ...) has for node ``x`` beside each pair; a node with many pairs is dealt over several tasks."""
        counts = pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n"))
        parts = F.floor(F.col("n") / PAIRS_TOGETHER)
        own = what.withColumnsRenamed({c: x if c == "node" else f"{c}_{x}" for c in what.columns}).join(counts, x).withColumn("part", F.explode(F.sequence(F.lit(0), parts))).drop("n")
        return join_hot(pairs, counts, [x], "n", total=total).withColumn("part", F.pmod(F.xxhash64(y), 1 + parts)).drop("n").join(own, [x, "part"]).drop("part")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b) of nodes: first by sketches, which are small and rule most of them out, then by the texts."""
        pairs = stage(pairs, "near-pairs")
        sketches = classes.select(F.col("twin").alias("node"), "size", "sketch").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        sketches = stage(sketches, "near-sketches")
        told = pairs
        for x in ("a", "b"):  # small rows: a skewed join is split as it runs
            told = told.join(sketches.withColumnsRenamed({"node": x, "size": f"size_{x}", "sketch": f"sketch_{x}"}), x)
        pairs = stage(told.select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(compared, "a long, b long"), "near-close")
        total = pairs.count()
        texts = stage(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "near-texts")
        both = beside(beside(pairs, "a", "b", texts, total), "b", "a", texts, total)
        return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "src long, dst long"), "near-links")

    by_fingerprint = verified(_simhash_pairs(classes.select(F.col("twin").alias("node"), "fp")))
    crowded = members.where(F.col("n") > crowd)
    at = stage(_homes(crowded), "near-homes")
    sizes = at.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.count_if("wide").alias("w")).where("n > 1 and w > 0")
    sizes = stage(sizes.select("home", "n", F.ceil(F.col("n") / AT_HOME).cast("int").alias("chunks")), "near-home-sizes")
    at = stage(at.join(sizes, "home", "left_semi"), "near-at")
    sets = stage(texts_of(at.select("node")).mapInArrow(_sets(words), "node long, shingles binary"), "near-sets")
    links = stage(by_fingerprint.unionByName(_links_to_pivots(at, sizes, sets, similarity)), "near-links")
    found = connected_components(links)
    labelled = _relabel(members, narrow, found)
    last = verified(_candidates(labelled, crowd, similarity))
    found = connected_components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(last))
    named = stage(classes.join(found, classes["twin"] == found["node"], "left").select("twin", "least", "rows", F.coalesce("component", "twin").alias("component")), "near-named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    told = stage(join_hot(named, ids, ["component"], "classes").select("twin", "rows", "component_id"), "near-told")
    return join_hot(fp.select("doc_id", "twin"), told, ["twin"], "rows").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, fp), enough of them to connect what equal and linked fingerprints connect.

    Nodes of one fingerprint are paired with the least of them only.
    """
    least = stage(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("rows")), "near-fingerprints")
    alike = join_hot(nodes.withColumnRenamed("node", "b"), least.select("fp", F.col("node").alias("a"), "rows").where("rows > 1"), ["fp"], "rows").where("a <> b")
    return alike.select("a", "b").unionByName(hamming_links(least.select("node", "fp")).select(F.col("src").alias("a"), F.col("dst").alias("b")))


def _sets(words: int):
    """Each text's set of shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_shingle_hashes(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "shingles"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    kinds, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = np.cumsum(times > 1) - 1  # shingles of one set alone are left out
    keep = times[token] > 1
    owner, column = owner[keep], place[token[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(place[-1]) + 1, COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[part], column[part] - lo] = 1
        total += has @ has.T
    return total


def _forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the matrix connects, one less than there are members."""
    left, edges = np.ones(len(alike), bool), []
    for root in range(len(alike)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(alike[x] & left).tolist()
            left[new] = False
            edges += [(x, y) for y in new]
            queue += new
    return edges


def _dealt(rows: DataFrame, n: str, some_n: str, some: str, each: int) -> DataFrame:
    """``rows`` (node, ``some``, and the counts of a group's members and of those marked) once for each two chunks that a member is compared in.

    Marked members are in chunks of their own, which meet each other and those of the rest; a pair
    of chunks is (low, high), ``own`` a member's own one.
    """
    w, r = (F.ceil(c / F.lit(each)).cast("int") for c in (F.col(some_n), F.col(n) - F.col(some_n)))
    own = F.when(F.col(some), F.pmod(F.xxhash64("node"), F.greatest(w, F.lit(1)))).otherwise(w + F.pmod(F.xxhash64("node"), F.greatest(r, F.lit(1)))).cast("int")
    others = F.when(F.col(some), w + r).otherwise(w)
    dealt = rows.withColumns({"own": own, "others": others}).where("others > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "others")


def _homes(crowded: DataFrame) -> DataFrame:
    """(node, home, wide): the homes of the members (node, key, wide) of crowded keys."""
    home = lambda turn: F.expr(f"min_by(struct(xxhash64({turn}, key) as home, wide), xxhash64(key, {turn}))")
    return crowded.groupBy("node").agg(F.array(*(home(turn) for turn in range(HOMES))).alias("at")).select("node", F.explode("at").alias("x")).select("node", "x.home", "x.wide")


def _links_to_pivots(at: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links of members (node, home, wide) to PIVOTS wide ones of each of their homes.

    A home's members are dealt into chunks, and the pivots go to each; a task holds AT_HOME sets and the pivots', and gives
    back a spanning forest, an edge for a member at most.
    """
    place = F.expr("row_number() over (partition by home order by xxhash64(node, home), node)")
    chosen = at.where("wide").withColumn("r", place).where(F.col("r") <= PIVOTS).join(sizes, "home").select("node", "home", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("pivot"))
    dealt = join_hot(at, sizes, ["home"], "n").select("node", "home", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), F.lit(False).alias("pivot"))
    both = chosen.unionByName(dealt).groupBy("node", "home", "chunk").agg(F.bool_or("pivot").alias("pivot"))

    def compare(table: pa.Table) -> pa.Table:
        node, pivot = (table.column(c).to_numpy() for c in ("node", "pivot"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        both = _common(sets)
        alike = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
        alike &= pivot[:, None] | pivot[None, :]
        np.fill_diagonal(alike, False)
        edges = np.array(_forest(alike), np.int64).reshape(-1, 2)
        return pa.table({"src": pa.array(node[edges[:, 0]], pa.int64()), "dst": pa.array(node[edges[:, 1]], pa.int64())})

    return both.join(sets, "node").groupBy("home", "chunk").applyInArrow(compare, "src long, dst long").distinct()


def _relabel(members: DataFrame, narrow: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the number of keys they miss, and the component that each node is in by now as its label."""
    own = members.groupBy("node").agg(F.count(F.lit(1)).alias("keys")).join(narrow, "node", "left").join(found, "node", "left")
    own = own.select("node", "keys", F.coalesce("component", "node").alias("label"), F.coalesce("missed", F.lit(0)).alias("missed"))
    return stage(join_hot(members, stage(own, "near-labels"), ["node"], "keys").drop("keys"), "near-labelled")


def _candidates(labelled: DataFrame, crowd: int, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes with different labels that share enough keys and have fitting sizes.

    A key of up to ``crowd`` members is one group.  Members of others are dealt into chunks of
    ``crowd``: those of the key's largest component meet the others only, or those for whom the key is not wide
    the wide ones only, whichever leaves fewer.  Of the keys that two texts share at
    most those can be left out that the lesser of them misses.
    """
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.count_if("wide").alias("w"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("members"), F.sum("w").alias("w")).where("top.c < members")
    mixed = mixed.withColumn("others", F.col("members") - F.col("top.c")).withColumn("by_label", F.col("others") <= F.col("w"))
    mixed = mixed.select("key", "members", F.col("top.label").alias("largest"), "by_label", F.least("others", "w").alias("marked_n"))
    rows = join_hot(labelled, stage(mixed, "near-mixed"), ["key"], "members")
    small = F.col("members") <= crowd
    rows = rows.withColumn("marked", small | F.when(F.col("by_label"), F.col("label") != F.col("largest")).otherwise(F.col("wide"))).withColumn("marked_n", F.when(small, F.col("members")).otherwise(F.col("marked_n")))
    rows = _dealt(rows, "members", "marked_n", "marked", crowd)
    rows = rows.select("key", "weight", "low", "high", F.struct("node", "size", "label", "own", "missed", "wide").alias("x"))
    groups = rows.groupBy("key", "weight", "low", "high").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.expr(
        f"""flatten(transform(xs, (x, i) -> transform(filter(slice(xs, i + 2, size(xs)),
            y -> x.label <> y.label and (low = high or x.own <> y.own) and (x.wide or y.wide) and least(x.size, y.size) >= {similarity - 1e-9!r}D * greatest(x.size, y.size)),
            y -> struct(x.node as a, y.node as b, 1 + least(x.size, y.size) div {MORE} - least(x.missed, y.missed) as wanted))))"""
    )
    made = groups.select("weight", F.inline(pairs))
    return made.groupBy("a", "b", "wanted").agg(F.sum("weight").alias("shared")).where(F.col("shared") >= F.col("wanted")).select("a", "b")
