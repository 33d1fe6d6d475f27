"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are 64-bit hashes of words, and an end after each text.  Every token's training count is
exact in the base, the additively smoothed distribution p.  Counts of all words and of all pairs
of adjacent tokens are quantised to powers of a number and stored in a Bloom filter: a key of
level j is put in under levels 1 to j, so probing levels until one is missing gives back its
level.  The model is

    P(w | v) = (c(v, w) + m p(w)) / (c(v) + m)        m = a c(v)**b

with c(v, w), p(w) and c(v) read from the filter for all words alike.  Quantised c(v, w) and p(w)
are rounded down and c(v) up, so that the probabilities after v sum to at most 1 but for the
filter's rare false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, stage
from .idstore import mix

#: Words whose exact counts every worker knows, for the base: as many of the most frequent as stay
#: below this.  Counts of other words are joined; no result depends on the bound.
HEAD = 100_000
BASE = 1.5
#: A key's bits under a level lie in one 64-bit word, so that they are probed at once.
PROBES = 5
BITS_PER_ENTRY = 12
#: Tokens whose keys share a shard of the filter, and the filter's size up to which it is broadcast.
SHARD_TOKENS, BROADCAST_BYTES = 1 << 20, 256 << 20
#: Pairs that are scored at a time.
SLICE = 1 << 15
#: Characters of the texts that a task takes through all shards of a filter that is not broadcast.
ASKED_TOGETHER = 1 << 24
#: Weights (a, b) of the base that are tried; the best on training texts, each pair's own count less one, is taken.
WEIGHTS = ((1.0, 0.5), (3.0, 0.5), (10.0, 0.5), (30.0, 0.5), (1.0, 0.9), (3.0, 0.9), (10.0, 0.9), (100.0, 0.9))
EMPTY_SHARD = (np.zeros(8, np.uint8), 64)
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word holds a space
#: The counts at which levels begin; the last is beyond any 64-bit count.
THRESHOLDS = np.array(sorted({min(ceil(BASE**j), 2**62) for j in range(108)}), np.int64)


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's words, A-Z in lower case, and of the end."""
    w = text.encode().lower().split()
    out = np.empty(len(w) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    out[-1] = END
    return out


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def single(w: np.ndarray) -> np.ndarray:
    """A word's key beside those of pairs."""
    return mix(w, 50)


class Counted:
    """Sums by key within a task, handed on when there are many."""

    MANY = 1 << 22

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> pa.RecordBatch | None:
        self.parts.append(keys)
        self.size += len(keys)
        return self.flush() if self.size >= self.MANY else None

    def flush(self) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64), return_counts=True)
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])


def _counted(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """(h, c): how often each key of a task's texts occurs."""
    counted = Counted()
    for b in slices(batches, 100):
        full = counted.add(keys_of(b.column(0).to_pylist()))
        if full is not None:
            yield full
    yield counted.flush()


def _counts(texts: DataFrame, keys_of) -> DataFrame:
    """(h, c): how often each key occurs, over all texts."""
    return texts.mapInArrow(lambda batches: _counted(batches, keys_of), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Head:
    """The frequent words: sorted hashes, their counts and log probabilities."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, kinds: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(float)
        self.p = (self.counts + 0.5) / (total + 0.5 * (kinds + 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for a rare word."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for each threshold that it reaches."""
    return np.searchsorted(THRESHOLDS, counts, "right")


def _words(size: np.ndarray | int) -> np.ndarray | int:
    """Words of a filter of ``size`` bits."""
    return -(-size // 64)


def _places(h: np.ndarray, lev: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """For each key under a level: its word, below ``words`` (32 bits), and its bits there, at most PROBES."""
    a = mix(h, 100 + lev)
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << (a >> np.uint64(6 * k) & np.uint64(63))
    return ((a >> np.uint64(32)) * np.asarray(words, np.uint64) >> np.uint64(32)).astype(np.int64), bits


def build_shard(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A filter over pairs and their levels, as bytes of bits."""
    top = level(c)
    out = np.zeros(_words(max(64, BITS_PER_ENTRY * int(top.sum()))), np.uint64)
    for j in range(1, int(top.max(initial=0)) + 1):
        at, bits = _places(h[top >= j], j, len(out))
        np.bitwise_or.at(out, at, bits)
    return out.view(np.uint8)


class LogFrequencyBloom:
    """Shards of the filter, one after the other in one array; a pair's shard is its hash's remainder."""

    def __init__(self, shards: list[tuple[np.ndarray, int]]):
        self.sizes = np.array([_words(n) for _, n in shards], np.int64)
        self.starts = np.cumsum([0, *self.sizes[:-1]])
        self.words = (np.concatenate([x for x, _ in shards]) if shards else np.zeros(0, np.uint8)).view(np.uint64)

    def count(self, h: np.ndarray) -> np.ndarray:
        """The quantised count of each pair, 0 if it is not held."""
        found = np.zeros(len(h), np.int64)
        live = np.arange(len(h)) if len(self.sizes) else np.zeros(0, np.int64)
        shard = (h % np.uint64(max(1, len(self.sizes)))).astype(np.int64)
        for j in range(1, len(THRESHOLDS) + 1):
            if not len(live):
                break
            own = shard[live]
            at, bits = _places(h[live], j, self.sizes[own])
            live = live[self.words[self.starts[own] + at] & bits == bits]
            found[live] = THRESHOLDS[j - 1]
        return found


def _head(unigrams: DataFrame, most: int, total: int, kinds: int) -> Head:
    """All words more frequent than the least count that leaves at most ``most`` of them.

    The bound is sought among the thresholds, so the driver sees a number for each of these.
    """
    reach = unigrams.agg(*(F.count(F.when(F.col("c") > int(t), 1)) for t in THRESHOLDS)).first()
    bound = next(int(t) for t, n in zip([0, *THRESHOLDS], [kinds, *reach], strict=True) if n <= most)
    rows = unigrams.where(F.col("c") > bound).toPandas()
    return Head(rows["h"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64), total, kinds)


def _shard_of(h: str, shards: int) -> Column:
    """The remainder of a hash taken as an unsigned number."""
    return F.expr(f"cast(pmod(pmod({h}, {shards}L) + case when {h} < 0 then {2**64 % shards}L else 0L end, {shards}L) as int)")


def _filter(learned: DataFrame, shards: int) -> DataFrame:
    """(shard, size, bits): a filter over the counts of all words and pairs of ``learned`` (text).

    Tasks send their own counts straight to the shard, which sums them up: one shuffle, whose rows
    are a task's keys and counts for a shard, packed.
    """

    def keys_of(texts: list[str]) -> np.ndarray:
        words = [tokens(t) for t in texts]
        at = np.concatenate(words)
        return np.concatenate([single(at), pair(_prior(at, np.cumsum([0, *map(len, words[:-1])])), at)])

    def packed(counted: pa.RecordBatch) -> pa.RecordBatch:
        h, c = (counted.column(k).to_numpy() for k in (0, 1))
        shard = (h.view(np.uint64) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        ids, first = np.unique(shard[order], return_index=True)
        ends = pa.py_buffer((8 * np.append(first, len(h))).astype(np.int32))
        blocks = (pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, ends, pa.py_buffer(x[order])]) for x in (h, c))
        return pa.RecordBatch.from_arrays([pa.array(ids), *blocks], ["shard", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(packed, _counted(batches, keys_of))

    def build(table: pa.Table) -> pa.Table:
        h, c = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(k)]) for k in ("h", "c"))
        order = np.argsort(h)
        h, c = h[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, c = h[new].view(np.uint64), np.add.reduceat(c, new)
        size = max(64, BITS_PER_ENTRY * int(level(c).sum()))
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "size": pa.array([size], pa.int64()), "bits": pa.array([build_shard(h, c).tobytes()], pa.binary())})

    return learned.mapInArrow(run, "shard int, h binary, c binary").groupBy("shard").applyInArrow(build, "shard int, size long, bits binary")


def _prior(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each one; the end before a text's first."""
    prior = np.roll(at, 1)
    prior[first] = END
    return prior


def _readable(files: list[str]) -> bool:
    """Whether Python can read the filter's files, as it can in a shared folder."""
    try:
        return all(pa.fs.FileSystem.from_uri(f)[0].get_file_info(pa.fs.FileSystem.from_uri(f)[1]).is_file for f in files)
    except (pa.ArrowException, ValueError, OSError):
        return False


def _looked_up(h: np.ndarray, files: list[str], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the keys that the filter holds, sorted, and their counts; one shard is in memory at a time."""
    own = (h % np.uint64(shards)).astype(np.int32)
    order = np.argsort(own, kind="stable")
    h, edges = h[order], np.searchsorted(own[order], np.arange(shards + 1))
    found = np.zeros(len(h), np.int64)
    for f in files:
        fs, path = pa.fs.FileSystem.from_uri(f)
        with fs.open_input_file(path) as opened, pa.parquet.ParquetFile(opened) as rows:
            for b in rows.iter_batches(1, columns=["shard", "size", "bits"]):
                for k in range(b.num_rows):
                    part = slice(*edges[b.column(0)[k].as_py() :][:2])
                    found[part] = LogFrequencyBloom([(np.frombuffer(b.column(2)[k].as_buffer(), np.uint8), b.column(1)[k].as_py())]).count(h[part])
    h, found = h[found > 0], found[found > 0]
    order = np.argsort(h)
    return h[order], found[order]


def _answers(asked: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """(rid, keys, counts): what the filter holds of the keys of ``asked`` (rid, keys), where it can be neither broadcast nor read by tasks.

    Keys go to the task that holds their shard, after the shard itself; a task has one shard in
    memory at a time.  Keys that the filter lacks are not sent back.
    """
    probes = asked.select("rid", F.explode("keys").alias("h")).select(_shard_of("h", shards).alias("shard"), F.lit(1).alias("kind"), "rid", "h", F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("bits"))
    held = built.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rid"), F.lit(None).cast("long").alias("h"), "size", "bits")
    meet = probes.unionByName(held).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bloom = -1, LogFrequencyBloom([])
        for b in batches:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)], strict=True):
                if kind[lo] == 0:
                    now, bloom = shard[lo], LogFrequencyBloom([(np.frombuffer(b.column(5)[lo].as_py(), np.uint8), b.column(4)[lo].as_py())])
                elif shard[lo] == now:
                    h = b.column(3).slice(lo, hi - lo).to_numpy()
                    c = bloom.count(h.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([b.column(2).slice(lo, hi - lo).filter(pa.array(c > 0)), pa.array(h[c > 0]), pa.array(c[c > 0])], ["rid", "h", "c"])

    found = meet.mapInArrow(run, "rid long, h long, c long")
    return found.groupBy("rid").agg(F.collect_list(F.struct("h", "c")).alias("x")).select("rid", F.col("x.h").alias("keys"), F.col("x.c").alias("counts"))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``train`` (over doc_id) says which rows are learned from; where it is null the row is not.
    Null and empty texts are the end alone.  Repeated rows are scored and counted as often as
    they occur.  Without training rows every known count is 0 and the base is 0.5 / 0.5.

    Shuffled: a row for each word and each pair and task, and the rare words of each text.
    Broadcast: at most ``head_words`` words, and the filter up to ``broadcast_bytes``; of a larger
    one each task reads the shards from the shared folder, one at a time, for many texts.  Only where Python cannot read that
    folder are the keys of texts shuffled to the shards.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    learned = rows.where(train).select("text")
    unigrams = stage(_counts(learned, lambda texts: np.concatenate([tokens(t) for t in texts])), "unigrams")
    total, kinds = (int(x or 0) for x in unigrams.agg(F.sum("c"), F.count(F.lit(1))).first())
    head = spark.sparkContext.broadcast(_head(unigrams, head_words, total, kinds))
    shards = max(1, ceil(total / SHARD_TOKENS))
    built = stage(_filter(learned, shards), "filter")
    nbytes = int(built.agg(F.sum(F.length("bits"))).first()[0] or 0)

    def gains(c: np.ndarray, cv: np.ndarray, p: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """log10 of each pair's probability, by weight; and without its own count."""
        out = []
        for x, n in ((c, cv), (np.maximum(c - 1, 0), np.maximum(cv - 1, 0))):
            raised = {b: np.maximum(n, 1) ** b for _, b in WEIGHTS}
            weights = (a * raised[b] for a, b in WEIGHTS)
            out.append([np.log10((x + m * p) / (n + m)) for m in weights])
        return tuple(out)

    def laid_out(texts: list[str], seen: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """Tokens, their text, text sizes and priors; ``seen`` keeps the tokens of texts that are asked for twice."""
        words = [tokens(t) for t in texts] if seen is None else [seen[t] if t in seen else seen.setdefault(t, tokens(t)) for t in texts]
        sizes = np.array([len(w) for w in words])
        at, doc = np.concatenate(words), np.repeat(np.arange(len(texts)), sizes)
        return at, doc, sizes, _prior(at, np.cumsum(sizes) - sizes)

    def asked_of(texts: list[str]) -> dict[str, list]:
        at, doc, _, prior = laid_out(texts)
        keys, owner = np.concatenate([pair(prior, at), single(at)]), np.concatenate([doc, doc])
        end = single(np.array([END]))
        return {"keys": [np.unique(np.concatenate([keys[owner == k], end])).view(np.int64) for k in range(len(texts))]}

    def parts(texts: list[str], count, seen: dict[str, np.ndarray] | None = None) -> dict[str, list]:
        """What is known of each text: its base, tokens, known tokens, rare words, and its scores by
        weight, as they are and without each pair's own count.  ``count`` reads the filter."""
        h = head.value
        at, doc, sizes, prior = laid_out(texts, seen)
        total_of = lambda of, x: np.bincount(of, x, len(texts))
        # the words of these texts: least and most that each may have occurred
        kinds_here, back = np.unique(np.concatenate([at, np.array([END])]), return_inverse=True)
        place = h.find(kinds_here)
        i = place[back[:-1]]
        logs = np.where(place >= 0, np.log10(h.p[place]), 0.0)[back[:-1]] if len(h.p) else np.zeros(len(at))
        least = count(single(kinds_here))
        most = np.where(least > 0, THRESHOLDS[np.minimum(np.searchsorted(THRESHOLDS, least, "right"), len(THRESHOLDS) - 1)] - 1, 0)
        p_of = (least + 0.5) / (total + 0.5 * (kinds + 1))
        before = np.roll(back[:-1], 1)
        before[np.cumsum(sizes) - sizes] = back[-1]
        scores = np.zeros((2, len(WEIGHTS), len(texts)))
        keys = pair(prior, at)
        for lo in range(0, len(keys), SLICE):
            part = slice(lo, lo + SLICE)
            different, where, again = np.unique(keys[part], return_index=True, return_inverse=True)  # frequent pairs are looked up once
            for less, g in enumerate(gains(count(different), most[before[part][where]], p_of[back[:-1][part][where]])):
                for k in range(len(WEIGHTS)):
                    scores[less, k] += total_of(doc[part], g[k][again])
        split = lambda x, of: np.split(x, np.searchsorted(of, np.arange(1, len(texts))))
        return {"base": total_of(doc, logs).tolist(), "n_tokens": sizes.tolist(), "known": total_of(doc, i >= 0).astype(int).tolist(), "rare": split(at[i < 0].view(np.int64), doc[i < 0]), "scores": scores[0].T.tolist(), "without": scores[1].T.tolist()}

    def mapped(of, schema: str) -> object:
        """A task that calls ``of`` with a few texts at a time and the rows they come from."""
        kinds_of = {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
        (first, _), *fields = (f.split() for f in schema.split(", "))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                texts = b.column(1).to_pylist()
                at = 0
                while at < len(texts):  # as many texts as hold so many characters, one at least
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= 4 * SLICE):
                        size += len(texts[end])
                        end += 1
                    got = of(texts[at:end], b.slice(at, end - at))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *(pa.array(got[name], kinds_of[kind]) for name, kind in fields)], [first, *(name for name, _ in fields)])
                    at = end

        return run

    def known(keys: np.ndarray, counts: np.ndarray):
        """A reader of what was found of sorted keys."""

        def count(h: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[at] == h, counts[at], 0)

        return count

    def told(b: pa.RecordBatch):
        """A reader of the answers that came with some texts."""
        keys, counts = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x or [], np.int64) for x in b.column(k).to_pylist())]) for k in (2, 3))
        keys, where = np.unique(keys.view(np.uint64), return_index=True)
        return known(keys, counts[where])

    def by_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of a task's texts, as many at a time as hold so many characters."""

        def scored() -> Iterator[pa.RecordBatch]:
            asked, seen = [single(np.array([END]))], {}
            for b in held:
                at, _, _, prior = laid_out(b.column(1).to_pylist(), seen)
                asked.append(np.unique(np.concatenate([pair(prior, at), single(at)])))
            count = known(*_looked_up(np.unique(np.concatenate(asked)), files, shards))
            yield from mapped(lambda texts, _: parts(texts, count, seen), schema)(iter(held))

        held, size = [], 0
        for b in slices(batches, 100):
            held.append(b)
            size += b.column(1).nbytes
            if size >= ASKED_TOGETHER:
                yield from scored()
                held, size = [], 0
        if held:
            yield from scored()

    schema = "doc_id long, base double, n_tokens long, known long, scores array<double>, without array<double>, rare array<bigint>"
    if nbytes <= broadcast_bytes:
        found = {r["shard"]: (np.frombuffer(r["bits"], np.uint8), r["size"]) for r in built.toLocalIterator()}
        bloom = spark.sparkContext.broadcast(LogFrequencyBloom([found.get(s, EMPTY_SHARD) for s in range(shards)] if found else []))
        out = rows.mapInArrow(mapped(lambda texts, _: parts(texts, bloom.value.count), schema), schema)
    elif _readable(files := sorted(built.inputFiles())):
        out = rows.mapInArrow(by_files, schema)
    else:
        kept = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "texts")
        asked = kept.select("rid", "text").mapInArrow(mapped(lambda texts, _: asked_of(texts), "rid long, keys array<bigint>"), "rid long, keys array<bigint>")
        out = kept.join(_answers(asked, built, shards), "rid", "left").select("doc_id", "text", "keys", "counts").mapInArrow(mapped(lambda texts, b: parts(texts, told(b)), schema), schema)
    out = stage(out.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "base", "n_tokens", "known", "scores", "without", "rare"), "scored")
    head.unpersist()
    if nbytes <= broadcast_bytes:
        bloom.unpersist()
    best = out.where(train).agg(*(F.sum(F.col("without")[k]) for k in range(len(WEIGHTS)))).first()
    k = int(np.argmax([x if x is not None else 0.0 for x in best]))
    # rare words: their exact counts by a join, summed up for each text
    rare = out.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("n"))
    joined = rare.join(unigrams, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    logp = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (kinds + 1)))
    sums = joined.groupBy("rid").agg(F.sum(F.col("n") * logp).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    log_rest = F.coalesce("rare_log", F.lit(0.0))
    return out.join(sums, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log_rest).alias("base_score"),
        F.col("scores")[k].alias("score"),
    )
