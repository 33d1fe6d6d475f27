"""Token ids in binary shards, with a minimal perfect hash index for access by document key.

A shard holds the ids of consecutive documents as one raw little-endian array (16 bits where
the vocabulary allows it, else 32), the documents' keys in order, and the index: levels of bits
that give each key a slot of its own, and for each slot a fingerprint of its key with the place
and number of its ids.  Nothing else says where a document's ids lie; an access is a hash or two
and one comparison.  A key is a doc_id and a copy number: 0, and more for rows repeated with one
id; rows without an id are numbered downwards from -1.

Shards are rows of a Parquet table: Spark's commit makes a lost or repeated task harmless, and
any store that Spark writes to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage_path
from .vocab import chunk_tokenizer

SHARD = "part int, shard int, before long, first_key long, last_key long, n_docs long, n_ids long, width int, keys binary, copies binary, index binary, payload binary"
#: Ids after which a shard is closed; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
#: Places for each key in a level of the index.
SPARE = 2
#: Texts encoded at a time.
TEXTS = 1000
#: Words that a worker remembers in each of two generations.
WORDS = 400_000

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 mixer's


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 well-mixed bits of each of ``x``."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n different 64-bit keys: a row of levels of bits.

    A key is hashed to a place of the first level; where no other key falls its bit is set, and
    the others go on to the next level.  A key's slot is the number of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        self.sizes, self.words, self.prints, self.starts, self.counts = sizes, words, prints, starts, counts
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _hash(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
        return mix(keys, seed) ^ mix(copies, seed + (1 << 20))

    @classmethod
    def _print(cls, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        return (cls._hash(keys, copies, 1) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, copies: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> PerfectHash:
        sizes, words, left, level = [], [], np.arange(len(keys)), 0
        while len(left):
            size = -(-SPARE * len(left) // 64) * 64
            at = (cls._hash(keys[left], copies[left], 2 + level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
            level += 1
        made = cls(np.array(sizes, np.int64), np.concatenate([*words, np.zeros(0, "<u8")]).astype("<u8"), *(np.zeros(len(keys), np.uint32) for _ in range(3)))
        slot = made.slots(keys, copies)
        made.prints[slot], made.starts[slot], made.counts[slot] = cls._print(keys, copies), starts, counts
        return made

    def slots(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Each key's slot; some slot, or -1, for a key that was not built in."""
        slot, live, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(live):
                break
            at = (self._hash(keys[live], copies[live], 2 + level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            own = live[hit]
            slot[own] = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            live, base = live[~hit], base + size
        return slot

    def find(self, keys: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, start, count) of each key; found is by fingerprint, wrong for one stranger in 2**32."""
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.slots(keys, copies)
        return (slot >= 0) & (self.prints[slot] == self._print(keys, copies)), self.starts[slot].astype(np.int64), self.counts[slot].astype(np.int64)

    def to_bytes(self) -> bytes:
        return struct.pack("<qqq", len(self.sizes), len(self.words), len(self.prints)) + self.sizes.astype("<i8").tobytes() + self.words.tobytes() + b"".join(x.astype("<u4").tobytes() for x in (self.prints, self.starts, self.counts))

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        levels, words, n = struct.unpack_from("<qqq", raw)
        at = 24 + 8 * levels
        rest = at + 8 * words
        return cls(np.frombuffer(raw, "<i8", levels, 24), np.frombuffer(raw, "<u8", words, at), *(np.frombuffer(raw, "<u4", n, rest + 4 * n * k) for k in range(3)))


def write_ids(docs: DataFrame, path: str, out: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text with the tokenizers file ``path``, add ``end`` to each, and write
    shards in ascending id order to ``out``.

    A null or empty text has the end id alone.  Rows without an id come first.  Rows repeated
    with one id follow each other, ordered by a hash of the text, so that different texts of one
    id (or of none) need not lie in one partition.
    """
    rows = documents(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(path, end, WORDS)
        width = 2 if max(tok.lib.get_vocab_size(), end + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        keys: list = []
        counts: list = []
        held: list[bytes] = []
        state = {"before": 0, "shard": 0, "ids": 0}

        def close() -> pa.RecordBatch:
            k = np.array([0 if x is None else x for x in keys], np.int64)
            missing = np.array([x is None for x in keys])
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (missing[1:] != missing[:-1])])
            copies = np.arange(len(k)) - np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            copies = np.where(missing, -1 - copies, copies).astype(np.int64)
            c = np.array(counts, np.int64)
            payload = np.frombuffer(b"".join(held), "<u4").astype(f"<u{width}").tobytes()
            index = PerfectHash.build(k.view(np.uint64), copies.view(np.uint64), np.cumsum(c) - c, c).to_bytes()
            least, most = (int(k[x]) if not missing[x] else -(2**63) for x in (0, -1))
            row = (part, state["shard"], state["before"], least, most, len(k), state["ids"], width, k.astype("<i8").tobytes(), copies.astype("<i4").tobytes(), index, payload)
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.int32(), *[pa.binary()] * 4]
            state["before"] += state["ids"]
            state["shard"] += 1
            state["ids"] = 0
            keys.clear()
            counts.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [f.split()[0] for f in SHARD.split(", ")])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), TEXTS):
                for key, raw in zip(ids[at : at + TEXTS], tok.encode(texts[at : at + TEXTS]), strict=True):
                    if keys and state["ids"] + len(raw) // 4 > SHARD_IDS:
                        yield close()
                    keys.append(key)
                    counts.append(len(raw) // 4)
                    held.append(raw)
                    state["ids"] += len(raw) // 4
        if keys:
            yield close()

    ordered.mapInArrow(run, SHARD).write.option("compression", "none").parquet(out)
    return out


def _ids(payload: bytes, width: int) -> np.ndarray:
    return np.frombuffer(payload, f"<u{width}").astype("<u4")


def _keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["copies"], "<i4").astype(np.int64)


def read_documents(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each fetched by its key.

    The index gives the place and number of the ids in the shard's payload; a key that it does
    not find, or whose fingerprint differs, is an error.  ``start`` adds the ids of earlier
    partitions (summed by partition: the driver sees one number for each) and shards.
    """
    shards = spark.read.schema(SHARD).parquet(store)
    base, bases = 0, {}
    for part, n in sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        bases[part] = base
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, copies = _keys(row)
                found, at, n = PerfectHash.from_bytes(row["index"]).find(keys.view(np.uint64), copies.view(np.uint64))
                if not found.all():
                    raise ValueError(f"shard {row['part']}/{row['shard']} lacks {int((~found).sum())} of its keys")
                raw = memoryview(_ids(row["payload"], row["width"]).tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + c)]) for s, c in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=copies < 0), pa.array(at + row["before"] + bases[row["part"]]), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "shard", "before", "width", "keys", "copies", "index", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, store: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids array<int>) of those of ``keys`` (a short list) that the store has: the first copy of each.

    The key ranges of the shards, a few bytes each, say where a key can be; only those shards are
    read.  In a shard a key costs a hash or two, its fingerprint, and its own ids.
    """
    wanted = np.array(sorted(set(keys)), np.int64)
    shards = spark.read.schema(SHARD).parquet(store)
    near = F.exists(F.lit(wanted.tolist()).cast("array<long>"), lambda k: k.between(F.col("first_key"), F.col("last_key")))
    at = [(r[0], r[1]) for r in shards.where(near).select("part", "shard").collect()] if len(wanted) else []
    own = shards.where(F.col("part").isin(sorted({p for p, _ in at})) & F.col("shard").isin(sorted({s for _, s in at})) & near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                here = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                found, start, n = PerfectHash.from_bytes(row["index"]).find(here.view(np.uint64), np.zeros(len(here), np.uint64))
                ids = np.frombuffer(row["payload"], f"<u{row['width']}")
                got = [(int(k), ids[s : s + c].tolist()) for k, s, c in zip(here[found], start[found], n[found], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return own.select("first_key", "last_key", "width", "index", "payload").mapInArrow(run, "doc_id long, ids array<int>").dropDuplicates(["doc_id"])


def write_and_read(docs: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`write_ids` to the shared folder, then :func:`read_documents`."""
    spark = docs.sparkSession
    return read_documents(spark, write_ids(docs, path, stage_path(spark, "ids"), end, id_col, text_col))
