"""Ranked search over bit-sliced impacts, exact.

A term's impact on a document is a whole number.  In a shard of documents its impacts are bitmaps:
slice b has the b-th bit of every document's impact.  A query's scores are the sum of its terms'
impacts, made for all documents of the shard at once by bitwise addition with carries, and many
queries at once.  The top k are found from the most significant slice down: documents that have
the bit go ahead of those that have not, until k are told apart.

What is stored are the shards' postings, in Parquet: impacts depend on counts over all documents,
and slices are cut from the postings of the terms that a block of queries asks for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Documents and postings of a shard; queries that are added up together; and terms of queries that are broadcast at a time.
SHARD_DOCS, SHARD_POSTINGS, TOGETHER, TERMS_AT_ONCE = 1 << 14, 1 << 21, 64, 1_000_000
#: Bytes of slices that a task remembers.
REMEMBERED = 64 << 20
SHARD = "n_docs long, n_words long, ids binary, known binary, lengths binary, terms array<binary>, df array<int>, docs binary, tf binary"
RESULT = "item_id long, doc_id long, score long"
#: Bytes that end a term become blanks, A-Z lower-case letters; bytes from 128 belong to terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ONE = np.uint64(1)


def words(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(LETTERS).split()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged shards over all rows and all terms of whole texts; a task makes its own, without a shuffle.

    Rows without a term are in no shard; rows without an id count, but are never found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[int] = []
        sizes: list[int] = []
        places: dict[bytes, int] = {}
        term: list[int] = []
        tf: list[int] = []

        def close() -> pa.RecordBatch:
            at = np.array(term, np.int64)
            order = np.argsort(at, kind="stable")
            doc = np.repeat(np.arange(len(ids), dtype="<u4"), sizes)[order]
            df = np.bincount(at, minlength=len(places)).astype(np.int32)
            known = np.array([x is not None for x in ids], np.uint8)
            raw = (np.array([0 if x is None else x for x in ids], "<i8"), known, np.array(lengths, "<i8"))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), x) for x in (pa.array(list(places), pa.binary()), pa.array(df))]
            out = [pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in raw), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in (doc, np.array(tf, "<u4")[order]))]
            for x in (ids, lengths, sizes, places, term, tf):
                x.clear()
            return pa.RecordBatch.from_arrays(out, [f.split()[0] for f in SHARD.split(", ")])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                counts = Counter(words(t or b""))
                if not counts:
                    continue
                if ids and (len(ids) == SHARD_DOCS or len(term) + len(counts) > SHARD_POSTINGS):
                    yield close()
                ids.append(d)
                lengths.append(counts.total())
                sizes.append(len(counts))
                term.extend([places.setdefault(w, len(places)) for w in counts])
                tf.extend(counts.values())
        if ids:
            yield close()

    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return stage(rows.mapInArrow(run, SHARD), "slices")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, c): the terms of each item and how often it has them. Items without an id are left out; of different texts of one id the least counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, w, c) for d, t in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True) for w, c in Counter(words(t or b"")).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item_id", "term", "c"])

    one = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).dropna(subset=["item_id"]).groupBy("item_id").agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "item_id long, term binary, c long")


class Slices:
    """One shard's impacts as bitmaps over its documents."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.ids, self.known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], np.uint8).astype(bool)
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.m = 100 - 25 + (25 * lengths * n_docs) // n_words
        self.docs, self.tf = np.frombuffer(row["docs"], "<u4"), np.frombuffer(row["tf"], "<u4")
        self.starts = np.concatenate([[0], np.cumsum(row["df"], dtype=np.int64)])
        self.words = -(-len(self.ids) // 64)
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.room = REMEMBERED

    def of(self, term: int, weight: int) -> np.ndarray:
        """(bits, words): ``weight`` times the term's impact on each document, the least significant bit first."""
        if (found := self.held.get((term, weight))) is not None:
            return found
        lo, hi = self.starts[term], self.starts[term + 1]
        docs, tf = self.docs[lo:hi].astype(np.int64), self.tf[lo:hi].astype(np.int64)
        impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * self.m[docs]))
        bits = int(impact.max()).bit_length()
        word = docs >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        single = (impact.astype(np.uint64)[None, :] >> np.arange(bits, dtype=np.uint64)[:, None] & ONE) << (docs & 63).astype(np.uint64)
        out = np.zeros((bits, self.words), np.uint64)
        if bits:
            out[:, word[first]] = np.bitwise_or.reduceat(single, first, axis=1)
        if out.nbytes > self.room:
            self.held, self.room = {}, REMEMBERED
        self.held[term, weight] = out
        self.room -= out.nbytes
        return out

    def sums(self, queries: list[list[tuple[int, int]]], bits: int) -> np.ndarray:
        """(bits, queries, words): the slices of every query's scores; a query is (term, weight) pairs."""
        total = np.zeros((bits, len(queries), self.words), np.uint64)
        for step in range(max(map(len, queries))):
            own = [(q, self.of(*x[step])) for q, x in enumerate(queries) if step < len(x)]
            high = max(s.shape[0] for _, s in own)
            added = np.zeros((high, len(queries), self.words), np.uint64)
            for q, s in own:
                added[: s.shape[0], q] = s
            carry = np.zeros(total.shape[1:], np.uint64)
            for b in range(bits):
                if b >= high:
                    if not carry.any():
                        break
                    total[b], carry = total[b] ^ carry, total[b] & carry
                    continue
                half = total[b] ^ added[b]
                carry, total[b] = (total[b] & added[b]) | (half & carry), half ^ carry
        return total

    def top(self, score: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, -id) of one query's slices (bits, words), scores above 0 only, ties to the lesser id."""
        ahead = np.zeros(self.words, np.uint64)
        level = np.bitwise_or.reduce(score, axis=0) & np.packbits(np.pad(self.known, (0, 64 * self.words - len(self.known))), bitorder="little").view("<u8")
        count = lambda x: int(np.bitwise_count(x).sum())
        for b in range(len(score) - 1, -1, -1):
            both = level & score[b]
            n = count(ahead | both)
            if n > k:
                level = both
            else:
                ahead, level = ahead | both, level & ~score[b]
                if n == k:
                    break
        where = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        best, equal = where(ahead), where(level)
        if len(best) < k:
            best = np.concatenate([best, equal[np.lexsort((equal, self.ids[equal]))[: k - len(best)]]])
        place = (score[:, best >> 6] >> (best & 63).astype(np.uint64) & ONE).astype(np.int64)
        values = (place << np.arange(len(score))[:, None]).sum(axis=0)
        return list(zip(values.tolist(), (-self.ids[best]).tolist(), strict=True))


def _frequencies(shared):
    """(t, n): documents of a shard that hold the asked term with number t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shared.value, pa.binary())
        for b in batches:
            for k in range(b.num_rows):
                at = pc.index_in(asked, value_set=b.column(0)[k].values)
                held = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                df = np.asarray(b.column(1)[k].values)[at.drop_null().to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df, pa.int64())], ["t", "n"])

    return run


def _evaluate(shared, n_docs: int, n_words: int, k: int):
    """The k best of each item over a task's own shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, items, bounds, term, c = shared.value
        asked = pa.array(terms, pa.binary())
        best: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for r in range(b.num_rows):  # one at a time: a shard is large
                row = {f: b.column(f)[r] for f in b.schema.names}
                at = pc.fill_null(pc.index_in(asked, value_set=row.pop("terms").values), -1).to_numpy()
                shard = Slices({f: np.asarray(x.values) if f == "df" else x.as_py() for f, x in row.items()}, n_docs, n_words)
                queries = []
                for i in range(len(items)):
                    own = slice(bounds[i], bounds[i + 1])
                    queries.append((i, [(int(at[t]), int(weights[t] * n)) for t, n in zip(term[own].tolist(), c[own].tolist(), strict=True) if at[t] >= 0 and weights[t] > 0]))
                queries = [x for x in queries if x[1]]
                queries.sort(key=lambda x: len(x[1]))  # queries of like length together
                for lo in range(0, len(queries), TOGETHER):
                    some = queries[lo : lo + TOGETHER]
                    # an impact is less than a million
                    high = max(sum(w for _, w in q) for _, q in some) * 1_000_000
                    total = shard.sums([q for _, q in some], high.bit_length())
                    for j, (i, _) in enumerate(some):
                        best[i] = sorted(best.get(i, []) + shard.top(np.ascontiguousarray(total[:, j]), k), reverse=True)[:k]
        out = [(int(items[i]), -minus, score) for i, found in best.items() for score, minus in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the index that score highest for each item.

    Counts are over all documents.  Equal scores go by ascending doc_id; scores of 0 are no
    results.  An item without a text or a term finds nothing.  Rows repeated with one id are found
    each for itself.  Items go to the shards in blocks of a million different terms of items at most (a longer
    item is a block of its own); only these, their weights and their counts are broadcast.
    """
    spark = index.sparkSession
    n_docs, n_words = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_words")).first())
    asked = stage(item_terms(items, id_col, text_col), "asked")
    rounds = max(1, -(-asked.count() // TERMS_AT_ONCE))
    out = spark.createDataFrame([], RESULT)
    for turn in range(rounds if n_words else 0):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == turn).toArrow()
        if not own.num_rows:
            continue
        item, c = own.column("item_id").to_numpy(), own.column("c").to_numpy()
        coded = own.column("term").combine_chunks().dictionary_encode()
        terms, term = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        order = np.lexsort((term, item))
        found, first = np.unique(item[order], return_index=True)
        shared = spark.sparkContext.broadcast(terms)
        counted = index.select("terms", "df").mapInArrow(_frequencies(shared), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
        shared.unpersist()
        weights = np.zeros(len(terms), np.int64)
        for t, n in counted:
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        held = spark.sparkContext.broadcast((terms, weights, found, np.append(first, len(item)), term[order], c[order]))
        out = out.unionByName(stage(index.mapInArrow(_evaluate(held, n_docs, n_words, k), RESULT), "found"))
        held.destroy()
    ranked = out.withColumn("rank", F.expr("row_number() over (partition by item_id order by score desc, doc_id)"))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
