"""Packing of tokenised documents into windows by non-negative least squares.

Documents are cut at the window's length; the pieces' lengths form a histogram, which is all
that the solver sees.  Combinations of one to three lengths that fill a window exactly are
enumerated, repeat counts are solved so that their sum comes near the histogram, rounded, and
the pieces that are left are packed greedily.  The plan maps (length, rank among the pieces of
that length) to a sequence and a place in it, so assigning is one narrow pass.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stage
from .vocab import chunk_tokenizer

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
#: Pieces of one length that are ranked in one task.
RANKED = 50_000
#: Texts encoded at a time.
TEXTS = 1000


def pieces(docs: DataFrame, path: str, window: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids by the tokenizers file ``path``, then ``end``, cut every ``window`` ids.

    A null or empty text is the end id alone.  ``ids`` (little-endian, 32 bits) is null unless
    asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(path, end)
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), TEXTS):
                rows: list[tuple] = []
                for d, raw in zip(doc_ids[at : at + TEXTS], tok.encode(texts[at : at + TEXTS]), strict=True):
                    n = len(raw) // 4
                    for s in range(0, n, window):
                        piece = raw[4 * s : 4 * (s + window)]
                        rows.append((d, s, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([*[pa.int64()] * 5, pa.binary()])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, PIECE)


@dataclass
class Plan:
    """Sequences in groups of alike ones: the lengths in each, how many, and the first one's id."""

    lengths: list[tuple[int, ...]]
    repeats: list[int]

    def places(self) -> dict[int, np.ndarray]:
        """For each length, rows (first rank, first sequence id, offset, tokens in the sequence) by rank."""
        out: dict[int, list] = {}
        taken: Counter = Counter()
        sequence = 0
        for lengths, r in zip(self.lengths, self.repeats, strict=True):
            offset = 0
            for n in lengths:
                out.setdefault(n, []).append((taken[n], sequence, offset, sum(lengths)))
                taken[n] += r
                offset += n
            sequence += r
        return {n: np.array(rows, np.int64) for n, rows in out.items()}


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of one to three of ``lengths``, largest first, padded with zero, whose sum is ``window``."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = window - a - b
    ok = (c >= 0) & (c <= b)
    a, b, c = a[ok], b[ok], c[ok]
    ok = (c == 0) | have[c]
    rows = np.stack([a[ok], b[ok], c[ok]], 1)
    return np.concatenate([rows, [[window, 0, 0]]]) if have[window] else rows


def nonnegative_least_squares(columns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings sum(x * columns) near ``histogram``, by accelerated projected gradients.

    ``columns`` lists the lengths that each combination holds (0: none).
    """
    size = len(histogram)
    h = histogram.astype(float)
    h[0] = 0
    scale = max(h.max(), 1.0)

    def apply(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(columns[:, k], x, size) for k in range(columns.shape[1]))
        out[0] = 0
        return out

    v = np.ones(len(columns))
    for _ in range(12):  # the largest eigenvalue, for the step
        w = apply(v)[columns].sum(1)
        top = np.linalg.norm(w)
        v = w / top
    step = 1 / (1.05 * top)
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        r = apply(y) - h / scale
        new = np.maximum(0, y - step * r[columns].sum(1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def solve(histogram: dict[int, int], window: int = 1024) -> Plan:
    """A plan that places every piece of ``histogram`` (length: how many) in windows."""
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    plan = Plan([], [])

    def place(lengths: tuple[int, ...], r: int) -> None:
        for n in lengths:
            left[n] -= r
        plan.lengths.append(lengths)
        plan.repeats.append(int(r))

    if left[window]:
        place((window,), left[window])
    present = np.flatnonzero(left)
    if len(present):
        columns = combinations(present, window)
        if len(columns):
            x = nonnegative_least_squares(columns, left)
            for i in np.argsort(-x, kind="stable"):
                if x[i] < 0.5:
                    break
                lengths = tuple(int(n) for n in columns[i] if n)
                r = min(int(x[i] + 0.5), *(int(left[n]) // k for n, k in Counter(lengths).items()))
                if r > 0:
                    place(lengths, r)
    while (present := np.flatnonzero(left)).size:  # greedily: the longest, then the longest that still fits
        lengths, used, free = [], Counter(), window
        while free > 0:
            fit = present[(present <= free)]
            fit = fit[left[fit] > np.fromiter((used[n] for n in fit.tolist()), np.int64, len(fit))]
            if not len(fit):
                break
            n = int(fit[-1])
            lengths.append(n)
            used[n] += 1
            free -= n
        place(tuple(lengths), min(int(left[n]) // k for n, k in used.items()))
    return plan


def pack(docs: DataFrame, path: str, window: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset, sequence_tokens, padded_to).

    One row for each piece: ``start`` is the number of the document's ids before it, ``offset``
    its place in sequence ``sequence_id``, which holds ``sequence_tokens`` ids and is padded to
    ``window``, or not at all where that is a power of two.  Sequence ids count from 0.  Each
    id of each row of ``docs`` lies in exactly one piece, also of repeated rows and of rows
    without an id; an empty table gives an empty result.  The driver sees the histogram only:
    ``window`` numbers.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, window, end, id_col, text_col, with_ids).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    sizes = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    places = solve(sizes, window).places()
    parts = max(1, ceil(max(sizes.values(), default=1) / RANKED))
    # a rank among all pieces of a length, without bringing a frequent length into one task
    salted = cut.withColumn("part", F.pmod("rid", F.lit(parts)))
    before = salted.groupBy("length", "part").count().selectExpr("length", "part", "sum(count) over (partition by length order by part rows between unbounded preceding and current row) - count before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, part order by rid) - 1 place").join(before, ["length", "part"]).selectExpr(*[c for c in cut.columns if c != "rid"], "place + before rank")
    shared = spark.sparkContext.broadcast(places)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            out = np.zeros((len(length), 3), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                table = shared.value[int(n)]
                k = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                out[rows, 0] = table[k, 1] + rank[rows] - table[k, 0]
                out[rows, 1] = table[k, 2]
                out[rows, 2] = table[k, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *(pa.array(out[:, k]) for k in range(3))], [*names, "sequence_id", "offset", "sequence_tokens"])

    placed = ranked.mapInArrow(run, PIECE + ", sequence_id long, offset long, sequence_tokens long")
    return placed.withColumn("padded_to", F.expr(f"case when bit_count(sequence_tokens) = 1 then sequence_tokens else {window}L end"))
