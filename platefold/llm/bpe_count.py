"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .vocab import CHUNK, DOUBTFUL, LONGEST, Cut, Remembered, simple

#: Texts cut up at a time.
TEXTS = 1000
OUT = "doc_id long, n_bytes long, n_tokens long"


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after repeatedly merging the adjacent pair of lowest rank, the first of equals.

    The symbols are a doubly linked list and the pairs a heap, so n symbols cost n log n.
    An entry of the heap is stale if either symbol has changed since.
    """
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    left = n
    text: list[str | None] = list(symbols)
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if text[i] != a or j >= n or text[j] != b:
            continue
        text[i], text[j] = a + b, None
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((text[i], text[k]))) is not None:
                heappush(heap, (r, i, text[i], text[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
            heappush(heap, (r, h, text[h], text[i]))
    return left


class TokenCounter:
    """Counts for one byte-level BPE file of the tokenizers library.

    The file's own pre-tokenizer splits a chunk; the merging is done here.  Its special strings
    count as one token each, as the library's default has it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in model["added_tokens"]]
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.seen, self.words = Remembered(), Remembered()

    def _word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = merged_count(list(word), self.ranks)
            if len(word) <= LONGEST:
                self.words.new[word] = found
        return found

    def _merge(self, chunk: str) -> int:
        return sum(self._word(w) for w, _ in self.split(chunk))

    def _chunk(self, chunk: str) -> int:
        found = self.seen.get(chunk)
        if found is None:
            found = self._merge(chunk)
            if len(chunk) <= LONGEST:
                self.seen.new[chunk] = found
        return found

    def _chunks(self, text: str) -> int:
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [p for x in parts for p in x.split(s)]
        return len(parts) - 1 + sum(self._merge(p) if DOUBTFUL.search(p) else sum(map(self._chunk, CHUNK.findall(p))) for p in parts)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        self.seen.turn()
        self.words.turn()
        easy = simple(texts)
        cut = Cut([t for t, e in zip(texts, easy, strict=True) if e])
        sums = iter(cut.sums(np.fromiter(map(self._chunk, cut.words), np.int64, len(cut.words))))
        return [next(sums) if e else self._chunks(t) for t, e in zip(texts, easy, strict=True)]


_open: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    if path not in _open:
        _open[path] = TokenCounter(path)
    return _open[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text, in one pass without a shuffle.

    n_bytes is the length in UTF-8.  Null and empty texts have 0 of both; repeated rows and
    null ids are counted like any others.  Memory per worker is bounded by the chunks that it
    remembers and one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                texts = some.column(1).to_pylist()
                columns = [some.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return documents(docs, id_col, text_col).mapInArrow(run, OUT)
