"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A token sequence is what merging gives exactly if every two adjacent tokens are compatible:
merging the characters of both gives them back.  So the encoder takes the longest matching
piece, checks it against the token before, tries shorter pieces, and goes back a token where
none fits, remembering in a bit field the positions from which nothing could be continued.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents
from .vocab import LONGEST, Remembered

SPACE = "▁"
NO_PIECE = (float("inf"), 0)
#: Words remembered in each of two generations, and pairs of tokens.
WORDS, PAIRS = 400_000, 1_500_000
#: Texts encoded at a time.
TEXTS = 1000
OUT = "doc_id long, ids array<int>, decoded string"


class BacktrackingEncoder:
    """Ids of a BPE model of the sentencepiece library with an identity normaliser, a dummy
    prefix and byte fallback (checked when it is opened)."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode(" a ﬁ", out_type=str) != sp.encode(" a ﬁ".replace(" ", SPACE), out_type=str):
            raise ValueError("the model's normaliser is not the identity")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.rank = {p: (-sp.get_score(i), i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.eos = sp.eos_id()
        #: Neighbours that some piece holds; no token spans any others, so a text may be cut between them.
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.words = not any(j[0] != SPACE and j[1] == SPACE for j in self.joined)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.words else re.compile(r"[\s\S]+")
        trie = ahocorasick.Automaton()
        for p, i in self.id.items():
            trie.add_word(p, (i, len(p)))
        trie.make_automaton()
        self.trie = trie
        self.after: defaultdict[int | None, dict[int, bool]] = defaultdict(dict)
        self.checked = 0
        self.alone: dict[int, bool] = {}
        self.characters = {p for p in self.id if len(p) == 1}
        if not self.characters.issuperset("".join(self.id)):
            raise ValueError("a piece has a character that is no piece")
        self.seen = Remembered(WORDS)

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-ranked adjacent pair, the first of equals, again and again."""
        s, rank = list(text), self.rank.get
        ranks = [rank(a + b, NO_PIECE) for a, b in zip(s, s[1:], strict=False)]
        while ranks and (best := min(ranks)) is not NO_PIECE:
            i = ranks.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(s[i - 1] + s[i], NO_PIECE)
            if i < len(ranks):
                ranks[i] = rank(s[i] + s[i + 1], NO_PIECE)
        return s

    def fits(self, left: int | None, right: int) -> bool:
        """Whether ``right`` can be a token, and stand after ``left``; remembered in ``after``."""
        ok = self.alone.get(right)
        if ok is None:
            ok = self.alone[right] = self.merge(self.piece[right]) == [self.piece[right]]
        if ok and left is not None:
            a, b = self.piece[left], self.piece[right]
            ok = self.merge(a + b) == [a, b]
        self.after[left][right] = ok
        self.checked += 1
        return ok

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        size = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in text]  # pieces from a position: (end, id), shortest first
        for last, (i, n) in self.trie.iter(text):
            starts[last - n + 1].append((last + 1, i))
        if self.checked > PAIRS:
            self.after.clear()
            self.checked = 0
        failed = bytearray(size + 1)
        after, fits = self.after, self.fits
        out: list[tuple[int, int, int]] = []  # position, which of starts[position], id
        at, left = 0, None
        options = starts[0]
        k = len(options)
        while True:
            may = after[left]
            for k in range(k - 1, -1, -1):
                end, i = options[k]
                if failed[end]:
                    continue
                ok = may.get(i)
                if ok or ok is None and fits(left, i):
                    break
            else:  # nothing can be continued from here after any token that may stand before
                failed[at] = 1
                if not out:
                    raise AssertionError("no token sequence of this model gives the text")
                at, k, _ = out.pop()
                left = out[-1][2] if out else None
                options = starts[at]
                continue
            out.append((at, k, i))
            if end == size:
                return [i for _, _, i in out]
            at, left = end, i
            options = starts[at]
            k = len(options)

    def _parts(self, chunk: str) -> list[str]:
        """The chunk cut where no piece has both neighbours."""
        joined, at, out = self.joined, 0, []
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in joined:
                out.append(chunk[at:i])
                at = i
        out.append(chunk[at:])
        return out

    def _chunk(self, chunk: str, whole: bool = False) -> tuple[list[int], str]:
        """Ids of a chunk, and the same in decimal, each followed by a space; ``whole``: it is not to be cut."""
        found = self.seen.get(chunk)
        if found is not None:
            return found
        parts = [chunk] if whole else self._parts(chunk)
        if len(parts) > 1:
            several = [self._chunk(p, True) for p in parts]
            found = [i for f in several for i in f[0]], "".join(f[1] for f in several)
        else:
            # a character that is no piece takes part in no merge
            ids = self._known(chunk) if self.characters.issuperset(chunk) else [self.byte[b] for b in chunk.encode()]
            found = ids, "".join(f"{i} " for i in ids)
        if len(chunk) <= LONGEST:
            self.seen.new[chunk] = found
        return found

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids with the end id, and the same in decimal, joined by spaces."""
        self.seen.turn()
        parts = [self._chunk(c) for c in self.chunk.findall(SPACE + text.replace(" ", SPACE))] if text else []
        ids = [i for p in parts for i in p[0]]
        ids.append(self.eos)
        return ids, "".join(p[1] for p in parts) + str(self.eos)

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """:meth:`encode` of each text; where every chunk is a word after one space, each different word is looked up once."""
        self.seen.turn()
        easy = [self.words and bool(t) and t[0] != " " and "  " not in t and SPACE not in t for t in texts]
        lists = pc.split_pattern(pa.array([t for t, e in zip(texts, easy, strict=True) if e], pa.string()), " ")
        coded = lists.values.dictionary_encode()
        found = [self._chunk(SPACE + w) for w in coded.dictionary.to_pylist()]
        ids = pa.array([f[0] for f in found], pa.large_list(pa.int32())).take(coded.indices)
        decimal = pa.array([f[1] for f in found], pa.large_string()).take(coded.indices)
        bounds = lists.offsets.to_numpy()
        id_at, text_at = ids.offsets.to_numpy()[bounds].tolist(), np.frombuffer(decimal.buffers()[1], np.int64, len(decimal) + 1)[bounds].tolist()
        flat, raw = ids.values.to_numpy(), memoryview(decimal.buffers()[2] or b"")
        out, k, eos = [], 0, [self.eos]
        for t, e in zip(texts, easy, strict=True):
            if e:
                out.append((flat[id_at[k] : id_at[k + 1]].tolist() + eos, str(raw[text_at[k] : text_at[k + 1]], "ascii") + str(self.eos)))
                k += 1
            else:
                out.append(self.encode(t))
        return out


_open: dict[str, BacktrackingEncoder] = {}


def encoder(path: str) -> BacktrackingEncoder:
    if path not in _open:
        _open[path] = BacktrackingEncoder(path)
    return _open[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text: its ids with the end id, and the text that the
    library's decode gives for them.

    Null and empty texts have the end id alone and decode to the empty text.  Characters that
    are no piece become byte pieces.  One pass without a shuffle; repeated rows and null ids
    are encoded like any others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                ids = [i for i, _ in e.encode_all(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(e.lib.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return documents(docs, id_col, text_col).mapInArrow(run, OUT)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): :func:`encode_decode` without carrying ids and texts on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                rows = e.encode_all(some.column(1).to_pylist())
                columns = [pa.array([len(i) for i, _ in rows], pa.int64()), pa.array([_sha(d) for _, d in rows], pa.string()), pa.array([_sha(e.lib.decode(i)) for i, _ in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
