"""Texts to token ids by a tokenizers file, one white-space run and word at a time."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A run of white space with the word after it. Both kinds of file split there, whatever comes
#: before and after: none of their patterns has a character that is no space before one.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Characters that Python takes for white space and the files' patterns may not.
DOUBTFUL = re.compile("[\x1c-\x1f\x85\u180e]")
#: Texts of letters, white space and stops, none of them after a space or another one. Such a text
#: may be cut before each space, line end and stop.
LETTERS = r"A-Za-zÀ-ÖØ-öø-įı-ɏΑ-ΡΤ-ωА-џ"
NOT_SIMPLE = rf"[^{LETTERS} \n.,]|[ \n.,][.,]|[ \n][ \n]|^[.,]"
#: A space, a word of letters that no file's normaliser changes but for its case, and perhaps a stop.
PLAIN = re.compile(f"[ ]([{LETTERS}]+)([.,]?)")
PLAIN_LINE = re.compile(f"[ {LETTERS}]+")
#: Chunks remembered by a worker in each of two generations, and the longest of them; bounds its memory.
REMEMBERED, LONGEST = 300_000, 64
#: Put between chunks that are encoded in one call; a chunk that has it is encoded alone.
MARK = " \x02"


def _byte_chars() -> str:
    """The character that stands for each byte in byte-level files: itself if it can be printed, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


BYTE_CHARS = _byte_chars()


class Remembered:
    """What was found for chunks, in two generations; those not asked for in the newer one are forgotten."""

    def __init__(self, most: int = REMEMBERED):
        self.new: dict = {}
        self.old: dict = {}
        self.most = most

    def turn(self) -> None:
        """Begin another generation if this one is full."""
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are not known; the others are in ``new`` afterwards."""
        lost = keys.difference(self.new)
        unknown = lost.difference(self.old)
        old = self.old
        self.new.update((k, old[k]) for k in lost.difference(unknown))
        return unknown


class Cut:
    """Simple texts in chunks: the different ``words`` among them, and where each stands."""

    def __init__(self, texts: list[str]):
        column = pa.array([t.replace(" ", "\x01 ").replace(".", "\x01.").replace(",", "\x01,").replace("\n", "\x01\n") for t in texts], pa.string())
        lists = pc.split_pattern(column, "\x01")
        coded = lists.values.dictionary_encode()
        self.at, self.offsets = coded.indices, lists.offsets.to_numpy().tolist()
        self.words: list[str] = coded.dictionary.to_pylist()

    def take(self, values: list[bytes]):
        """For each text the joined ``values``, given by word."""
        placed = pa.array(values, pa.large_binary()).take(self.at)
        ends = np.frombuffer(placed.buffers()[1], np.int64, len(placed) + 1, 8 * placed.offset)
        raw = memoryview(placed.buffers()[2] or b"")
        return (bytes(raw[ends[a] : ends[b]]) for a, b in zip(self.offsets, self.offsets[1:], strict=False))

    def sums(self, values: np.ndarray) -> list[int]:
        """For each text the sum of its words' ``values``."""
        total = np.concatenate([[0], np.cumsum(values[self.at.to_numpy()])])
        return (total[self.offsets[1:]] - total[self.offsets[:-1]]).tolist()


def simple(texts: list[str]) -> list[bool]:
    """Which texts are simple: for these, see NOT_SIMPLE and Cut."""
    return pc.invert(pc.match_substring_regex(pa.array(texts, pa.string()), NOT_SIMPLE)).to_pylist()


class PlainWords:
    """The library's merging of words of letters, without its normalising and splitting of texts.

    ``lower``: words are put in lower case.  ``space``: a word's first symbol is the space
    before it.  A mark on the first or last id of a word tells a call's words apart.
    """

    def __init__(self, model: dict, lower: bool, space: bool, stops: dict[str, bytes]):
        from tokenizers import Tokenizer, models, pre_tokenizers

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix")
        self.lib = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **({"end_of_word_suffix": suffix} if suffix else {})))
        self.lib.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lower, self.space, self.stops = lower, space, stops
        self.edge = np.zeros(max(model["vocab"].values()) + 1, bool)
        for t, i in model["vocab"].items():
            self.edge[i] = t.startswith(BYTE_CHARS[32]) if space else t.endswith(suffix)
        self.table = {b: c for b, c in enumerate(BYTE_CHARS)}

    @classmethod
    def of(cls, path: str, lib) -> PlainWords | None:
        """For the two kinds of file that are known: bytes with a space before, and lower case with word ends."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before, norm = file["pre_tokenizer"] or {}, file["normalizer"] or {}
        stops = {c: array("I", lib.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,"} | {"": b""}
        suffix = file["model"].get("end_of_word_suffix")
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before["add_prefix_space"] and not norm and not suffix:
            return cls(file["model"], False, True, stops)
        if suffix and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return cls(file["model"], True, False, stops)
        return None

    def learn(self, chunks: set[str], seen: dict[str, bytes]) -> set[str]:
        """Put those of ``chunks`` that are plain into ``seen``; returns the others."""
        whole = [c for c in chunks if c[0] == " " and len(c) <= LONGEST and c[1:].isalpha()]
        whole.sort()  # scripts apart, so that few blocks have a letter that is not plain
        done = []
        for at in range(0, len(whole), 512):
            some = whole[at : at + 512]
            line = "".join(some)
            if self.lower:
                line = line.lower()
            if line.isascii() or PLAIN_LINE.fullmatch(line):
                line = line.encode().decode("latin-1").translate(self.table)
                seen.update(self._cut(some, line.replace(BYTE_CHARS[32], " " + BYTE_CHARS[32] if self.space else " ")[1:]))
                done += some
        words: dict[str, list[tuple[str, str]]] = {}
        rest = set()
        for c in chunks.difference(done):
            m = PLAIN.fullmatch(c) if len(c) <= LONGEST else None
            if m is None:
                rest.add(c)
            else:
                w, stop = m.groups()
                words.setdefault(w.lower() if self.lower else w, []).append((c, stop))
        keys = list(words)
        head = BYTE_CHARS[32] if self.space else ""
        for at in range(0, len(keys), 512):
            some = keys[at : at + 512]
            line = " ".join(head + (w if w.isascii() else w.encode().decode("latin-1").translate(self.table)) for w in some)
            for w, found in self._cut(some, line):
                for c, stop in words[w]:
                    seen[c] = found + self.stops[stop] if stop else found
        return rest

    def _cut(self, names: list[str], line: str) -> Iterator[tuple[str, bytes]]:
        """Each of ``names`` with the ids of its word; ``line`` has their words in order, a space between them."""
        ids = np.array(self.lib.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self.edge[ids])
        bounds = (4 * np.append(edges, len(ids)) if self.space else 4 * np.append(0, edges + 1)).tolist()
        raw = ids.tobytes()
        return zip(names, [raw[lo:hi] for lo, hi in zip(bounds, bounds[1:], strict=False)], strict=True)


class ChunkTokenizer:
    """Ids as the library gives them for the whole text, remembered by chunk.

    ``end`` is an id put after every text.  Ids come as little-endian unsigned 32-bit bytes.
    Texts with a doubtful character go to the library whole.
    """

    def __init__(self, path: str, end: int | None = None, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.end = b"" if end is None else array("I", [end]).tobytes()
        self.seen = Remembered(most)
        self.mark = self.lib.encode(MARK, add_special_tokens=False).ids
        self.plain = PlainWords.of(path, self.lib)

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that begin with white space, encoded in one call and cut at the mark."""
        ids = np.array(self.lib.encode_batch_fast([MARK.join(chunks) + MARK], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.mark[-1]) + 1
        raw, out, at = ids.astype("<u4").tobytes(), [], 0
        for end in (4 * ends).tolist():
            out.append(raw[at : end - 4 * len(self.mark)])
            at = end
        return out

    def _learn(self, chunks: set[str]) -> set[str]:
        """Make the ids of ``chunks`` known; returns those to forget again after this call."""
        unknown = self.seen.missing(chunks)
        seen = self.seen.new
        if self.plain:
            unknown = self.plain.learn(unknown, seen)
        joined = [c for c in unknown if c[0] in " \n" and len(c) <= LONGEST and "\x02" not in c and c[-1] not in " \n"]
        for i in range(0, len(joined), 512):
            seen.update(zip(joined[i : i + 512], self._together(joined[i : i + 512]), strict=True))
        single = list(unknown.difference(joined))
        for i in range(0, len(single), 512):
            seen.update(zip(single[i : i + 512], self._alone(single[i : i + 512]), strict=True))
        return {c for c in single if len(c) > LONGEST}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        self.seen.turn()
        easy = simple(texts)
        lower = self.plain is not None and self.plain.lower
        cut = Cut([t.lower() if lower else t for t, e in zip(texts, easy, strict=True) if e])
        parts = [None if e else [] if DOUBTFUL.search(t) else CHUNK.findall(t) for t, e in zip(texts, easy, strict=True)]
        long = self._learn(set(cut.words).union(*filter(None, parts)) - {""})
        seen = self.seen.new
        placed = cut.take([seen[c] if c else b"" for c in cut.words])
        out = []
        for t, p in zip(texts, parts, strict=True):
            out.append((next(placed) if p is None else b"".join(map(seen.__getitem__, p)) if p else self._alone([t])[0]) + self.end)
        for c in long:
            del seen[c]
        return out


_open: dict[tuple, ChunkTokenizer] = {}


def chunk_tokenizer(path: str, end: int | None = None, most: int = REMEMBERED) -> ChunkTokenizer:
    """The worker's tokenizer for a file, opened once; ``most``: chunks remembered in each generation."""
    if (path, end) not in _open:
        _open[path, end] = ChunkTokenizer(path, end, most)
    return _open[path, end]
