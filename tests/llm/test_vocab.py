"""Words learned in blocks against the library, with letters that are not plain among them."""

from __future__ import annotations

import random
from array import array

import public_tokenizers
import pytest
from platefold.llm.vocab import ChunkTokenizer
from tokenizers import Tokenizer

LETTERS = ["abcdefgh", "ABCxyz", "éüñßøÉÜ", "αβγδΣΩς", "жщяЖЩЯ", "ȺȾİıǅſ", "語言的", "ﬁΐ́ŉ", "אבג", "ĀāŁłŐ"]


def texts(seed: int) -> list[str]:
    draw = random.Random(seed)
    words = ["".join(draw.choices(draw.choice(LETTERS) + draw.choice(LETTERS), k=draw.randint(1, 12))) for _ in range(3000)] + ["x" * 64, "Y" * 63, "é" * 200]
    ends = ["", "", "", ".", ",", "\n", "!", "-b"]
    return ["", " ", *(" ".join(w + draw.choice(ends) for w in draw.choices(words, k=draw.randint(1, 80))) for _ in range(300))]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_the_librarys(file, seed):
    path = public_tokenizers.path(file)
    lib, own = Tokenizer.from_file(path), ChunkTokenizer(path, 0)
    some = texts(seed)
    expected = [array("I", [*lib.encode(t, add_special_tokens=False).ids, 0]).tobytes() for t in some]
    assert own.encode(some) == expected
    assert own.encode(some[::-1]) == expected[::-1]  # all words known
