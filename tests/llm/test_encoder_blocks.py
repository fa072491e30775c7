"""Blocks of texts have the library's ids, and the library gets all of a block's new words together."""

from __future__ import annotations

import random

import numpy as np
import pytest

from marketspan.llm.tokenization import CachedEncoder, cut_of, tokenizer_path

TOKENIZERS = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def ids(encoder: CachedEncoder, text: str) -> bytes:
    return np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", TOKENIZERS)
def test_new_words_of_a_block_are_made_together(name):
    class Counted:
        def __init__(self, library):
            self.library, self.uses = library, 0

        def __getattr__(self, what):
            self.uses += 1
            return getattr(self.library, what)

    path = tokenizer_path(name)
    encoder = CachedEncoder(path, cut_of(path))
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]
    texts = [" ".join(words), ", ".join(words) + ".", "\n".join(words), *(f"{w}-{w} {w}1" for w in words)]
    encoder.cache.library = counted = Counted(encoder.cache.library)
    assert encoder.encode(texts) == [ids(encoder, t) for t in texts]
    assert counted.uses <= 2
    assert encoder.encode(texts) == [ids(encoder, t) for t in texts]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_any_mixture_of_characters_has_the_librarys_ids(name):
    path, rng = tokenizer_path(name), random.Random(3)
    encoder = CachedEncoder(path, cut_of(path))
    units = [*"ab Bé's,.1-_", " ", " ", " ", "\n", "\n ", "\t", "\r", "\x01", "İ", "Ⱥ", "ª", "ǅ", "×", "<", "|", "<|endoftext|>", "’", "中", "\xa0", "'ll", "..."]
    texts = ["", " ", "\n", "\n\n", " x", "\nx", "x\n", "x\n ", "x\n y", "\n x", "'s", "\n's", "...", " ...", "x\t\ty ", "中"]
    texts += ["".join(rng.choices(units[: rng.choice([12, 16, 18, len(units)])], k=rng.randrange(12))) for _ in range(8000)]
    for begin in range(0, len(texts), 500):
        block = texts[begin : begin + 500]
        assert encoder.encode(block) == [ids(encoder, t) for t in block]
