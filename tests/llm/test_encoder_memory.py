"""What an encoder remembers, and that pieces it learns past the library's splits have the library's ids."""

from __future__ import annotations

import numpy as np
import pytest

from marketspan.llm import tokenization
from marketspan.llm.tokenization import CachedEncoder, cut_of, tokenizer_path


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_have_the_librarys_ids_in_bounded_memory(name, monkeypatch):
    letters = [chr(c) for c in range(0x21, 0x250) if c < 0x7F or c > 0xA0]
    texts = [f"x {c} a{c} {c}a a{c}. word{c}%%% it{c}s\n{c}b\nend{c}," for c in letters] + ["it's x's 's a.'s ...a ,b they'll'", "\nx", "x\n", "A's.' b"]
    monkeypatch.setattr(tokenization, "CACHE_PIECES", 100)
    path = tokenizer_path(name)
    encoder = CachedEncoder(path, cut_of(path))
    for text in texts:
        assert encoder.encode([text]) == [np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert 0 < len(encoder.cache) <= 50 and len(encoder.cache.older) <= 50
    encoder.forget()
    assert not encoder.cache and not encoder.cache.older
