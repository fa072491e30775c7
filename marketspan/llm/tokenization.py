"""Exact, cached encoding with the public tokenizer files.

A text is cut at places where the tokenizer always starts a new pre-token, and
each distinct piece is looked up once in a block of texts.  Words that a Python
worker doesn't remember are encoded together.  Texts for which those
places aren't certain (unusual characters, runs of white space, special
strings) go to the library whole, so ids always equal the library's.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that one worker remembers: a newer half, and the half before it, from which words that come again are taken over.
CACHE_PIECES = 600_000
#: Characters of the texts that an encoder best gets at once: each of their distinct pieces is looked up once.
ENCODED_CHARS = 4_000_000
#: Printable ASCII, line breaks and Latin letters: classes on which all regex engines agree.
_UNUSUAL = re.compile("[^\n\x20-\x7e\xa1-ɏ]")
_UNUSUAL_SPACED = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_SPECIAL = "<|"
#: Stands before pieces that have no space before them in a text that is cut at spaces: its first one, and those after line breaks.
_FIRST = "\x01"
_BREAK = f" \n {_FIRST}"
#: Splits after which a run of letters is one pre-token, and the marks after it another.
_LETTER_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The letters of usual characters and of their lower case, and the sign before unspaced pieces.
_LETTERS = _FIRST + "".join(sorted({c for x in range(0x41, 0x250) for c in chr(x) + chr(x).lower() if c.isalpha()}))
#: Pre-tokens that the library's model gets in one call.
_TOGETHER = 1000
_WORKER: dict = {}


def _byte_level() -> str:
    """How byte-level tokenizers write each byte; a tab stays, as it lies between pre-tokens."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    written = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in kept)} | {9: "\t"}
    return "".join(written.get(b, chr(b)) for b in range(256))


_BYTE_LEVEL = _byte_level()


def tokenizer_path(name_or_path: str) -> str:
    """A public tokenizer's file by its name, or the path itself."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def load_tokenizer(path: str, specials_as_text: bool = False):
    """The library's tokenizer, loaded once per worker."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    key = ("tokenizer", path, specials_as_text)
    if key not in _WORKER:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = specials_as_text
        _WORKER[key] = tokenizer
    return _WORKER[key]


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _end_to_end(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each of the runs has."""
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _taken(ids: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The named ones of the runs that lie end to end in ``ids``, in the order given."""
    last, n = np.cumsum(sizes), sizes[runs]
    where = np.repeat(last[runs] - np.cumsum(n), n)
    where += np.arange(len(where))
    return ids[where]


class _Pieces(dict):
    """Ids of words; those that are asked for and not remembered are made by the library, all at once."""

    def __init__(self, path: str, cut: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = load_tokenizer(path, False)
        self.older: dict[str, bytes] = {}
        self.spaced = cut == "space"
        self.letter_splits = splits_at_letters(path)
        self.marks: dict[str, bytes] = {}
        # the library's model behind no splits but ours
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = np.zeros(self.library.get_vocab_size(), np.int64)
        suffix = self.library.model.end_of_word_suffix or ""
        for token, k in self.library.get_vocab().items():
            self.letters[k] = len(token.removesuffix(suffix))

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has.

        Letters and the marks after them surely are one pre-token and another;
        other pieces are words as they are.
        """
        if not self.letter_splits:
            return _end_to_end(self.of_words(_strings(pieces)))
        rest, words = pc.utf8_ltrim(pieces, _LETTERS), pc.utf8_rtrim(pieces, string.punctuation)
        plain = pc.and_(pc.equal(pc.utf8_rtrim(rest, string.punctuation), ""), pc.not_equal(words, ""))
        words = pc.if_else(plain, words, pieces).dictionary_encode()
        marks = pc.if_else(plain, rest, "").dictionary_encode()
        known = self.of_words(_strings(words.dictionary))
        ids, sizes = _end_to_end(known + [self._mark(mark) for mark in _strings(marks.dictionary)])
        both = np.column_stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(known)]).ravel()
        return _taken(ids, sizes, both), sizes[both].reshape(-1, 2).sum(1)

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, which are remembered: what lies in the older half is taken over into the newer one."""
        found = [*map(self.get, words)]
        missing = [n for n, ids in enumerate(found) if ids is None]
        asked = [words[n] for n in missing]
        made = [*map(self.older.get, asked)]
        new = [n for n, ids in enumerate(made) if ids is None]
        for n, ids in zip(new, self._made([asked[n] for n in new])):
            made[n] = ids
        for n, ids in zip(missing, made):
            found[n] = ids
        half, at = CACHE_PIECES // 2, 0
        while at < len(asked):
            if len(self) >= half:
                self.older = dict(self)
                self.clear()
            to = at + half - len(self)
            self.update(zip(asked[at:to], made[at:to]))
            at = to
        return found

    def _made(self, words: list[str]) -> list[bytes]:
        """The library's model takes letters past its splits; other words go through them."""
        written = [word[1:] if word[:1] == _FIRST else word if word == "\n" else " " + word for word in words] if self.spaced else words
        out: list[bytes] = [b""] * len(words)
        one = [n for n, word in enumerate(words) if word.lstrip(_FIRST).isalpha()] if self.letter_splits else []
        for n, ids in zip(one, self._pre_tokens([written[n] for n in one])):
            out[n] = ids
        others = sorted({*range(len(words))}.difference(one)) if len(one) < len(words) else []
        for n, found in zip(others, self.library.encode_batch_fast([written[n] for n in others], add_special_tokens=False)):
            out[n] = np.array(found.ids, "<u4").tobytes()
        return out

    def _pre_tokens(self, texts: list[str]) -> list[bytes]:
        """The model's ids of texts that are a pre-token each."""
        out: list[bytes] = []
        for k in range(0, len(texts), _TOGETHER):
            joined = codecs.charmap_decode("\t".join(texts[k : k + _TOGETHER]).encode(), "strict", _BYTE_LEVEL)[0]
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            # tokens have their pre-token's letters, so a pre-token ends where as many letters do
            written = joined.split("\t")
            ends, last = np.cumsum(self.letters[ids]), np.cumsum([*map(len, written)])
            at = np.searchsorted(ends, last)
            if len(ids) and at[-1] + 1 == len(ids) and (ends[at] == last).all():
                raw, cuts = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            else:  # a vocabulary without some bytes, which the model leaves out
                out += [np.array([t.id for t in self.library.model.tokenize(x)], "<u4").tobytes() for x in written]
        return out

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._pre_tokens([mark])[0] if mark else b""
        return self.marks[mark]


class CachedEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    cut "whole": any tokenizer, texts are encoded whole.
    cut "space": byte-level BPE, where a space before a visible character or a
    lone line break starts a pre-token.  cut "white": tokenizers that drop white
    space and fold case.
    """

    #: The special string that the files of both kinds must have, which no piece holds.
    JOINER = "<|endoftext|>"

    def __init__(self, path: str, cut: str, specials_as_text: bool = False):
        self.cut = cut
        self.library = load_tokenizer(path, specials_as_text)
        self.cache = _Pieces(path, cut) if cut != "whole" else {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Frees the memory at a task's end: a worker that goes on to other work would hold it beside that; a task of 16 MB gains as much from its own pieces."""
        if self.cut != "whole":
            self.cache.clear()
            self.cache.older = {}

    def _spaced(self, text: str) -> str | None:
        """The text with spaces at its sure cuts, and only there; None if the whole text must be encoded."""
        if self.cut == "whole" or _SPECIAL in text:
            return None
        if self.cut == "white":
            return None if _UNUSUAL_SPACED.search(text) else text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "  " in text or " \n" in text or "\n\n" in text or text.endswith(" ") or _UNUSUAL.search(text):
            return None
        spaced = text.replace("\n", _BREAK)
        return spaced[1:] if spaced[0] == " " else _FIRST + spaced

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        out = [b""] * len(texts)
        places, spaced = [], []
        for n, text in enumerate(texts):
            cut = self._spaced(text) if text else ""
            if cut is None:
                out[n] = self.whole(text)
            elif cut:
                places.append(n)
                spaced.append(cut)
        for n, ids in zip(places, self._looked_up(spaced) if spaced else ()):
            out[n] = ids
        return out

    def _looked_up(self, spaced: list[str]) -> list[bytes]:
        """Each text's ids, for which each distinct piece of all of them is looked up once."""
        cut = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        ids, sizes = self.cache.of_pieces(coded.dictionary)
        runs = coded.indices.to_numpy()
        raw = _taken(ids, sizes, runs).tobytes()
        at = (np.append(0, np.cumsum(sizes[runs]))[cut.offsets.to_numpy()] * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


def cached_encoder(path: str, cut: str, specials_as_text: bool = False) -> CachedEncoder:
    """One encoder per worker and tokenizer; its memory lasts as long as the worker."""
    key = ("encoder", path, cut, specials_as_text)
    if key not in _WORKER:
        _WORKER[key] = CachedEncoder(path, cut, specials_as_text)
    return _WORKER[key]


def described(path: str) -> dict:
    """What a tokenizer file says about itself, without vocabulary and merges."""
    key = ("description", path)
    if key not in _WORKER:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        _WORKER[key] = {k: v for k, v in found.items() if k != "model"} | {"kind": found["model"].get("type"), "ignore_merges": found["model"].get("ignore_merges"), "plain": not any(found["model"].get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))}
    return _WORKER[key]


def is_byte_level(path: str) -> bool:
    """Whether the file is byte-level BPE over the usual split, whose one special string is ``CachedEncoder.JOINER``."""
    d = described(path)
    pre = d["pre_tokenizer"] or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(usual and d["normalizer"] is None and d["kind"] == "BPE" and not d["ignore_merges"] and [t["content"] for t in d["added_tokens"]] == [CachedEncoder.JOINER])


def splits_at_letters(path: str) -> bool:
    """Whether the file's pre-tokens surely are runs of letters, and marks apart from them, each written byte by byte for a plain BPE model."""
    d = described(path)
    if is_byte_level(path):
        return d["plain"]
    known = [{"type": "Split", "pattern": {"Regex": _LETTER_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return d["plain"] and d["kind"] == "BPE" and (d["pre_tokenizer"] or {}).get("pretokenizers") == known


def cut_of(path: str) -> str:
    """How texts may be cut for a tokenizer file, from its own description; "whole" for kinds that aren't known here."""
    d = described(path)
    if is_byte_level(path):
        return "space"
    steps = (d["normalizer"] or {}).get("normalizers", [])
    folds = {x["type"] for x in steps} == {"NFC", "Replace", "Lowercase"} and all(x.get("pattern") == {"Regex": r"\s+"} and x["content"] == " " for x in steps if x["type"] == "Replace")
    splits = [x for x in (d["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
    drops = len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and r"[^\s\p{L}\p{N}]+" in splits[0]["pattern"].get("Regex", "")
    return "white" if folds and drops and CachedEncoder.JOINER in [t["content"] for t in d["added_tokens"]] else "whole"
