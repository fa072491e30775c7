"""Exact token counts at every prefix of a text.

For a byte-level merge tokenizer the encoding of a prefix is the encoding of a
shorter prefix and one last token, so dynamic programming over a pre-token's
prefixes finds each count from earlier ones: token t may follow if merging the
prefix's last token and t yields just these two.  The counts are kept as
differences from one prefix to the next, one small integer per character; sums
of them answer how many tokens a prefix has, or where a budget is used up, without
encoding again.  Differences are remembered per piece of text between sure cuts.

Units are split by another regex engine than the library's.  The characters that the two
class in different ways are found by asking both about every one, and a stretch between sure cuts that
holds one is taken from the library prefix by prefix, which is quadratic in
the stretch.  All else rests on the tables alone, at every length.
Tokenizer files of another kind than byte-level merges are refused.

A worker remembers a bounded number of units, beginnings and pairs of tokens.  Texts are counted whole.
Nulls: a null text is empty and has no tokens; repeated rows and null ids are
counted as they stand.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, text_rows
from .prefix_tables import LastTokens
from .tokenization import _UNUSUAL, is_byte_level, load_tokenizer, tokenizer_path

#: Fixed value: how byte-level tokenizers split text before merging.
_CONTRACTED = r"'s|'t|'re|'ve|'m|'ll|'d"
_WORD = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
_PRE = _CONTRACTED + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
#: A unit is a pre-token with the white space before it, since a run of white space is cut before its last character once something follows.
_UNITS = regex.compile(rf"{_PRE}|\s+(?:(?<= )(?:{_WORD})|(?<! )(?:{_CONTRACTED}|{_WORD}))?")
_SPACE = regex.compile(r"\s*")
#: The vocabulary's one special string, which the library takes for one token inside texts.
SPECIAL = "<|endoftext|>"
#: What a worker remembers: units, and the tables of beginnings of so many bytes.
CACHE_UNITS, CACHE_HEADS, HEAD_BYTES = 1_000_000, 200_000, 6
#: A cut that every engine makes: a space between two visible ASCII characters.
_SURE = regex.compile(r"(?<=[!-~])(?= [!-~])")
_WORKER: dict = {}


class PrefixCounter:
    def __init__(self, path: str):
        if not is_byte_level(path):
            raise ValueError(f"{path} is no byte-level merge tokenizer")
        self.library = load_tokenizer(path)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        bytes_of = {chr(c): c for c in visible} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        read = lambda s: bytes(bytes_of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = LastTokens.from_merges([(read(a), read(b)) for a, b in pairs])
        self.units: dict[str, bytes] = {}
        self.heads: dict[bytes, tuple[list[int], list[int], int]] = {}
        self.disputed: regex.Pattern | None = None

    def prefixes(self, raw: bytes) -> list[int]:
        """Token counts of raw[:1], raw[:2], ...: the table of last tokens grows by one prefix at a time."""
        if len(raw) <= HEAD_BYTES:
            return self.table.counts(self.table.extend(raw, [-1], 0))[1:]
        head = raw[:HEAD_BYTES]
        if (known := self.heads.get(head)) is None:  # words with the same beginning share its table
            if len(self.heads) >= CACHE_HEADS:
                self.heads.clear()
            last = self.table.extend(head, [-1], 0)
            known = self.heads[head] = (last, self.table.counts(last), self.table.node)
        last, counts, node = known
        return self.table.counts(self.table.extend(raw, last[:], node), counts[:])[1:]

    def pre_token(self, text: str) -> list[int]:
        """Counts at the character prefixes of a pre-token."""
        raw = text.encode()
        counts = self.prefixes(raw)
        if len(raw) == len(text):
            return counts
        # a character ends where no continuation byte follows
        return [c for c, after in zip(counts, raw[1:] + b" ") if after & 0xC0 != 0x80]

    def word(self, text: str) -> list[int]:
        """Counts at the character prefixes of a pre-token, or of white space."""
        counts = self.pre_token(text)
        if text in ("'re", "'ve", "'ll"):  # cut after two characters it is a quote and a letter
            counts[1] = 2
        return counts

    def unit(self, text: str) -> bytes:
        """Differences of the counts at each character prefix of a unit."""
        if (known := self.units.get(text)) is not None:
            return known
        space = _SPACE.match(text).end()
        if space in (0, len(text)) or text[:space] == " ":
            counts = self.word(text)
        else:
            # the run's last character begins the next pre-token: a space with the word after it, any other alone
            run = self.pre_token(text[:space])
            base = run[space - 2] if space > 1 else 0
            if text[space - 1] == " ":
                after = self.word(text[space - 1 :])[1:]
            else:
                last = self.pre_token(text[space - 1 : space])[0]
                after = [last + c for c in self.word(text[space:])]
            counts = run + [base + c for c in after]
        steps = [b - a for a, b in zip([0, *counts], counts)]
        if len(self.units) >= CACHE_UNITS:
            self.units.clear()
        if max(steps) > 127 or min(steps) < -127:
            raise OverflowError("a step of more than 127 tokens")
        known = self.units[text] = bytes([x & 255 for x in steps])
        return known

    def differences(self, text: str) -> np.ndarray:
        """One step per character: the count at a prefix is the sum up to its end."""
        parts, begin = [], 0
        while (at := text.find(SPECIAL, begin)) >= 0:
            # up to its last character the special string is ordinary text; then all of it is one token
            end = at + len(SPECIAL)
            steps = self._plain(text[begin : end - 1]).astype(np.int32)
            inside = self._plain(text[begin:at]).sum(dtype=np.int64)
            parts += [steps, [inside + 1 - steps.sum()]]
            begin = end
        rest = self._plain(text[begin:])
        return np.concatenate([*parts, rest]).astype(np.int32) if parts else rest

    def _plain(self, text: str) -> np.ndarray:
        if not _UNUSUAL.search(text):
            return self._steps(text)
        parts, agreed = [], []
        for stretch in _SURE.split(text):
            if _UNUSUAL.search(stretch) and self._disputed().search(stretch):
                parts += [self._steps("".join(agreed)), self._by_library(stretch)]
                agreed = []
            else:
                agreed.append(stretch)
        return np.concatenate([*parts, self._steps("".join(agreed))])

    def _disputed(self) -> regex.Pattern:
        """The characters that the library's engine and ours don't both take for a letter, a number or white space.

        Both are asked once per worker about every character; their Unicode tables are of different years.
        """
        if self.disputed is None:
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
            ask, found = "".join(regex.findall(_UNUSUAL.pattern, every)), set()
            for name in (r"\p{L}", r"\p{N}", r"\s"):
                split = Split(Regex(f"{name}+"), "removed", invert=True)
                theirs = {c for at in range(0, len(ask), 50_000) for piece, _ in split.pre_tokenize_str(ask[at : at + 50_000]) for c in piece}
                found |= theirs ^ set(regex.findall(name, ask))
            codes, spans = sorted(map(ord, found)), []
            for c in codes:
                if spans and c == spans[-1][1] + 1:
                    spans[-1][1] = c
                else:
                    spans.append([c, c])
            self.disputed = regex.compile("[" + "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in spans) + "]" if spans else "(?!)")
        return self.disputed

    def _steps(self, text: str) -> np.ndarray:
        units = _UNITS.findall(text)
        try:
            try:
                return np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int8)
            except KeyError:
                return np.frombuffer(b"".join([self.unit(u) for u in units]), np.int8)
        except OverflowError:
            return self._by_library(text)

    def _count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _by_library(self, text: str) -> np.ndarray:
        """Each prefix by the library, for characters that the library classes in another way."""
        return np.diff([self._count(text[:end]) for end in range(1, len(text) + 1)], prepend=0).astype(np.int32)


def prefix_counter(path: str) -> PrefixCounter:
    if path not in _WORKER:
        _WORKER[path] = PrefixCounter(path)
    return _WORKER[path]


_COUNTS = [("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("steps", T.BinaryType())]


def prefix_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", keep_steps: bool = True, budget: int | None = None, place: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, steps): steps has little-endian 16-bit differences, one per character; null if they aren't kept.

    budget adds ``budget_chars``, the characters of the longest prefix of at most so many
    tokens; place adds ``place_tokens``, the tokens of the prefix of so many characters (of the whole text if it is shorter).
    """
    path = tokenizer_path(tokenizer)
    asked = [("budget_chars", T.LongType())] * (budget is not None) + [("place_tokens", T.LongType())] * (place is not None)
    schema = T.StructType([T.StructField(n, t) for n, t in _COUNTS + asked])

    def made(ids, texts):
        counter = prefix_counter(path)
        steps = [counter.differences(t) if t else np.zeros(0, np.int8) for t in texts]
        out = {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": [int(x.sum(dtype=np.int64)) for x in steps], "steps": [x.astype("<i2").tobytes() if keep_steps else None for x in steps]}
        if budget is not None:
            out["budget_chars"] = [len(x) if n <= budget else _within(x, budget) for x, n in zip(steps, out["n_tokens"])]
        if place is not None:
            out["place_tokens"] = [int(x[:place].sum(dtype=np.int64)) for x in steps]
        return out

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(by_batch(made, schema), schema)


def _within(steps: np.ndarray, budget: int) -> int:
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def tokens_at(steps: bytes, chars: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(np.frombuffer(steps, "<i2")[:chars].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return _within(np.frombuffer(steps, "<i2"), budget)


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Adds over_limit: whether the whole text has more tokens than the limit."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
