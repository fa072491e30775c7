"""Byte-level merges by ranks: encoding, appending, editing, decoding.

Texts are split by the public pattern and each match is encoded by its table of
last tokens (``prefix_tables``).  Tables stay usable: text put at the end only
lengthens the last match's table, an edit encodes again from the match before it
to the first match that begins where an old one began, and a match that keeps
its beginning keeps that part of its table.

A worker remembers the ids of a bounded number of matches.  Texts are encoded
whole.  Nulls: a null text is empty and has no ids, and null ids decode to
null; repeated rows and null doc_ids are encoded as they stand.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, text_rows
from .prefix_tables import LastTokens
from .tokenization import tokenizer_path

#: What a worker remembers: matches with their ids.
CACHE_PIECES = 400_000
#: Beginnings of matches of which it remembers the table.
CACHE_HEADS, HEAD_BYTES = 100_000, 6
#: Characters that a match looks at beyond its end, or a short one beyond its start.
LOOKS = 3
#: Characters on which all engines' tables of letters and numbers agree.
_AGREED = regex.compile("[^\x00-ɏ]")
_WORKER: dict = {}


def _u4(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return pack(f"<{len(ids)}I", *ids)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class RankDecoder:
    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class RankEncoder(RankDecoder):
    def __init__(self, path: str):
        import public_tokenizers

        super().__init__(path)
        if missing := 256 - sum(len(t) == 1 for t in self.ranks):
            raise ValueError(f"{path} lacks {missing} single bytes")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.table = LastTokens.from_ranks(self.ranks)
        self.rank_of = [self.ranks[t] for t in self.table.bytes_of]
        self.ids: dict[str, bytes] = {}
        self.heads: dict[bytes, tuple[list[int], int]] = {}
        self.stand_ins: dict[int, str] | None = None

    def split(self, text: str, begin: int = 0):
        """The pattern's matches from a place on, as (start, end)."""
        if _AGREED.search(text):
            text = text.translate(self._stand_ins())
        return (m.span() for m in self.pattern.finditer(text, begin))

    def matches(self, text: str) -> list[str]:
        if _AGREED.search(text):
            return [text[a:b] for a, b in self.split(text)]
        return self.pattern.findall(text)

    def _stand_ins(self) -> dict[int, str]:
        """For characters that the public library's engine takes for neither letter nor number, another such one.

        Both engines are asked once per worker: their Unicode tables are of different years.
        """
        if self.stand_ins is None:
            import tiktoken

            ask = "".join(chr(c) for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000)
            members = {}
            for name in (r"\p{L}", r"\p{N}"):
                library = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
                theirs = {c for at in range(0, len(ask), 50_000) for c in bytes(library.encode_ordinary(ask[at : at + 50_000])).decode()}
                members[name] = theirs, set(regex.findall(name, ask))
            (letters, our_letters), (numbers, our_numbers) = members.values()
            stand_ins = {}
            for c in (letters ^ our_letters) | (numbers ^ our_numbers):
                stand_ins[ord(c)] = "a" if c in letters else "1" if c in numbers else "!"
            self.stand_ins = stand_ins
        return self.stand_ins

    def last_tokens(self, raw: bytes) -> list[int]:
        """A match's table; matches that begin alike share that part."""
        if len(raw) <= HEAD_BYTES:
            return self.table.extend_from(raw, [-1], 0)
        head = raw[:HEAD_BYTES]
        if (known := self.heads.get(head)) is None:
            if len(self.heads) >= CACHE_HEADS:
                self.heads.clear()
            known = self.heads[head] = (self.table.extend_from(head, [-1], 0), self.table.node)
        return self.table.extend_from(raw, known[0][:], known[1])

    def ids_of(self, raw: bytes, last: Sequence[int]) -> bytes:
        """A match's ids, little-endian: one if its bytes are a token, else by its table."""
        whole = self.ranks.get(raw)
        return _u4([self.rank_of[t] for t in self.table.tokens(last)] if whole is None else [whole])

    def piece(self, piece: str) -> bytes:
        """A match's ids, remembered."""
        if (known := self.ids.get(piece)) is None:
            raw = piece.encode()
            known = self.learn(piece, _u4([self.ranks[raw]]) if raw in self.ranks else self.ids_of(raw, self.last_tokens(raw)))
        return known

    def learn(self, piece: str, ids: bytes) -> bytes:
        if len(self.ids) >= CACHE_PIECES:
            self.ids.clear()
        self.ids[piece] = ids
        return ids

    def parts(self, pieces: list[str]) -> list[bytes]:
        """Each match's ids; the unknown ones are learned first, each once."""
        try:
            return list(map(self.ids.__getitem__, pieces))
        except KeyError:
            unknown = set(pieces).difference(self.ids)
        if len(self.ids) + len(unknown) > CACHE_PIECES:
            self.ids.clear()
            unknown = set(pieces)
        if len(unknown) > CACHE_PIECES:
            return list(map(self.piece, pieces))
        for piece in unknown:
            self.piece(piece)
        return list(map(self.ids.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.parts(self.matches(text)))


class EncodedText:
    """A text with its matches and their tables; appending and editing encode again only what they touch.

    ``redone`` is how many matches the last change encoded again.
    """

    def __init__(self, encoder: RankEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces = encoder.matches(text)
        self.parts = encoder.parts(self.pieces)
        #: Tables of matches as far as they were given or a change has needed them.
        self.tables: list[Sequence[int] | None] = [None] * len(self.pieces)
        self.redone = len(self.pieces)

    @classmethod
    def stored(cls, encoder: RankEncoder, text: str, last: bytes) -> EncodedText:
        """From a text and the column ``last`` that was kept for it; nothing is encoded."""
        self = object.__new__(cls)
        self.encoder, self.text, self.redone = encoder, text, 0
        self.pieces, self.parts, self.tables = encoder.matches(text), [], []
        numbers, begin = np.frombuffer(last, "<i4").tolist(), 0
        for piece in self.pieces:
            raw = piece.encode()
            table = array("i", [-1, *numbers[begin : begin + len(raw)]])
            begin += len(raw)
            self.tables.append(table)
            self.parts.append(encoder.ids_of(raw, table))
        return self

    def copy(self) -> EncodedText:
        other = object.__new__(EncodedText)
        other.encoder, other.text, other.redone = self.encoder, self.text, 0
        other.pieces, other.parts, other.tables = self.pieces[:], self.parts[:], self.tables[:]
        return other

    @property
    def ids(self) -> bytes:
        return b"".join(self.parts)

    @property
    def last(self) -> bytes:
        """The last token of each byte prefix of each match, as little-endian 32-bit numbers of ``LastTokens``."""
        return b"".join([array("i", self._table(k)[1:]).tobytes() for k in range(len(self.pieces))])

    def _table(self, k: int) -> Sequence[int]:
        if self.tables[k] is None:
            self.tables[k] = self.encoder.last_tokens(self.pieces[k].encode())
        return self.tables[k]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the characters from begin to end."""
        begin, end = sorted((max(0, min(begin, len(self.text))), max(0, min(end, len(self.text)))))
        first, start = self._before(begin - LOOKS)
        moved = len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        pieces, k, old = [], first, start
        for a, b in self._matches_from(start, end + moved):
            if a >= begin + len(new):
                while k < len(self.pieces) and old < a - moved:
                    old += len(self.pieces[k])
                    k += 1
                if k < len(self.pieces) and old == a - moved:  # from here on all matches are the old ones
                    break
            pieces.append(self.text[a:b])
        else:
            k = len(self.pieces)
        known = [self._again(p, first + n if first + n < k else None) for n, p in enumerate(pieces)]
        self.parts[first:k], self.tables[first:k] = [x[0] for x in known], [x[1] for x in known]
        self.pieces[first:k] = pieces
        self.redone = len(pieces)

    def _before(self, place: int) -> tuple[int, int]:
        """The match in which a place is, and its start: matches before it don't look at what changes."""
        if len(self.text) - place < 256:  # near the end
            k, start = len(self.pieces), len(self.text)
            while k and start > max(place, 0):
                k -= 1
                start -= len(self.pieces[k])
            return k, start
        starts = [0, *accumulate(map(len, self.pieces))]
        k = max(0, bisect_right(starts, place) - 1)
        return k, starts[k]

    def _matches_from(self, start: int, changed_until: int):
        """Matches from a place on, looking at more and more text only if they don't end sooner."""
        encoder, width = self.encoder, 48
        while True:
            stop = changed_until + width
            window = self.text[start:stop]
            found = [(a + start, b + start) for a, b in encoder.split(window)]
            if stop >= len(self.text):
                yield from found
                return
            # the last matches may look at what is behind the window
            sure = [x for x in found if x[1] <= stop - LOOKS]
            if sure and sure[-1][1] > changed_until + width // 2:
                yield from sure
                start, changed_until = sure[-1][1], sure[-1][1]
            width *= 2

    def _again(self, piece: str, k: int | None) -> tuple[bytes, Sequence[int] | None]:
        """A match's ids and table; entries of the match that was there stay as far as both begin alike."""
        encoder = self.encoder
        if k is None or (self.tables[k] is None and len(self.pieces[k]) < 64):
            return encoder.piece(piece), None
        raw, before = piece.encode(), self.pieces[k].encode()
        alike = next((n for n, (a, b) in enumerate(zip(raw, before)) if a != b), min(len(raw), len(before)))
        last = encoder.table.extend(raw, list(self._table(k)[: alike + 1]))
        return encoder.ids_of(raw, last), last


def _worker(kind: type, path: str):
    """One encoder or decoder per worker and file."""
    if (kind, path) not in _WORKER:
        _WORKER[kind, path] = kind(path)
    return _WORKER[kind, path]


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken", keep_tables: bool = False, decode: bool = False, append: str | None = None, edit: Callable[[str], tuple[int, int, str]] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit integers.

    keep_tables adds ``last``, from which ``EncodedText.stored`` goes on; decode adds
    ``decoded``, the bytes that the ids stand for, from the same worker; append adds
    ``appended_ids``, those of the text and what is appended; edit, which gives
    (begin, end, new text) for a text, adds ``edited_ids``.  Both come from the
    text's tables, not from encoding it anew.
    """
    path = tokenizer_path(ranks)
    wanted = ["decoded"] * decode + ["last"] * keep_tables + ["appended_ids"] * (append is not None) + ["edited_ids"] * (edit is not None)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in ("ids", *wanted)]])

    def made(doc_ids, texts):
        encoder = _worker(RankEncoder, path)
        out = {n: [] for n in ("ids", *wanted)}
        for text in texts:
            text = text or ""
            if not set(wanted).difference(("decoded",)):
                out["ids"].append(encoder.encode(text))
                continue
            whole = EncodedText(encoder, text)
            out["ids"].append(whole.ids)
            if keep_tables:
                out["last"].append(whole.last)
            if append is not None:
                longer = whole.copy()
                longer.append(append)
                out["appended_ids"].append(longer.ids)
            if edit is not None:
                whole.replace(*edit(text))
                out["edited_ids"].append(whole.ids)
        if decode:
            out["decoded"] = list(map(encoder.decode, out["ids"]))
        return {"doc_id": doc_ids, "n_tokens": [len(x) // 4 for x in out["ids"]], **out}

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(by_batch(made, schema), schema)


def decoded(ids: Column, *, ranks: str = "byte_bpe_50k.tiktoken") -> Column:
    """The bytes of little-endian unsigned 32-bit ids; null for null."""
    path = tokenizer_path(ranks)

    @F.pandas_udf("binary")
    def decode(column: pd.Series) -> pd.Series:
        decoder = _worker(RankDecoder, path)
        return pd.Series([None if x is None else decoder.decode(x) for x in column], dtype=object)

    return decode(ids)
