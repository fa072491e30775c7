"""Quality rules with a suffix array over each text's words.

Suffixes are ranked by prefix doubling over all words of a block of documents
at once (ranks never mix documents).  Neighbours in suffix order share their
longest common prefix; an interval of neighbours with a common prefix of at
least ``min_repeat`` words is a maximal repeated substring.  The longest repeat
that starts at a word is the larger of the two prefixes beside it, so the union
of all repeats' spans is one prefix sum.  A text is rejected if the union
covers more than ``max_covered`` of its words or if its longest repeat has more than
``max_repeat`` words.

Nulls: a null text has no words and no lines.  Null ids, ties and repeated rows
are judged row by row; texts are judged whole, whatever their length.  A task holds a
few integers for each word of about a million characters at a time, or of one text if it is longer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, spaced_words, text_rows

_ASCII_SPACE = re.compile("[\x20\x09-\x0d]")
#: Fixed values of the base rules: fewer words, or a larger share of words in repeated 3-word windows, fail.
MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of integer keys, from 0."""
    return np.unique(keys, return_inverse=True)[1]


class SuffixRanks:
    """Suffixes of many documents in a row in order, by prefix doubling over 1, 2, 4, ... words.

    Ranks never mix documents: a suffix that ends early comes before its
    extensions, and equals no window of another document or length.  ``first``
    and ``second`` are the ranks of windows of one and two words; of the
    later ranks only the last are kept.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.ends = ends  # of each word's document
        where = np.arange(n)
        rank = _ranks(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
        self.first, self.second, k = rank, None, 1
        while self.second is None or k < n and int(rank.max(initial=-1)) + 1 < n:
            after = np.where(where + k < ends, rank[np.minimum(where + k, n - 1)] + 1, 0)
            rank = _ranks(rank.astype(np.int64) * (n + 1) + after)
            if self.second is None:
                self.second = rank
            k *= 2
        self.rank = rank
        self.order = np.argsort(rank, kind="stable")

    def common(self) -> np.ndarray:
        """Longest common prefix of each suffix in order with the one before it, 0 for the first.

        The suffix one word on keeps all but one of its common words, so only the
        first suffix of each chain of neighbours is compared, all chains side by side;
        these comparisons take about n log n words in all.
        """
        n = len(self.first)
        before = np.full(n, -1)
        before[self.order[1:]] = self.order[:-1]
        # only neighbours with an equal first word share anything
        before[(before >= 0) & (self.first[before] != self.first)] = -1
        lcp = np.zeros(n, np.int64)
        # links of a chain: the suffix one word on has the neighbour one word on
        chained = np.zeros(n, bool)
        inner = np.flatnonzero(before[1:] >= 0) + 1
        chained[inner] = (before[inner - 1] >= 0) & (before[inner] == before[inner - 1] + 1) & (self.ends[inner] == self.ends[inner - 1])
        at = np.flatnonzero((before >= 0) & ~chained)
        i, j, out = at.copy(), before[at], np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for _ in range(32):
            if not len(live):
                break
            a, b = i[live], j[live]
            same = (a < self.ends[at[live]]) & (b < self.ends[before[at[live]]])
            a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
            same &= self.first[a] == self.first[b]
            live = live[same]
            i[live] += 1
            j[live] += 1
            out[live] += 1
        for k in live.tolist():  # long repeats, of which there are few: by stretches of words
            a, b, size = int(i[k]), int(j[k]), 64
            rest = min(int(self.ends[at[k]]) - a, int(self.ends[before[at[k]]]) - b)
            while rest > 0:
                size = min(2 * size, rest)
                differ = np.flatnonzero(self.first[a : a + size] != self.first[b : b + size])
                step = int(differ[0]) if len(differ) else size
                out[k] += step
                a, b, rest = a + step, b + step, rest - size if step == size else 0
        lcp[at] = out
        # along a chain each value is one less than the one before it
        head = np.maximum.accumulate(np.where((before >= 0) & ~chained, np.arange(n), -1))
        on = np.flatnonzero(chained)
        lcp[on] = lcp[head[on]] - (on - head[on])
        return lcp[self.order]

    def repeats(self, least: int) -> np.ndarray:
        """For each word the length of the longest repeat that starts there, 0 if under least words."""
        lcp = self.common()
        keep = np.flatnonzero(lcp >= least)
        longest = np.zeros(len(self.first), np.int64)
        np.maximum.at(longest, self.order[keep - 1], lcp[keep])
        np.maximum.at(longest, self.order[keep], lcp[keep])
        return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step)[:n] > 0


def measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    """All counts of a block of texts."""
    words = [spaced_words(t) for t in texts]
    sizes = np.array([*map(len, words)], np.int64)
    n, known = int(sizes.sum()), {}
    flat = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    out = {"n_words": sizes, "n_repeat_words": np.zeros(len(texts), np.int64), "covered_words": np.zeros(len(texts), np.int64), "longest_repeat": np.zeros(len(texts), np.int64)}
    out["word_chars"] = np.array([len(_ASCII_SPACE.sub("", t)) if t else 0 for t in texts], np.int64)
    out["n_symbols"] = np.array([sum(t.count(c) for c in "#*$%&|<>") if t else 0 for t in texts], np.int64)
    dup = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    if n:
        ranks = SuffixRanks(flat, doc, ends)
        where = np.arange(n)
        starts = where[where + 3 <= ends]
        if len(starts):
            window = _ranks(ranks.second[starts].astype(np.int64) * (n + 1) + ranks.first[starts + 2])
            twice = np.bincount(window)[window] > 1
            out["n_repeat_words"] = np.bincount(doc, covered(starts[twice], np.full(int(twice.sum()), 3), n), len(texts)).astype(np.int64)
        longest = ranks.repeats(min_repeat)
        at = np.flatnonzero(longest)
        out["covered_words"] = np.bincount(doc, covered(at, longest[at], n), len(texts)).astype(np.int64)
        np.maximum.at(out["longest_repeat"], doc[at], longest[at])
    return out


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
_MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", *_COLUMNS)])


def repeated_spans(text: str | None, min_repeat: int = 8) -> list[tuple[int, int]]:
    """The union of a text's repeats as (first word, word after the last)."""
    words = spaced_words(text)
    if not words:
        return []
    known: dict[bytes, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    longest = SuffixRanks(flat, np.zeros(len(flat), np.int64), np.full(len(flat), len(flat))).repeats(min_repeat)
    at = np.flatnonzero(longest)
    edge = np.flatnonzero(np.diff(covered(at, longest[at], len(flat)).astype(int), prepend=0, append=0))
    return [*zip(edge[::2].tolist(), edge[1::2].tolist())]


def quality_measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 8) -> DataFrame:
    """Word, symbol, line and repeat counts of every document."""

    def made(ids, texts):
        return {"doc_id": ids} | measure(texts, min_repeat)

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(by_batch(made, _MEASURES), _MEASURES)


def _judged(m: DataFrame, max_covered: float, max_repeat: int) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    share = F.coalesce(F.try_divide(F.col("covered_words").cast("double"), F.col("n_words")), F.lit(0.0))
    return m.withColumn("base_failed", failed).withColumn("covered_share", share).withColumn("kept", ~failed & (share <= max_covered) & (F.col("longest_repeat") <= max_repeat))


def passing(docs: DataFrame, *, text_col: str = "text", min_repeat: int = 8, max_covered: float = 0.3, max_repeat: int = 200) -> DataFrame:
    """The rows whose text the rules keep, with all their columns; judged in place, without a join."""

    @F.pandas_udf(T.StructType(_MEASURES.fields[1:]))
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            parts = [measure(t, min_repeat) for _, t in pieces(x.tolist())]
            yield pd.DataFrame({c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in _COLUMNS})

    rows = docs.select(F.struct("*").alias("row"), measured(F.col(text_col).cast("string")).alias("m")).select("row", "m.*")
    return _judged(rows, max_covered, max_repeat).where("kept").select("row.*")


def pieces(texts: list):
    """A batch's texts in runs of bounded size."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size >= 1_000_000:
            yield size, part
            part, size = [], 0
    if part:
        yield size, part


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 8, max_covered: float = 0.3, max_repeat: int = 200) -> DataFrame:
    """The measures with base_failed, covered_share and kept."""
    m = quality_measures(docs, id_col=id_col, text_col=text_col, min_repeat=min_repeat)
    return _judged(m, max_covered, max_repeat)
