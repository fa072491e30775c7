"""Licence scans: one Aho-Corasick pass for notices and tags, a parser for licence expressions.

Text is lower-cased (A-Z) and cut into words; the automaton runs over the words
joined by single spaces, so a phrase is found wherever its words stand
consecutively.  After each ``SPDX-License-Identifier`` tag the rest of the line
is read as a licence expression: Dijkstra's shunting-yard turns ``a or b and c
with d`` into postfix order (with binds before and, and before or), which is
evaluated, to the licences it names or against a set of accepted ones.

Nulls: a null text is empty: no words, no labels, score 0.  Malformed
expressions (two names in a row, an operator without an operand, open
brackets) give no label.  Null ids and repeated rows are scanned as they stand.
Texts are scanned whole, in time linear in their length; a task holds the words of
about a million characters at a time, or of one text if it is longer.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD_BYTES, by_batch, text_rows

#: The base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices that licences ask to be kept.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
_TAG_IN_TEXT = re.compile(r"spdx[^0-9a-z\n]license[^0-9a-z\n]identifier[ \t]*:?[ \t]*([^\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"\(|\)|[0-9A-Za-z.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
_WORKER: dict = {}


def postfix(expression: str) -> list[str] | None:
    """The expression's names and operators in postfix order; None if it is malformed."""
    out, waiting, operand_next = [], [], True
    rest = expression.strip()
    if _TOKEN.sub("", rest).strip():
        return None
    for token in _TOKEN.findall(rest):
        word = token.lower()
        if word in _BINDS or token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and (token == ")" or _BINDS[waiting[-1]] >= _BINDS[word]):
                out.append(waiting.pop())
            if token == ")":
                if not waiting:
                    return None
                waiting.pop()
            else:
                waiting.append(word)
                operand_next = True
        elif not operand_next:
            return None
        elif token == "(":
            waiting.append(token)
        else:
            out.append(word)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def licences_of(expression: str) -> set[str]:
    """The licences that an expression names, an exception with its licence; empty if it is malformed."""
    stack: list[set[str]] = []
    for token in postfix(expression) or []:
        if token not in _BINDS:
            stack.append({token})
            continue
        right, left = stack.pop(), stack.pop()
        stack.append({f"{a} with {b}" for a in left for b in right} if token == "with" else left | right)
    return stack[0] if stack else set()


def satisfied(expression: str, accepted: set[str]) -> bool:
    """Whether accepting these licences is enough: or needs one side, and needs both."""
    stack: list[tuple[str, bool]] = []
    for token in postfix(expression) or []:
        if token not in _BINDS:
            stack.append((token, token in accepted))
            continue
        (right, y), (left, x) = stack.pop(), stack.pop()
        name = f"{left} with {right}"
        stack.append((name, name in accepted if token == "with" else x or y if token == "or" else x and y))
    return bool(stack) and stack[0][1]


def _automaton() -> ahocorasick.Automaton:
    if "notices" not in _WORKER:
        a = ahocorasick.Automaton()
        for phrase, label in (NOTICE_PHRASES | BASE_PHRASES).items():
            a.add_word(f" {phrase} ", (phrase, label))
        a.add_word(f" {TAG} ", (TAG, ""))
        a.make_automaton()
        _WORKER["notices"] = a
    return _WORKER["notices"]


def scan(text: str | None) -> dict:
    """Counts, places and labels of one text."""
    words = text.encode().translate(WORD_BYTES).split() if text else []
    line = (b" " + b" ".join(words) + b" ").decode("latin1")
    base, labels, ends, tagged, known = set(), set(), [], False, 0
    for end, (phrase, label) in _automaton().iter(line):
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        known += phrase.count(" ") + 1
        if phrase in BASE_PHRASES:
            base.add(label)
            ends.append((end, phrase.count(" ")))
    places = []
    if ends:
        # where each word's last character stands in the line
        last = np.cumsum([len(w) + 1 for w in words])
        places = (np.searchsorted(last, [e - 1 for e, _ in ends]) - [n for _, n in ends]).tolist()
    expressions = []
    if tagged:
        for found in _TAG_IN_TEXT.findall(text):
            # comment closers may follow the expression
            expression = re.split(r"\s(?:\*/|-->|#|//)", found)[0].strip()
            named = licences_of(expression)
            if named:
                expressions.append(expression)
                labels |= named
    score = 1.0 if expressions else min(1.0, known / (known + 4)) if known else 0.0
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "expressions": expressions}


_SCANS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("expressions", T.ArrayType(T.StringType())))])


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs; places count words from 0, score is 1 for a valid tag and grows with the notices' words else."""

    def made(ids, texts):
        rows = [scan(t) for t in texts]
        return {"doc_id": ids} | {k: [r[k] for r in rows] for k in _SCANS.names[1:]}

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(by_batch(made, _SCANS), _SCANS)
