"""Fill-in-the-middle forms of texts.

A text is cut into units (a word with the white space before it); two of the
places between units, chosen by a digest of the doc_id, part it into prefix,
middle and suffix, which the output gives in another order between sentinels.
A worker keeps one text's unit ends as 32-bit integers and slices the text
twice; nothing depends on other rows, so tasks repeat with equal results.

Nulls: a null text is empty; an empty text, and one that holds a sentinel, stays
plain, with null lengths; a null doc_id is written as nothing in the seed.
Repeated rows give repeated results; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows

#: Fixed value: prefix, suffix and middle sentinels.
SENTINELS = ("<P>", "<S>", "<M>")
_UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_FORMED = "n long, form string, prefix_chars long, middle_chars long, output string"
_DIGESTS = "output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in _UNIT.finditer(text)))


def seeds(seed: int, doc_id: str | None) -> list[int]:
    """The first four groups of eight hex digits of the sha256 of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def formed(text: str, doc_id: str | None, seed: int, percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple:
    """(units, form, characters of prefix and of middle, output) of one text."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = seeds(seed, doc_id)
    if not text or h3 % 100 >= percent or any(s in text for s in sentinels):
        return len(ends), "plain", None, None, text
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h4 % 100 < spm_percent:
        return len(ends), "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return len(ends), "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def rebuilt(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (p, s) if form == "psm" else (s, p)
    at = output.index(second, len(first))
    end = output.index(m, at + len(second))
    parts = {first: output[len(first) : at], second: output[at + len(second) : end]}
    return parts[p] + output[end + len(m) :] + parts[s]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Refuses sentinels that an output's parts and borders could form by chance."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(x[0] in y[1:] or x != y and y.startswith(x) for x in sentinels for y in sentinels):
        raise ValueError(f"sentinels must differ, and none may hold another's first character after its own: {sentinels}")
    return tuple(sentinels)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``percent`` of the documents are formed, and ``spm_percent`` of these give the suffix first.
    """
    marks = _checked(sentinels)

    @F.pandas_udf(_FORMED)
    def form(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [formed(t, i, seed, percent, spm_percent, marks) for i, t in zip(ids, texts)]
        return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)

    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    return rows.select("doc_id", form(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("x")).select("doc_id", "x.*")


def digests(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """A struct of the output's sha256 and that of the text rebuilt from it."""
    marks = _checked(sentinels)

    @F.pandas_udf(_DIGESTS)
    def digest(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return pd.DataFrame({"output_sha256": [sha(o) for o in outputs], "restored_sha256": [sha(rebuilt(o, f, marks)) for o, f in zip(outputs, forms)]}, dtype=object)

    return digest(output, form)
