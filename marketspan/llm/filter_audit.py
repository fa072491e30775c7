"""How filters of a corpus interact: every order of them, replayed over every document.

Each document's failures are crossed with all orders of the filters (n! rows, at
most 720, so their broadcast has a fixed size) and with the steps of each.  A
document leaves at its first failing step; counts by part, order and step are
conditional sums that tasks combine before their one shuffle.

Copies of a text that share part and labels fail alike, except that the copy
with the smallest doc_id may pass where the others fail, so they are counted by
map-side sums before the replay and enter it as one row with a weight.  No group
of copies is gathered, no text leaves its task, and digests stand for texts.

Nulls: a null text and a null part are empty; a null doc_id is no copy of a
smaller one, nor smaller than another, and has no labels.  Rows with one doc_id
are documents of their own; of several labels of a doc_id the largest counts.  A
table without rows has no parts, and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters that may be audited at once: their orders are broadcast.
MOST_FILTERS = 6
_SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: str = "text") -> dict[str, Column]:
    """The failures that a text shows by itself: few words, few distinct words, many capitals, symbols."""
    t = F.col(text)
    words = F.array_remove(F.split(t, _SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * distinct.cast("long") < 80 * n.cast("long"), "C": 100 * capitals.cast("long") > 10 * F.length(t).cast("long"), "D": t.rlike("[#$%&*|]")}


def document_failures(docs: DataFrame, labels: DataFrame, *, failures: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, quality, toxic, one boolean per filter, n): how many documents there are for each text, part and labels.

    ``failures`` are conditions over a column ``text``; ``copies`` names the filter
    that fails a document whose text a smaller doc_id has anywhere in the table.
    """
    failures = text_failures() if failures is None else failures
    names = list(failures)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    seen = rows.select("doc_id", "part", digest, *[c.alias(k) for k, c in failures.items()]).groupBy("doc_id", "part", "digest", *names).agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = seen.join(marks, "doc_id", "left")
    if not copies:
        return found.drop("doc_id", "digest")
    same = ["part", "digest", "quality", "toxic", *names]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    # one row for each doc_id, text and part: the least struct has the smallest doc_id and its rows
    found = found.groupBy(*same).agg(first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.sum("n").alias("n"))
    # a text has one row per part and labels by now, so its window is small however many copies there are
    found = found.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    passing = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias(copies), passing.alias("n")), F.struct(F.lit(True).alias(copies), (F.col("n") - passing).alias("n")))).alias("x")
    return found.select("part", "quality", "toxic", *names, split).select("part", "quality", "toxic", *names, f"x.{copies}", "x.n").where("n > 0")


def replayed(found: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order and step, with what that step keeps and removes (see ``audit``)."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited, not {len(filters)}")
    bit = {f: 1 << k for k, f in enumerate(filters)}
    glue = "" if all(len(f) == 1 for f in filters) else ","
    plan = [(glue.join(p), [(k + 1, f, bit[f], sum(bit[x] for x in p[:k])) for k, f in enumerate(p)]) for p in permutations(filters)]
    orders = found.sparkSession.createDataFrame(plan, "filter_order string, steps array<struct<step: int, filter: string, bit: int, before: int>>")
    fails = sum((F.when(F.col(f), b).otherwise(0) for f, b in bit.items()), F.lit(0))
    weighted = found.select("part", "quality", "toxic", "n", fails.alias("fails"))
    steps = weighted.crossJoin(F.broadcast(orders)).select("part", "quality", "toxic", "n", "fails", "filter_order", F.inline("steps"))
    gone = F.col("fails").bitwiseAND(F.col("before")) != 0  # its first failure came earlier in this order
    here = F.col("fails").bitwiseAND(F.col("bit")) != 0
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~gone & ~here, "kept"),
        total(~gone & here, "removed"),
        total(gone & here, "redundant"),
        total(F.col("fails") == F.col("bit"), "unique_fails"),
        total(~gone & here & (F.col("quality") == 1), "good_lost"),
        total(~gone & here & (F.col("toxic") == 1), "toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley")
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """What each filter does at each place of each order, by part.

    kept: documents left after the step; removed: those that it removes; redundant:
    those that fail its filter but had gone; unique_fails: those that fail no other
    filter; good_lost and toxic_lost: removed ones so labelled; shapley: what its
    filter removes, summed over all orders (divided by n! its Shapley value).
    """
    failures = options.pop("failures", None) or text_failures()
    copies = options.pop("copies", "E")
    return replayed(document_failures(docs, labels, failures=failures, copies=copies, **options), [*failures, *([copies] if copies else [])])
