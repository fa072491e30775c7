"""Benchmark decontamination with a distributed positional inverted index.

The index is built once from the training documents and holds every posting: a
segment's row has, for each term of a bounded block of documents in term order,
the term's positions over the block's words.  It is a written table that any
number of benchmarks can query.  Documents of a segment are ``GAP`` positions
apart, so no window crosses from one to the next.

A query takes the global counts of its terms from the index and, in each
segment, intersects every window's position lists, each shifted by the term's
offset, from the rarest term on; only windows whose rarest term occurs in the segment are
looked at.  What is left after all lists are exact phrase matches.  With ``slop``
above 0 a term may stand that many words off its place, which gives proximity
matches too; an exact match is one of them.

The benchmark is the stated query set: its windows go to the tasks in slices of
at most ``SLICE_WORDS`` words (or one item, if it is longer), which all read the same index.

Nulls: a null text has no words; items without words or without an item_id are
no items.  Items with the same id are one item.  Null doc_ids and repeated rows are
reported row by row.  Texts are read whole, long ones piece by piece; a task holds the
positions of ``SEGMENT_CHARS`` characters, or of one text if it is longer, and the JVM a few
segments (``GROUP_BYTES``), however many of them a task writes or reads.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from .common import alnum_pieces, alnum_words, blocks, stored, text_rows

#: Words of the benchmark that are sent to the tasks at a time.
SLICE_WORDS = 500_000
#: Characters of text in a segment.
SEGMENT_CHARS = 4_000_000
#: Bytes of segments that a file of the index keeps together; writers and readers hold so much of it at a time.
GROUP_BYTES = 8_000_000
#: Positions between two documents of a segment; slop may be a quarter of it.
GAP = 64

_SEGMENT = T.StructType([T.StructField(n, t) for n, t in (("segment", T.LongType()), ("doc_ids", T.ArrayType(T.LongType())), ("doc_words", T.ArrayType(T.LongType())), ("terms", T.ArrayType(T.BinaryType())), ("counts", T.ArrayType(T.IntegerType())), ("postings", T.BinaryType()))])
_HITS = T.StructType([T.StructField(n, t) for n, t in (("segment", T.LongType()), ("place", T.IntegerType()), ("begins", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType())), ("near_items", T.ArrayType(T.StringType())))])


def slices(benchmark: DataFrame, *, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's (item, words), in slices of bounded size that are read one after the other."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    part, n = [], 0
    for item, text in rows.toLocalIterator():
        words = alnum_words(text)
        if words:
            part.append((item, words))
            n += len(words)
        if n >= SLICE_WORDS:
            yield part
            part, n = [], 0
    if part:
        yield part


def segment_of(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Words of each text, terms in order, their counts, and differences of their positions, term by term."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes, found, at, begin = np.zeros(len(texts), np.int64), [], [], 0
    for k, t in enumerate(texts):
        for words in alnum_pieces(t):
            found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            at.append(np.arange(begin, begin + len(words), dtype="<u4"))
            begin += len(words)
            sizes[k] += len(words)
        begin += GAP
    terms = sorted(number)
    rank = np.empty(len(terms), np.int32)
    rank[np.fromiter(map(number.__getitem__, terms), np.int32, len(terms))] = np.arange(len(terms))
    flat = rank[np.concatenate(found)] if found else np.zeros(0, np.int32)
    order = np.argsort(flat, kind="stable")
    positions = np.concatenate(at)[order] if at else np.zeros(0, "<u4")
    counts = np.bincount(flat, minlength=len(terms))
    steps = np.diff(positions, prepend=np.uint32(0))
    firsts = (np.cumsum(counts) - counts).astype(np.int64)
    steps[firsts] = positions[firsts]
    return sizes, terms, counts, steps


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments' rows; a segment's number is its partition and its place in it."""
    arrow = to_arrow_schema(_SEGMENT)

    def run(batches):
        segment = TaskContext.get().partitionId() << 32
        for ids, texts in blocks(batches, SEGMENT_CHARS):
            sizes, terms, counts, steps = segment_of(texts)
            row = (segment, ids, sizes, terms, counts, steps.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)
            segment += 1

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(run, _SEGMENT)


def shifted(lists: list[tuple[np.ndarray, int]], slop: int) -> np.ndarray:
    """Starts at which every list has a position within slop of start + offset; lists are (positions, offset), rarest first."""
    positions, offset = lists[0]
    starts = np.unique((positions - offset)[:, None] + np.arange(-slop, slop + 1)) if slop else positions - offset
    for positions, offset in lists[1:]:
        want = starts + offset - slop
        at = np.searchsorted(positions, want)
        inside = at < len(positions)
        starts = starts[inside][positions[at[inside]] <= want[inside] + 2 * slop]
        if not len(starts):
            break
    return starts


def term_counts(segments: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How often each of the terms occurs in all segments; no more rows than terms reach the driver."""
    sent = segments.sparkSession.sparkContext.broadcast(sorted(set(terms)))

    def run(batches):
        wanted = pa.array(sent.value, pa.binary())
        for batch in batches:
            listed, counts = batch.column(0).flatten(), batch.column(1).flatten()
            met = pc.is_in(listed, value_set=wanted)
            yield pa.RecordBatch.from_arrays([listed.filter(met), counts.filter(met).cast(pa.int64())], names=["term", "n"])

    counted = segments.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(t): n for t, n in counted}


def planned(items: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], window: int) -> tuple[list[bytes], dict[int, list[tuple[list[int], list[int], list[str]]]]]:
    """The slice's terms, and by its rarest term each window: term numbers, offsets from the rarest on, and items.

    Windows are all runs of ``window`` words, or a shorter item whole.  Terms that occur nowhere rule a window out.
    """
    terms = sorted({w for _, words in items for w in words if w in frequency})
    number = {t: k for k, t in enumerate(terms)}
    often = np.array([frequency[t] for t in terms], np.int64)
    of: dict[bytes, list[str]] = {}
    for item, words in items:
        ids = np.array([number.get(w, -1) for w in words], np.int32)
        for i in range(max(1, len(ids) - window + 1)):
            part = ids[i : i + window]
            if part.min() >= 0:
                of.setdefault(part.tobytes(), []).append(item)
    by_rarest: dict[int, list[tuple[list[int], list[int], list[str]]]] = {}
    for raw, names in of.items():
        ids = np.frombuffer(raw, np.int32)
        order = np.argsort(often[ids], kind="stable")
        by_rarest.setdefault(int(ids[order[0]]), []).append((ids.tolist(), order.tolist(), sorted(set(names))))
    return terms, by_rarest


def query(segments: DataFrame, items: list[tuple[str, list[bytes]]], *, window: int, slop: int) -> DataFrame:
    """A row per document with a match: spans of exact window matches, the items they come from, and items with proximity matches."""
    if slop > GAP // 4:
        raise ValueError(f"a slop of at most {GAP // 4}")
    frequency = term_counts(segments, [w for _, words in items for w in words])
    sent = segments.sparkSession.sparkContext.broadcast(planned(items, frequency, window))
    arrow = to_arrow_schema(_HITS)

    def matches(row: pa.RecordBatch, terms: pa.Array, by_rarest: dict) -> tuple[dict, dict, dict]:
        cut = np.concatenate(([0], np.cumsum(row.column("counts").flatten().to_numpy(), dtype=np.int64)))
        steps = np.frombuffer(row.column("postings")[0].as_buffer(), "<u4")
        numbers = pc.fill_null(pc.index_in(row.column("terms").flatten(), value_set=terms), -1).to_numpy()
        at = np.flatnonzero(numbers >= 0)
        place = dict(zip(numbers[at].tolist(), at.tolist()))
        lists: dict[int, np.ndarray] = {}

        def positions(term: int) -> np.ndarray:
            if term not in lists:
                lists[term] = np.cumsum(steps[cut[place[term]] : cut[place[term] + 1]], dtype=np.int64)
            return lists[term]

        sizes = row.column("doc_words").flatten().to_numpy()
        ends = np.cumsum(sizes + GAP) - GAP
        spans: dict[int, list[tuple[int, int]]] = {}
        exact: dict[int, set[str]] = {}
        near: dict[int, set[str]] = {}
        for rarest in place.keys() & by_rarest.keys():
            for ids, order, names in by_rarest[rarest]:
                if any(t not in place for t in ids):
                    continue
                shifts = [(positions(ids[k]), k) for k in order]
                # an exact match is a proximity match, so without one of these there is none of those
                close = shifted(shifts, slop)
                for starts, into in ((shifted(shifts, 0) if slop and len(close) else close, exact), (close if slop else (), near)):
                    if not len(starts):
                        continue
                    # the rarest term stands near its place, so within half a gap of its document
                    docs = np.searchsorted(ends + GAP // 2, starts + order[0], side="right")
                    for s, d in zip(starts.tolist(), docs.tolist()):
                        into.setdefault(d, set()).update(names)
                        if into is exact:
                            begin = s - int(ends[d] - sizes[d])
                            spans.setdefault(d, []).append((begin, begin + len(ids)))
        return spans, exact, near

    def run(batches):
        terms, by_rarest = sent.value
        terms = pa.array(terms, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                spans, exact, near = matches(row, terms, by_rarest)
                hit = sorted(exact.keys() | near.keys())
                merged = [_union(spans.get(d, [])) for d in hit]
                columns = ([row.column("segment")[0].as_py()] * len(hit), hit, [[a for a, _ in m] for m in merged], [[b for _, b in m] for m in merged], [sorted(exact.get(d, ())) for d in hit], [sorted(near.get(d, ()) if slop else exact.get(d, ())) for d in hit])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return segments.mapInArrow(run, _HITS)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def matched(segments: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, begins, ends, items, near_items) of every document of a written index.

    Spans count words from 0, ends are exclusive.
    """
    found = segments.sparkSession.createDataFrame([], _HITS)
    several = 0
    for several, items in enumerate(slices(benchmark, item_col=item_col, text_col=item_text_col), 1):
        rows = query(segments, items, window=window, slop=slop)
        found = rows if several == 1 else found.unionAll(rows)
    if several > 1:
        gather = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("segment", "place").agg(gather("begins"), gather("ends"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")])

        @F.pandas_udf("struct<begins:array<long>,ends:array<long>>")
        def union(begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
            m = [_union(list(zip(a.tolist(), b.tolist()))) for a, b in zip(begins, ends)]
            return pd.DataFrame({"begins": [[a for a, _ in x] for x in m], "ends": [[b for _, b in x] for x in m]})

        found = found.withColumn("u", union("begins", "ends")).select("segment", "place", "u.begins", "u.ends", "items", "near_items")
    docs = segments.select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("place", "d")).select("segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").alias("n_words"))
    none = F.expr("cast(array() as array<bigint>)")
    out = docs.join(found, ["segment", "place"], "left").withColumns({c: F.coalesce(c, none) for c in ("begins", "ends")}).withColumns({c: F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in ("items", "near_items")})
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_words", (total(F.col("ends")) - total(F.col("begins"))).alias("n_hit"), "begins", "ends", "items", "near_items")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 0) -> DataFrame:
    """Indexes the documents and queries the index: see ``matched``."""
    return matched(stored(index(docs, id_col=id_col, text_col=text_col), group_bytes=GROUP_BYTES), benchmark, item_col=item_col, item_text_col=item_text_col, window=window, slop=slop)
