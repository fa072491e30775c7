"""Near duplicates on word shingles, by the general pigeonhole search of ``simhash``.

At a Jaccard similarity of 0.8 two SimHash fingerprints of 64 bits differ in
about 10 bits and in up to 20, far too many to probe for.  So the search runs
over fingerprints of 64 symbols: symbol k is 16 bits of the smallest shingle hash
in the k-th of 64 orders, and two texts agree in a symbol with a probability of their
Jaccard similarity.  The rest is as for bits: positions that are correlated
over all texts are grouped together, dynamic programming over measured collision
counts gives each group its threshold (groups with the costliest values get -1
and aren't looked at, the others 0), texts meet under their group values, and
candidates are verified, first over all 64 symbols, then over their shingle sets.

Within ``distance`` differing symbols a pair surely meets.  At a similarity of
0.8 a pair differs in 12.8 symbols on average, and because a pair meets if any
of the 17 groups agrees, it is missed with a probability under 0.001.  Verified
links are exact.

Crowded group values: members are compared with some pivots of the value,
which joins large families at once.  Those that the pivots don't join to the
value's largest family meet all its members, in pairs of blocks, so that every pair that
agrees in enough symbols is connected.  A family only says which texts are compared
exactly: in blocks, all with the first block, then those outside the family's
largest group with all others.

Nulls: a null text has no words, and texts without words form one group.  Rows
with a null doc_id are documents too, and stand after all others in their group.
Repeated rows, and rows of one doc_id with several texts, are told apart by
``text_hash``.  Texts are read whole; a task holds the shingles of about a million
characters at a time, or of one text if it is longer.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import blocks, connected_components, discard, spaced_words, stored
from .simhash import _LOWER, allocate, bit_groups, correlations

SYMBOLS = 64
#: Members of a group value from which it counts as crowded, and pivots of a crowded one.
CROWDED, PIVOTS = 256, 32
#: Sets, and shingles in them, of a block of a large family.
SET_ROWS, SET_SHINGLES = 512, 4_000_000
#: Members of a block of a crowded value.
MEMBER_ROWS = 1024
#: Words whose hashes a task remembers.
CACHE_WORDS = 200_000
#: A key with more than this share of all rows is joined by a broadcast of at most 1 / HOT_SHARE keys.
HOT_SHARE = 0.001
VERIFY_COST = 0.02
#: Bits of a filter that says which rows may be among some keys; its size doesn't grow with the data.
FILTER_BITS = 1 << 27
_ORDERS = (np.random.default_rng(64).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, each made when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes; words are hashed once."""

    def __init__(self, size: int):
        self.size, self.known = size, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = spaced_words(text.translate(_LOWER) if text else None)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out = h[: max(1, len(h) - self.size + 1)]
        for k in range(1, min(self.size, len(h))):
            out = (out ^ (out >> np.uint64(32))) * _MIX + h[k : k + len(out)]
        out = (out ^ (out >> np.uint64(29))) * _MIX
        return np.unique(out ^ (out >> np.uint64(32)))


def sketch(values: np.ndarray) -> bytes:
    """The 64 symbols of a set of hashes, 16 bits each; zeros for an empty set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 1024):
        np.minimum(least, (values[None, at : at + 1024] * _ORDERS[:, None]).min(1), out=least)
    return least.astype("<u2").tobytes() if len(values) else bytes(2 * SYMBOLS)


def set_digest(values: np.ndarray) -> bytes:
    """128 bits that stand for a set of values, sorted and distinct."""
    return xxhash.xxh3_128_digest(values.tobytes())


def last_bits(symbols: bytes) -> int:
    """The last bit of each symbol, as a signed long that stands for the fingerprint in correlations."""
    return int.from_bytes(np.packbits(np.frombuffer(symbols, "<u2") & 1, bitorder="little").tobytes(), "little", signed=True)


_SETS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text_hash", T.LongType()), ("same", T.BinaryType()), ("v", T.LongType()), ("n", T.LongType()), ("sketch", T.BinaryType()), ("bits", T.LongType()))])
_SHINGLES = T.StructType([T.StructField("same", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
_EDGES = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])


def text_hash(text_col: str = "text"):
    """What tells the texts of one doc_id apart."""
    return F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0).cast("long"))


def _keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(F.col(id_col).cast("long").alias("i"), text_hash(text_col).alias("h")).alias("key"), F.col(text_col).cast("string").alias("text"))


def described(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """A row per row: its set's digest, ``v`` (64 bits of it), size and symbols."""
    arrow = to_arrow_schema(_SETS)

    def run(batches):
        sets = Shingler(shingle)
        for keys, texts in blocks(batches):
            found = [sets(t) for t in texts]
            same = [set_digest(x) for x in found]
            made = [sketch(x) for x in found]
            columns = ([k["i"] for k in keys], [k["h"] for k in keys], same, [int.from_bytes(d[:8], "little", signed=True) for d in same], [len(x) for x in found], made, [last_bits(x) for x in made])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return _keyed_rows(docs, id_col, text_col).mapInArrow(run, _SETS)


class KeyFilter:
    """A bitmap of fixed size over (doc_id, text_hash) keys, made by Spark and sent to the tasks.

    A key that isn't in it is none of the keys; one that is may be one.  So rows
    with a text need to be moved only where the bitmap says maybe; the more
    keys there are for its size, the more rows that is, and no result depends on it.
    """

    def __init__(self, keys: DataFrame):
        # Spark's bitmaps count from 1
        at = F.pmod(self.hashed(F.col("doc_id"), F.col("text_hash")), F.lit(FILTER_BITS)) + 1
        rows = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        bits = bytearray(FILTER_BITS // 8)
        for bucket, part in rows.toLocalIterator():  # at most FILTER_BITS / 32768 rows of 4 KB
            begin = (bucket - 1) * 4096
            for k, x in enumerate(part[: max(0, len(bits) - begin)]):
                if x:
                    bits[begin + k] |= x
        self.bits = keys.sparkSession.sparkContext.broadcast(bytes(bits))

    @staticmethod
    def hashed(doc_id, digest):
        return F.xxhash64(doc_id, digest)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % FILTER_BITS
        return np.frombuffer(self.bits.value, np.uint8)[at >> 3] >> (at & 7) & 1 == 1

    def column(self, doc_id, digest):
        """Whether a row may be among the keys; only the hashes go to Python."""

        @F.pandas_udf("boolean")
        def maybe(x: pd.Series) -> pd.Series:
            return pd.Series(self.has(x.to_numpy()))

        return maybe(self.hashed(doc_id, digest))


def hot_join(rows: DataFrame, counts: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of counts, which has a row per key with ``count``: how many rows have it.

    Keys with over HOT_SHARE of all rows, at most 1 / HOT_SHARE of them, are
    broadcast, so no task gets a larger share of the rows than that by its key.
    """
    hot = F.col("count") > max(CROWDED, total * HOT_SHARE)
    few = F.broadcast(counts.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(counts.where(~hot), key)
    return rows.join(few, key).select(rest.columns).unionAll(rest)


def _fold(label: np.ndarray, i: int, j: int) -> bool:
    """Joins two labels; whether they differed."""
    if label[i] == label[j]:
        return False
    label[label == label[j]] = label[i]
    return True


def _within(lists: DataFrame, symbols: DataFrame, agree: int) -> DataFrame:
    """Links that connect all pairs of a list that agree in enough symbols; lists: (vs), of at most CROWDED members."""

    named = lists.distinct().select(F.xxhash64("vs").alias("list"), F.explode("vs").alias("v"))
    met = named.join(symbols, "v").groupBy("list").agg(F.array_sort(F.collect_list(F.struct("v", "sketch"))).alias("x")).select("x.v", "x.sketch")
    arrow = to_arrow_schema(_EDGES)

    def run(batches):
        for batch in batches:
            edges = []
            for names, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.frombuffer(b"".join(raw), "<u2").reshape(-1, SYMBOLS)
                label = np.arange(len(s))
                for i in range(len(s) - 1):
                    for j in (i + 1 + np.flatnonzero((s[i + 1 :] == s[i]).sum(1) >= agree)).tolist():
                        if _fold(label, i, j):
                            edges.append((names[i], names[j]))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=arrow)

    return met.mapInArrow(run, _EDGES)


def _pivots(names: list[int], raw: list[bytes], agree: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Pivots' names, their symbols, and which of them are connected."""
    symbols = np.frombuffer(b"".join(raw), "<u2").reshape(-1, SYMBOLS)
    label = np.arange(len(names))
    for i in range(len(names)):
        for j in (i + 1 + np.flatnonzero((symbols[i + 1 :] == symbols[i]).sum(1) >= agree)).tolist():
            _fold(label, i, j)
    return names, symbols, label


_TESTED = T.StructType([T.StructField(n, t) for n, t in (("key", T.LongType()), ("v", T.LongType()), ("sketch", T.BinaryType()), ("near", T.ArrayType(T.LongType())), ("homes", T.ArrayType(T.LongType())))])


def _against_pivots(crowd: DataFrame, counted: DataFrame, symbols: DataFrame, total: int, agree: int) -> DataFrame:
    """Each member of a crowded value with the pivots that it is to be linked to, and the groups of connected pivots that it belongs to.

    Pivots are linked to each other where they are close.  A member is linked
    to one pivot of each group of pivots that is so connected; ``homes`` names each by one of its pivots.
    """
    chosen = crowd.where((F.pmod(F.xxhash64("v", "key"), F.greatest(F.lit(1), F.floor(F.col("count") / PIVOTS))) == 0)).select("key", "v")
    chosen = chosen.join(symbols, "v").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("v", "sketch"))).alias("pivots"))
    members = crowd.select("key", "v").join(symbols, "v")
    met = hot_join(members, counted.join(chosen, "key", "left"), "key", total).select("key", "v", "sketch", F.col("pivots.v").alias("p"), F.col("pivots.sketch").alias("ps"))
    arrow = to_arrow_schema(_TESTED)

    def run(batches):
        for batch in batches:
            known: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                links, homes = [], []
                for value, name, raw, names, theirs in zip(*(part.column(c).to_pylist() for c in ("key", "v", "sketch", "p", "ps"))):
                    if value not in known:
                        known[value] = _pivots(names or [], theirs or [], agree)
                    names, symbols, label = known[value]
                    same = (symbols == np.frombuffer(raw, "<u2")).sum(1)
                    own = name in names
                    order = np.argsort(-same, kind="stable")
                    close = order[same[order] >= agree].tolist()
                    homes.append(sorted({names[label[k]] for k in close}))
                    if not own:
                        close = list({int(label[k]): k for k in reversed(close)}.values())
                    links.append([names[k] for k in close if names[k] != name])
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("v"), part.column("sketch"), pa.array(links, arrow.field("near").type), pa.array(homes, arrow.field("homes").type)], schema=arrow)

    return met.mapInArrow(run, _TESTED)


def _beside_pivots(tested: DataFrame, counted: DataFrame, total: int, agree: int) -> DataFrame:
    """Links that connect all pairs of a crowded value that agree in enough symbols, as far as pivots don't.

    Members of the group of pivots with the most members are connected already;
    all others meet all members of their value, in pairs of blocks.
    """
    each = tested.select("key", F.explode("homes").alias("home")).groupBy("key", "home").count()
    main = each.groupBy("key").agg(F.max_by("home", F.struct("count", "home")).alias("main"))
    known = hot_join(tested.select("key", "v", "sketch", "homes"), counted.join(main, "key", "left"), "key", total)
    marked = stored(known.select("key", "v", "sketch", "count", (~F.coalesce(F.array_contains("homes", F.col("main")), F.lit(False))).alias("out")))
    number = lambda n: F.ceil(n / F.lit(MEMBER_ROWS)).cast("int")
    outs = stored(marked.where("out").groupBy("key").agg(number(F.count("*")).alias("outs"), number(F.max("count")).alias("blocks"), F.max("count").alias("count")))
    rows = hot_join(marked.drop("count"), outs, "key", total)
    place = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    mine = rows.where("out").withColumn("p", place(F.col("outs"))).select("key", "v", "sketch", F.lit(0).alias("side"), "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"))
    theirs = rows.withColumn("q", place(F.col("blocks"))).select("key", "v", "sketch", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("p"), "q")
    arrow = to_arrow_schema(_EDGES)

    def run(batches):
        key, held = None, ([], [])

        def table():
            edges = _across(*held, agree)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=arrow)

        for batch in batches:
            for *now, side, name, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q", "side", "v", "sketch"))):
                if now != key:
                    if held[0]:
                        yield table()
                    key, held = now, ([], [])
                held[side].append((name, raw))
        yield table()

    met = mine.unionByName(theirs).select("key", "p", "q", "side", "v", "sketch")
    return met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side", "v").mapInArrow(run, _EDGES)


def _across(mine: list[tuple[int, bytes]], theirs: list[tuple[int, bytes]], agree: int) -> list[tuple[int, int]]:
    """Links that connect all pairs of one row of each list that agree in enough symbols."""
    if not mine or not theirs:
        return []
    symbols = np.frombuffer(b"".join(raw for _, raw in theirs), "<u2").reshape(-1, SYMBOLS)
    place = {name: k for k, name in enumerate(dict.fromkeys(name for name, _ in [*mine, *theirs]))}
    label, at = np.arange(len(place)), np.array([place[name] for name, _ in theirs])
    edges = []
    for name, raw in mine:
        i = place[name]
        near = ((symbols == np.frombuffer(raw, "<u2")).sum(1) >= agree) & (label[at] != label[i])
        for k in np.flatnonzero(near).tolist():
            if _fold(label, i, at[k]):
                edges.append((name, theirs[k][0]))
    return edges


def candidate_links(symbols: DataFrame, groups: list[list[int]], *, agree: int) -> DataFrame:
    """(a, b): links that connect all candidates, nodes that share a group's symbols and agree in enough; symbols: (v, sketch)."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.concat(*[F.substring("sketch", 2 * i + 1, 2) for i in g])) for k, g in enumerate(groups)])
    rows = symbols.select("v", F.explode(keys).alias("key"))
    counts = stored(rows.groupBy("key").count().where("count > 1"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    met = stored(hot_join(rows, counts, "key", total).select("key", "v", "count"))
    lists = met.where(F.col("count") <= CROWDED).groupBy("key").agg(F.array_sort(F.collect_list("v")).alias("vs")).select("vs")
    out = stored(_within(lists, symbols, agree))
    crowd = met.where(F.col("count") > CROWDED)
    if not crowd.isEmpty():
        crowded = counts.where(F.col("count") > CROWDED)
        tested = stored(_against_pivots(crowd, crowded, symbols, total, agree))
        out = out.unionAll(tested.select(F.explode("near").alias("a"), F.col("v").alias("b"))).unionAll(stored(_beside_pivots(tested, crowded, total, agree)))
    discard(counts, met)
    return out.where("a <> b").distinct()


def chosen_groups(symbols: DataFrame, parts: int, distance: int) -> list[list[int]]:
    """Groups of correlated positions that dynamic programming lets texts meet by; the others' threshold is -1."""
    groups = bit_groups(symbols, parts, correlations(symbols.select(F.col("bits").alias("fp"))))
    keys = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.concat(*[F.substring("sketch", 2 * i + 1, 2) for i in g])).alias("key")) for k, g in enumerate(groups)]
    counted = symbols.select(F.explode(F.array(*keys)).alias("x")).groupBy("x.k", "x.key").count()
    sums = {k: (n, pairs) for k, n, pairs in counted.groupBy("k").agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).collect()}
    costs = [[0.0, n + VERIFY_COST * pairs] for n, pairs in (sums.get(k, (0, 0.0)) for k in range(parts))]
    _, thresholds = allocate(costs, distance - parts + 1)
    return [g for g, t in zip(groups, thresholds) if t >= 0]


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 16, parts: int = 18) -> DataFrame:
    """(doc_id, text_hash, group_id, is_first) for each row.

    A link stands if the Jaccard similarity of the sets of shingles is at least
    ``similarity``; a group is what links connect.  group_id is its smallest
    doc_id (null if none has one), and is_first marks the row of a group that
    comes first by doc_id, then text_hash; identical rows have the same mark.
    """
    sure = SYMBOLS * similarity
    slack = sqrt(SYMBOLS * similarity * (1 - similarity))
    each = stored(described(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = stored(each.groupBy("same").agg(F.first("v").alias("v"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("count")))
    symbols = stored(nodes.where("n > 0").groupBy("v").agg(F.first("sketch").alias("sketch"), F.first("bits").alias("bits")))
    found = stored(candidate_links(symbols.drop("bits"), chosen_groups(symbols, parts, distance), agree=int(sure - 4 * slack)))
    families = connected_components(found).withColumnRenamed("node", "v").withColumnRenamed("root", "family")
    members = stored(nodes.select("same", "v", "n", "sketch", "first").join(families, "v"))
    discard(found, symbols)
    groups = similar_sets(members, docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity, agree=int(sure - 4 * slack))
    firsts = nodes.select("same", "first", "count").join(groups.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    firsts = stored(firsts)
    named = firsts.groupBy("root").agg(F.min("first").alias("group_first"))
    of_set = stored(firsts.join(named, "root").select("same", "group_first", "count"))
    discard(members, nodes, firsts)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    rows = hot_join(each.select("doc_id", "text_hash", "same"), of_set, "same", each.count())
    return rows.select("doc_id", "text_hash", F.col("group_first.doc_id").alias("group_id"), key.eqNullSafe(F.col("group_first")).alias("is_first"))


def similar_sets(members: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, shingle: int, similarity: float, agree: int) -> DataFrame:
    """(node, root) over the digests of members: components of links that hold exactly.

    members: (same, n, sketch, family, first), first with the doc_id and text_hash of a row.  First every block of a family meets
    its first block; then what lies outside a family's largest component meets
    all blocks, and pairs that links connect already are left out.
    """
    arrow = to_arrow_schema(_SHINGLES)

    # one row of each set is read again; only sets are moved, not texts
    chosen = KeyFilter(members.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")))

    def run(batches):
        sets = Shingler(shingle)
        for hashes, texts in blocks(batches):
            found = [sets(t) for t, wanted in zip(texts, chosen.has(np.array(hashes, np.int64))) if wanted]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], schema=arrow)

    rows = docs.select(KeyFilter.hashed(F.col(id_col).cast("long"), text_hash(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    # equal sets give equal bytes, so any of them will do
    hashed = stored(rows.mapInArrow(run, _SHINGLES).join(members.select("same"), "same", "left_semi").groupBy("same").agg(F.first("shingles").alias("shingles")))

    size = F.ceil(F.greatest(F.count("*") / F.lit(SET_ROWS), F.sum("n") / F.lit(SET_SHINGLES))).cast("int")
    large = stored(members.groupBy("family").agg(size.alias("blocks")).where("blocks > 1"))
    dealt = members.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("same"), "blocks").cast("int"))
    dealt = stored(dealt.join(hashed, "same"))
    whole = dealt.withColumn("label", F.col("same"))
    first = F.expr("if(block = 0, transform(sequence(0, blocks - 1), j -> struct(0 as p, j as q)), array(struct(0 as p, block as q)))")
    links = stored(compared(whole.withColumn("pair", F.explode(first)), similarity, agree))
    joined = connected_components(links)
    if large.isEmpty():
        discard(hashed, dealt)
        return joined
    # the second round: outside of the largest component of each large family
    labels = dealt.where("blocks > 1").select("same", "family").join(joined.withColumnRenamed("node", "same"), "same", "left").withColumn("label", F.coalesce("root", "same")).select("same", "family", "label")
    labels = stored(labels)
    sizes = labels.groupBy("family", "label").count().groupBy("family").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    outside = labels.join(sizes, "family").select("same", "label", (F.col("label") != F.col("main")).alias("out"))
    rows = dealt.where("blocks > 1").join(outside, "same")
    number = F.ceil(F.greatest(F.count("*") / F.lit(SET_ROWS), F.sum("n") / F.lit(SET_SHINGLES))).cast("int")
    outs = stored(rows.where("out").groupBy("family").agg(number.alias("outs")))
    rows = rows.join(outs, "family").withColumn("place", F.pmod(F.xxhash64("same"), "outs").cast("int"))
    mine = rows.where("out").withColumn("pair", F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(place as p, j as q))"))).withColumn("block", F.lit(-1))
    theirs = rows.withColumn("pair", F.explode(F.expr("transform(sequence(0, outs - 1), j -> struct(j as p, block as q))")))
    columns = ["family", "pair", "block", "same", "sketch", "shingles", "label"]
    more = stored(compared(mine.select(columns).unionAll(theirs.select(columns)), similarity, agree))
    discard(hashed, dealt)
    return connected_components(links.unionAll(more))


_LINKS = T.StructType([T.StructField(n, T.BinaryType()) for n in ("a", "b")])


def compared(rows: DataFrame, similarity: float, agree: int) -> DataFrame:
    """(a, b): links that connect all similar sets which meet in a pair of blocks.

    rows: (family, pair, block, same, sketch, shingles, label); a pair with
    two blocks compares only across them, and equal labels are connected already.
    """
    arrow = to_arrow_schema(_LINKS)

    def run(batches):
        key, held = None, []

        def table():
            edges = _similar(*zip(*held), similarity, agree) if held else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for *now, block, same, raw, shingles, label in zip(*(part.column(c).to_pylist() for c in ("family", "p", "q", "block", "same", "sketch", "shingles", "label"))):
                    if now != key:
                        if held:
                            yield table()
                        key, held = now, []
                    held.append((block, same, raw, np.frombuffer(shingles, np.uint64), label))
        yield table()

    met = rows.select("family", "pair.p", "pair.q", "block", "same", "sketch", "shingles", "label")
    # sorted, so that a task holds one pair of blocks at a time and gives the same links each time
    return met.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q", "block", "same").mapInArrow(run, _LINKS)


def _similar(block: tuple, same: tuple, raw: tuple, sets: tuple, labels: tuple, similarity: float, agree: int) -> list[tuple[bytes, bytes]]:
    """Links that connect all similar sets: across blocks if there are two, else within the one."""
    block, sizes = np.array(block), np.array([len(s) for s in sets])
    symbols = np.frombuffer(b"".join(raw), "<u2").reshape(-1, SYMBOLS)
    two = block.min() != block.max()
    label = np.unique(np.array(labels, object), return_inverse=True)[1]
    edges = []
    for i in range(len(sets) - 1):
        near = (label[i + 1 :] != label[i]) & ((symbols[i + 1 :] == symbols[i]).sum(1) >= agree)
        # sets of sizes so unlike can't be similar
        near &= np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i])
        if two:
            near &= block[i + 1 :] != block[i]
        for j in (i + 1 + np.flatnonzero(near)).tolist():
            if label[j] != label[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (sizes[i] + sizes[j] - common):
                    edges.append((same[i], same[j]))
                    _fold(label, i, j)
    return edges
