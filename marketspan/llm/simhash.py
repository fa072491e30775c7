"""SimHash near-duplicates, found by the general pigeonhole principle.

Fingerprints of 64 bits link at a Hamming distance of at most ``distance``.
The bits are grouped into partitions so that correlated bits stay together,
and each partition gets a threshold of its own: if the thresholds of m
partitions add up to distance - m + 1, every linked pair is within the
threshold of at least one partition.  Dynamic programming picks the thresholds
with the least estimated cost; the estimates are collision counts of all
distinct fingerprints.  Each fingerprint is listed under its value of a
partition and probes the values within the threshold; candidates are verified
over all 64 bits.  Equal fingerprints are one node, so copies cost nothing, and
crowded values are compared block by block, so no task gets an unbounded
group.  A group yields only a spanning forest of its links.

Nulls: a null text has no words and the fingerprint zero, as an empty text has.
Rows without words link like all others.  Rows with a null doc_id count, but
never name a component; ties and repeated rows share a fingerprint and so a component.
Texts are read whole; a task holds the words and shingle hashes of about a million
characters at a time, or of one text if it is longer.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_batch, connected_components, spaced_words, stored, text_rows

#: Rows of a block of a crowded value.
BLOCK_ROWS = 1024
#: Cost of verifying a candidate, against that of a probe row.
VERIFY_COST = 0.02
#: Bits that a probe may flip at most.
MOST_FLIPS = 2


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """A bit is set if it is set in over half the XXH64 values of the shingles, repeats included."""
    return majority(shingle_values(text, shingle, seed))


def shingle_values(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 value of each shingle in order, repeats included."""
    words = spaced_words(text.translate(_LOWER) if text else None)
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    begins = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], seed) for i, j in zip(begins, ends)), "<u8", n)


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half the values; zero without values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        ones += np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little", signed=True)


_LOWER = {c: c + 32 for c in range(65, 91)}
_FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed long."""

    def made(ids, texts):
        return {"doc_id": ids, "fp": [fingerprint(t, shingle) for t in texts]}

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(by_batch(made, _FINGERPRINTS), _FINGERPRINTS)


def bit_groups(fps: DataFrame, m: int, together: np.ndarray) -> list[list[int]]:
    """64 bits in m groups of nearly equal size; each grows by the bit most correlated with it."""
    free, groups = list(range(64)), []
    for k in range(m):
        room = (64 - sum(map(len, groups)) + m - k - 1) // (m - k)
        pairs = [(together[i, j], -i, -j) for i in free for j in free if i < j]
        group = [-x for x in max(pairs)[1:]] if pairs and room > 1 else free[:1]
        while len(group) < room:
            group.append(max((b for b in free if b not in group), key=lambda b: (together[b, group].mean(), -b)))
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def correlations(fps: DataFrame) -> np.ndarray:
    """|correlation| of each pair of bits over all fingerprints, from 64 x 64 counts summed by Spark."""
    schema = "i int, j int, c long"

    def count(frames):
        both, n = np.zeros((64, 64)), 0
        for x in frames:
            for at in range(0, len(x), 65536):
                bits = np.unpackbits(x["fp"].to_numpy("<i8")[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        i, j = np.divmod(np.arange(4096), 64)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "c": np.append(both.ravel(), n).astype(np.int64)})

    rows = fps.select("fp").mapInPandas(count, schema).groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((64, 64)), 1
    for i, j, c in rows:
        if i < 0:
            n = max(1, c)
        else:
            both[i, j] = c
    p = both.diagonal() / n
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    return np.abs(both / n - np.outer(p, p)) / spread


def part_value(fp: Column, bits: list[int]) -> Column:
    """The bits of one group, packed; runs of neighbouring bits move together."""
    out, k = None, 0
    while k < len(bits):
        run = 1
        while k + run < len(bits) and bits[k + run] == bits[k] + run:
            run += 1
        piece = F.shiftleft(F.shiftrightunsigned(fp, bits[k]).bitwiseAND(F.lit((1 << run) - 1).cast("long")), k)
        out = piece if out is None else out.bitwiseOR(piece)
        k += run
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 that add up to total, of least cost; costs[i][t + 1] is that of partition i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    return best.get(total, (float("inf"), []))


def plan(fps: DataFrame, distance: int, parts: tuple[int, ...] = (2, 3, 4, 5)) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds with the least estimated cost over all fingerprints."""
    together = correlations(fps)
    groups = {m: bit_groups(fps, m, together) for m in parts}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), part_value(F.col("fp"), bits).alias("key")) for m in parts for k, bits in enumerate(groups[m])]
    counted = fps.select(F.explode(F.array(*keys)).alias("x")).groupBy("x.m", "x.k", "x.key").count()
    sums = {(m, k): (n, c) for m, k, n, c in counted.groupBy("m", "k").agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).collect()}
    best = (float("inf"), parts[-1], [])
    for m in parts:
        costs = []
        for k, bits in enumerate(groups[m]):
            n, pairs = sums.get((m, k), (0, 0.0))
            near = [sum(comb(len(bits), f) for f in range(t + 1)) for t in range(MOST_FLIPS + 1)]
            costs.append([0.0] + [x * (n + VERIFY_COST * pairs) for x in near])
        cost, ts = allocate(costs, distance - m + 1)
        if ts and cost < best[0]:
            best = (cost, m, ts)
    if not best[2]:
        raise ValueError(f"no thresholds for a distance of {distance}")
    return groups[best[1]], best[2]


def _forest(n_index: int, fp: np.ndarray, check: np.ndarray, distance: int, check_distance: int) -> list[tuple[int, int]]:
    """A minimum spanning forest (by check distance) of the links of the first n_index values to all, as positions."""
    from_, to, weight = [], [], []
    for i in range(n_index):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance)
        if len(near):
            w = np.bitwise_count(check[near] ^ check[i])
            near, w = near[w <= check_distance], w[w <= check_distance]
            from_.append(np.full(len(near), i))
            to.append(near)
            weight.append(w)
    if not from_:
        return []
    from_, to, weight = np.concatenate(from_), np.concatenate(to), np.concatenate(weight)
    edges = []
    if len(to) <= 20 * len(fp):
        above = list(range(len(fp)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for k in np.argsort(weight, kind="stable").tolist():
            i, j = top(int(from_[k])), top(int(to[k]))
            if i != j:
                above[j] = i
                edges.append((int(from_[k]), int(to[k])))
        return edges
    # a dense group: Prim's algorithm, one row of distances at a time
    far = 255
    unseen, best, parent = np.ones(len(fp), bool), np.full(len(fp), far, np.uint8), np.full(len(fp), -1)
    for _ in range(len(fp)):
        u = int(np.where(unseen, best, far).argmin())
        if not unseen[u]:
            u = int(unseen.argmax())
        unseen[u] = False
        if parent[u] >= 0:
            edges.append((int(parent[u]), u))
        w = np.bitwise_count(check ^ check[u])
        closer = unseen & (w <= check_distance) & (w < best) & (np.bitwise_count(fp ^ fp[u]) <= distance)
        best[closer], parent[closer] = w[closer], u
    return edges


def _probes(key: Column, masks: list[int], k: int) -> Column:
    """Probe rows of a value; of two values that differ, the smaller one probes."""
    # Spark counts a lambda's parameters with a default too and would pass the index for them
    flips = F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: key.bitwiseXOR(x))
    return F.transform(F.filter(flips, lambda x: x > key), lambda x: F.struct(F.lit(k).alias("k"), x.alias("key"), F.lit(True).alias("probe")))


def dealt_rows(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(k, key, at, probe, x): what meets under a value of a partition, crowded values in blocks.

    Probes of a crowded value that no fingerprint is listed under meet nothing and are left out.
    """
    rows = []
    for k, (bits, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        key = part_value(F.col("fp"), bits)
        rows.append(F.array(F.struct(F.lit(k).alias("k"), key.alias("key"), F.lit(False).alias("probe"))))
        if t:
            masks = [1 << i for i in range(len(bits))] + [1 << i | 1 << j for i in range(len(bits)) for j in range(i) if t > 1]
            rows.append(_probes(key, masks, k))
    listed = fps.select("node", "fp", "check", F.explode(F.concat(*rows)).alias("x")).select("node", "fp", "check", "x.*")
    blocks = [F.ceil(F.sum(F.when(kind, 1).otherwise(0)) / F.lit(BLOCK_ROWS)).cast("int") for kind in (~F.col("probe"), F.col("probe"))]
    crowded = listed.groupBy("k", "key").agg(blocks[0].alias("ni"), blocks[1].alias("np")).where("ni > 1 or np > 1")
    dealt = listed.join(stored(crowded), ["k", "key"], "left").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.when(F.col("probe"), F.col("np")).otherwise(F.col("ni")))))
    at = F.expr("""case when ni is null then array(0L)
        when ni = 0 then cast(array() as array<bigint>)
        when probe then transform(sequence(0L, ni - 1L), i -> 1L + ni * ni + i * np + block)
        when np > 0 then concat(transform(sequence(0L, ni - 1L), j -> 1L + least(block, j) * ni + greatest(block, j)), transform(sequence(0L, np - 1L), p -> 1L + ni * ni + block * np + p))
        else transform(sequence(0L, ni - 1L), j -> 1L + least(block, j) * ni + greatest(block, j)) end""")
    return dealt.select("k", "key", F.explode(at).alias("at"), "probe", F.struct("fp", "check", "node").alias("x"))


def links(fps: DataFrame, distance: int, groups: list[list[int]], thresholds: list[int], check_distance: int | None = None) -> DataFrame:
    """(a, b): nodes within the distance; every linked pair is connected by these edges.

    fps has a row per node: node, fp and check, a second fingerprint that must
    be within check_distance (by default that of fp).
    """
    # sorted, so that a forest doesn't depend on the order in which rows arrive
    met = dealt_rows(fps, groups, thresholds).groupBy("k", "key", "at")
    met = met.agg(F.array_sort(F.collect_list(F.when(~F.col("probe"), F.col("x")))).alias("i"), F.array_sort(F.collect_list(F.when(F.col("probe"), F.col("x")))).alias("p"))
    met = met.where((F.size("i") > 1) | (F.size("i") > 0) & (F.size("p") > 0)).select(F.size("i").alias("n"), F.concat("i", "p").alias("x"))
    most = distance if check_distance is None else check_distance

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def verified(n: pd.Series, fp: pd.Series, check: pd.Series, node: pd.Series) -> pd.Series:
        found = []
        for k, f, c, names in zip(n, fp, check, node):
            f, c = (np.ascontiguousarray(x, np.int64).view(np.uint64) for x in (f, c))
            found.append([{"a": int(names[i]), "b": int(names[j])} for i, j in _forest(k, f, c, distance, most)])
        return pd.Series(found)

    return met.select(F.explode(verified("n", "x.fp", "x.check", "x.node")).alias("e")).select("e.*").distinct()


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_size) for each row: the smallest doc_id reachable over links, itself included."""
    each = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    fps = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    nodes = fps.select(F.col("fp").alias("node"), "fp", F.col("fp").alias("check"))
    found = connected_components(links(nodes, distance, *plan(fps, distance)))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("component_size"))
    of_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "component_size")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(of_fp, "fp").select("doc_id", text.alias("fingerprint"), "component_id", "component_size")
