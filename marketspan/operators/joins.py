"""Joins beyond equality, each written as equi-joins and windows so that no plan needs nested loops."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top1_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that should be total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def _latest_open(on: list[str], columns: list[str], names: list[str]):
    """Over rows sorted by key and time, versions (``_e`` is not null) before what asks: each asking row with the version that began last of those still open.

    A version that ends before a later one is never asked for again, so the open
    ones that matter are a stack with ever earlier ends, and every row is put on it and taken off once.
    """

    def run(batches):
        before, ends, places, open_ = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in on]
            new = np.zeros(batch.num_rows, bool)
            for key in keys:
                new[1:] |= pc.fill_null(pc.not_equal(key[1:], key[:-1]), True).to_numpy(zero_copy_only=False)
            new[0] = before != [key[0].as_py() for key in keys]
            before = [key[-1].as_py() for key in keys]
            values = batch.column("_p")
            kept = 0 if open_ is None else len(open_)
            asks = batch.column("_e").is_null()
            found = []
            times, until = (pc.fill_null(batch.column(c), -(1 << 63)).to_pylist() for c in ("_t", "_e"))
            for at, (fresh, ask, t, e) in enumerate(zip(new.tolist(), asks.to_pylist(), times, until), kept):
                if fresh:
                    ends.clear()
                    places.clear()
                over = t if ask else e
                while ends and ends[-1] <= over:
                    ends.pop()
                    places.pop()
                if ask:
                    found.append(places[-1] if places else None)
                else:
                    ends.append(e)
                    places.append(at)
            values = values if open_ is None else pa.concat_arrays([open_, values])
            asking = batch.filter(asks)
            rest = dict(zip(columns, asking.column("_l").flatten()))
            own = [rest[n] if n in rest else asking.column(n) for n in names[: len(names) - values.type.num_fields]]
            yield pa.RecordBatch.from_arrays([*own, *values.take(pa.array(found, pa.int64())).flatten()], names=names)
            open_, places = values.take(pa.array(places, pa.int64())), list(range(len(places)))

    return run


def asof_join(left: DataFrame, right: DataFrame, *, on: list[str], at: str, begins: str, ends: str, take: list[str]) -> DataFrame:
    """Each left row with ``take`` of the right row valid at its time: begins <= at < ends (null: open), latest start first.

    Versions and left rows are moved once, by key, and sorted by time; a task then
    reads its keys' rows as a stream and keeps only the versions that are open and not
    covered by a later one that ends no sooner.  So the cost is in proportion to versions plus left rows, not to
    their product, however versions lie inside of each other.  Rows without a key or a time are dealt over all tasks.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    named = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on])
    values = F.struct(*take)
    kind = right.select(values.alias("_p")).schema["_p"].dataType
    rows = right.where(named & F.col(begins).isNotNull()).select(*on, micros(F.col(begins)).alias("_t"), F.coalesce(micros(F.col(ends)), F.lit((1 << 63) - 1)).alias("_e"), values.alias("_p"))
    rows = rows.where("_e > _t")  # what ends as it begins is never valid
    columns = [c for c in left.columns if c not in on]
    asked = left.select(*on, F.when(named, micros(F.col(at))).alias("_t"), F.struct(*columns).alias("_l"), F.when(~named | F.col(at).isNull(), F.xxhash64(*left.columns)).alias("_deal"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    own = left.schema.fields + [T.StructField(f.name, f.dataType) for f in kind.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own])
    ordered = both.repartition(*on, "_deal").sortWithinPartitions(*on, "_t", F.col("_e").isNull(), "_e", "_p")
    return ordered.drop("_deal").mapInArrow(_latest_open(on, columns, schema.names), schema)


def asof_few(left: DataFrame, right: DataFrame, *, on: list[str], at: str, begins: str, ends: str, take: list[str]) -> DataFrame:
    """``asof_join`` where every key is known to have only a few versions: a key's are one row, from which each left row takes its own.

    Left rows are moved once, by key, and stay there for what groups them by it; nothing is
    sorted by time, so it is the cheaper way up to some ten versions a key.  Of versions that begin together the one that ends last counts.
    """
    version = F.struct(F.col(begins).alias("b"), F.col(ends).isNull().alias("open"), F.col(ends).alias("e"), F.struct(*take).alias("v"))
    known = right.where(F.col(begins).isNotNull()).groupBy(*on).agg(F.collect_list(version).alias("_versions"))
    valid = F.filter("_versions", lambda x: (x["b"] <= F.col(at)) & (x["open"] | (x["e"] > F.col(at))))
    return left.join(known, on, "left").withColumn("_v", F.array_max(valid)["v"]).select(*left.columns, *[F.col("_v")[c].alias(c) for c in take])


def band_join(left: DataFrame, right: DataFrame, *, on: list[str], at: str, when: str, before: int, after: int) -> DataFrame:
    """Pairs of a left and a right row of one key where ``when`` is from ``before`` seconds before ``at`` to ``after`` seconds after it.

    Times fall into buckets as wide as the band; a left row looks into the two or
    three buckets that its band touches, a right row is in one, so they meet by equality and no pair twice.
    Right columns other than the keys must have names of their own.
    """
    width = before + after + 1
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width * 1_000_000))
    seconds = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))
    low, high = F.col(at) - seconds(before), F.col(at) + seconds(after)
    wanted = left.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    met = wanted.join(right.withColumn("_bucket", bucket(F.col(when))), [*on, "_bucket"])
    return met.where((F.col(when) >= low) & (F.col(when) <= high)).drop("_bucket")


def last_before(left: DataFrame, right: DataFrame, *, on: list[str], at: str, when: str, days: int, ties: list[str], take: list[str], since: str | None = None) -> DataFrame:
    """Each left row with ``_last``, the right row of its key that comes last by ``when`` and ties, at most ``days`` days before its time.

    since: a column of times; a right row on or after it surely exists, so days before it aren't looked at.

    Right rows are reduced to the last of each day; a left row meets those of the
    days before, and on its own day the last one up to its time by a running
    maximum.  So many rows under one key cost a sort by day, not a product.
    """
    value = F.struct(when, *ties, *take)
    times = left.groupBy(*on, at).agg(*([F.min(F.to_date(since)).alias("_since")] if since else [F.lit(None).cast("date").alias("_since")])).withColumn("_day", F.to_date(at))
    rows = right.select(*on, F.to_date(when).alias("_day"), value.alias("_v"))
    daily = rows.groupBy(*on, "_day").agg(F.max("_v").alias("_v"))
    begin = F.greatest(F.date_sub("_day", days), F.col("_since"))
    spread = times.where(begin < F.col("_day")).select(*on, at, F.explode(F.sequence(begin, F.date_sub("_day", 1))).alias("_day"))
    earlier = spread.join(daily, [*on, "_day"]).groupBy(*on, at).agg(F.max("_v").alias("_earlier"))
    kind = right.select(value.alias("_v")).schema["_v"].dataType
    both = rows.select(*on, "_day", "_v", F.col(f"_v.{when}").alias("_t"), F.lit(0).alias("_k")).unionAll(times.select(*on, "_day", F.lit(None).cast(kind).alias("_v"), F.col(at).alias("_t"), F.lit(1).alias("_k")))
    w = Window.partitionBy(*on, "_day").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = both.withColumn("_same", F.max("_v").over(w)).where("_k = 1").select(*on, F.col("_t").alias(at), "_same")
    best = same.join(earlier, [*on, at], "left").select(*on, at, F.coalesce("_same", "_earlier").alias("_last"))
    best = best.withColumn("_last", F.when(F.col(f"_last.{when}") >= F.col(at) - F.expr(f"interval {days} days"), F.col("_last")))
    return left.join(best, [*on, at], "left")


def or_key_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that agree on any of the key pairs, as a union of equi-joins; each pair of rows once."""
    l, r = left.alias("l"), right.alias("r")
    found = None
    for k, (a, b) in enumerate(pairs):
        part = l.join(r, F.col(f"l.{a}") == F.col(f"r.{b}"))
        for x, y in pairs[:k]:  # pairs found by an earlier key are left to it
            part = part.where(~F.coalesce(F.col(f"l.{x}") == F.col(f"r.{y}"), F.lit(False)))
        found = part if found is None else found.unionAll(part)
    return found


def or_key_counts(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], name: str) -> DataFrame:
    """Left rows with how many right rows agree with them on the first pair of keys or the second.

    The right side is counted by each key and by both before the joins, so no pair of rows is made:
    those of either key less those of both, which else would count twice.
    """
    (a, x), (b, y) = first, second
    by = lambda keys, n: right.groupBy(*[F.col(r).alias(f"_{k}") for k, r in keys]).agg(F.count("*").alias(n)).where(" and ".join(f"_{k} is not null" for k, _ in keys))
    out = left.join(by([(0, x)], "_n0"), F.col(a) == F.col("_0"), "left").drop("_0")
    out = out.join(by([(1, y)], "_n1"), F.col(b) == F.col("_1"), "left").drop("_1")
    out = out.join(by([(0, x), (1, y)], "_n2"), (F.col(a) == F.col("_0")) & (F.col(b) == F.col("_1")), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*left.columns, (n("_n0") + n("_n1") - n("_n2")).alias(name))


def without_revoked(events: DataFrame, tombstones: DataFrame, *, scopes: list[str], at: Column | str) -> DataFrame:
    """Events of which no scope was withdrawn at or after their time; tombstones are (scope_key, revoked_before).

    scopes: columns of scope keys, null for an event without one.
    """
    latest = tombstones.groupBy("scope_key").agg(F.max("revoked_before").alias("_revoked"))
    kept = events
    for scope in scopes:
        kept = kept.join(latest, F.col(scope) == F.col("scope_key"), "left").where(F.col("_revoked").isNull() | (F.col("_revoked") < (F.col(at) if isinstance(at, str) else at))).drop("scope_key", "_revoked")
    return kept
