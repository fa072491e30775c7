"""What changed between two snapshots of a hierarchy or a catalog, and what that makes stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_keys(before: DataFrame, after: DataFrame, *, key: str, parents: list[str], values: list[str]) -> DataFrame:
    """(key, change): ADDED, DELETED, MOVED (another parent) or CHANGED (another value); unchanged keys are left out.

    Rows are compared by a digest of their parents and one of their values, so a
    snapshot's width doesn't matter after the scan.  A key that has several rows in a snapshot is
    compared as the set of these.
    """
    def digests(df: DataFrame, mark: str) -> DataFrame:
        # a null is told apart from any text, and values can't run into each other
        of = lambda names: F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(F.col(n).cast("string").alias("v"))), F.lit("")) for n in names])), 256)
        rows = df.select(key, of(parents).alias("p"), of(values).alias("v")).distinct()
        return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("p")), ","), 256).alias(f"{mark}_p"), F.sha2(F.array_join(F.array_sort(F.collect_set("v")), ","), 256).alias(f"{mark}_v"))

    both = digests(before, "a").join(digests(after, "b"), key, "full")
    change = F.when(F.col("a_p").isNull(), "ADDED").when(F.col("b_p").isNull(), "DELETED").when(F.col("a_p") != F.col("b_p"), "MOVED").when(F.col("a_v") != F.col("b_v"), "CHANGED")
    return both.select(key, change.alias("change")).where("change is not null")


def with_descendants(changed: DataFrame, children: DataFrame, *, key: str, parent: str) -> DataFrame:
    """The changed keys of a level and the keys below them: children (key, parent) of both snapshots."""
    below = children.select(key, parent).join(changed.select(F.col(changed.columns[0]).alias(parent)).distinct(), parent, "left_semi")
    return below.select(key).distinct()


def invalidated_sessions(facts: list[tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Sessions to rebuild because something that they name has changed, each once with its newest arrival.

    facts: for each kind of entity, rows (session_id, received_at, the key) of what sessions name, the changed keys, and the key's name.
    """
    found = [rows.join(keys.select(key).distinct(), key, "left_semi").select("session_id", "received_at") for rows, keys, key in facts]
    return reduce(DataFrame.unionAll, found).groupBy("session_id").agg(F.max("received_at").alias("source_received_at"))


def reissued(marks: DataFrame, stale: DataFrame, generation: str) -> DataFrame:
    """Repair marks after a change: all open ones under a new generation, and one for each stale session, with the later arrival.

    A run that reads an old mark finds its generation gone, so what it makes of the old state isn't taken for the new.
    marks: (session_id, source_received_at, generation).
    """
    both = marks.select("session_id", "source_received_at").unionByName(stale.select("session_id", "source_received_at"))
    merged = both.groupBy("session_id").agg(F.max("source_received_at").alias("source_received_at"))
    return merged.withColumn("generation", F.sha2(F.concat_ws("|", F.lit(generation), F.col("session_id").cast("string")), 256))
