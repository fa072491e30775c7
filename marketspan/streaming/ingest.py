"""The event stream: acceptance, idempotent ingest, and daily rollups that late events rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storefront import FUNNEL_COLUMNS, accepted, behavior_daily, materialize_sessions, session_products
from ..sources.sinks import replace_days

#: Days that a session lasts at most.
SESSION_DAYS = 2


def event_stream(spark: SparkSession, path: str, schema: str, batch: int = 50) -> DataFrame:
    """Events as they land in a folder, so many files at a time; rows that don't fit the schema stop the stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch).option("mode", "FAILFAST").json(path)


def inbox(deliveries: DataFrame) -> DataFrame:
    """Webhooks, each delivery id once within the 7 days in which it may be sent again."""
    return deliveries.withWatermark("received_at", "7 days").dropDuplicatesWithinWatermark(["delivery_id"])


def ingest(events: DataFrame) -> DataFrame:
    """Accepted events, each id once within the 7 days in which it may arrive."""
    return accepted(events).withWatermark("event_at", "7 days").dropDuplicatesWithinWatermark(["event_id"])


def consent_of(events: DataFrame) -> DataFrame:
    """A retry may withdraw an event's ad sharing, never grant it."""
    return events.groupBy("event_id").agg(F.bool_and("ad_sharing_allowed").alias("ad_sharing_allowed"))


def dirty_sessions(events: DataFrame) -> DataFrame:
    """Sessions that a batch touches, each with its newest arrival."""
    return events.groupBy("session_id").agg(F.max("received_at").alias("dirty_at"))


def to_rebuild(marks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions whose mark is newer than their rollup, whose start has moved, or whose order has changed since.

    marks: (session_id, dirty_at); sessions: (session_id, rolled_at, started_at, previous_started_at, order_updated_at).
    """
    both = sessions.join(marks, "session_id", "left")
    newer = lambda c: F.coalesce(F.col("rolled_at").isNull() | (F.col("rolled_at") < F.col(c)), F.lit(False)) & F.col(c).isNotNull()
    moved = F.col("previous_started_at").isNotNull() & (F.col("previous_started_at") != F.col("started_at"))
    return both.where(newer("dirty_at") | moved | newer("order_updated_at"))


def dirty_days(before: DataFrame, after: DataFrame, purchases: DataFrame, days: int = 30) -> DataFrame:
    """Days to rebuild after sessions changed: where they start now, where they did, and those of later purchases of their visitors.

    before, after: (session_id, visitor_id, started_at); purchases: (visitor_id,
    purchased_at), which look back ``days`` days.  Both are reduced to a visitor's distinct days, over which one
    running maximum finds the last change before each purchase.
    """
    moved = before.select("visitor_id", F.to_date("started_at").alias("day")).union(after.select("visitor_id", F.to_date("started_at").alias("day"))).distinct()
    bought = purchases.select("visitor_id", F.to_date("purchased_at").alias("day")).distinct()
    both = moved.withColumn("_moved", F.col("day")).unionByName(bought.withColumn("_moved", F.lit(None).cast("date")))
    last = F.max("_moved").over(Window.partitionBy("visitor_id").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    later = both.withColumn("_last", last).where(F.col("_moved").isNull() & (F.date_diff("day", "_last") <= days))
    return moved.select("day").union(later.select("day")).distinct()


def advanced(watermark: Column, batch: DataFrame, *, repair: bool = False) -> DataFrame:
    """The new watermark: the newest mark of the acknowledged batch; a repair never moves it back."""
    newest = F.max("dirty_at")
    return batch.agg((F.greatest(newest, watermark) if repair else F.coalesce(newest, watermark)).alias("watermark"))


def repaired(states: DataFrame, marks: DataFrame) -> DataFrame:
    """Stores' rollup states with their error cleared where nothing is left to rebuild.  states: (store_id, last_error); marks: (store_id, session_id)."""
    open_ = marks.select("store_id").distinct().withColumn("_open", F.lit(True))
    return states.join(open_, "store_id", "left").withColumn("last_error", F.when(F.col("_open"), F.col("last_error"))).drop("_open")


def rebuild_days(stored_events: DataFrame, batch: DataFrame, path: str) -> None:
    """For foreachBatch: rebuilds the days on which sessions of this batch start, whole, from all their events.

    stored_events holds everything ingested so far, this batch included.  A late event can move
    a session's start, so the days of the session with and without it are rebuilt.  Only events of those days and
    the ``SESSION_DAYS`` after them are read; days that lost their last session get a row of zeros.
    """
    span = batch.agg(F.min("event_at").alias("first"), F.max("event_at").alias("last")).first()
    if span["first"] is None:
        return

    def near(events: DataFrame, first, last) -> DataFrame:
        margin = F.expr(f"interval {SESSION_DAYS} days")
        return events.where((F.col("event_at") >= F.lit(first) - margin) & (F.col("event_at") <= F.lit(last) + margin))

    touched = near(stored_events, span["first"], span["last"]).join(batch.select("session_id").distinct(), "session_id", "left_semi")
    before = touched.join(batch.select("event_id"), "event_id", "left_anti")
    starts = lambda e: materialize_sessions(e).select(F.to_date("started_at").alias("day"))
    days = starts(touched).union(starts(before)).distinct().cache()  # a handful: late events are at most a week old
    ends = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    events = near(stored_events, ends["first"], ends["last"])
    sessions = materialize_sessions(events).withColumn("_day", F.to_date("started_at")).join(days.withColumnRenamed("day", "_day"), "_day", "left_semi").drop("_day")
    cube = behavior_daily(sessions, session_products(events))
    empty = days.join(cube.select("day").distinct(), "day", "left_anti").select("day", F.lit("STORE").alias("dimension"), F.lit("store").alias("key"), *[F.lit(0).cast("long").alias(c) for c in FUNNEL_COLUMNS])
    replace_days(cube.unionByName(empty), path, "day")
    days.unpersist()
