"""Consent that a retry may lower: state per event id, kept as long as the event may arrive again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How long an event id is remembered after its first arrival.
KEPT_MS = 8 * 86400_000


class ConsentDowngrade(StatefulProcessor):
    """An event comes out when it first arrives, and once more if a later arrival of it withdraws sharing.

    All other arrivals are repeats.  Nothing grants what was withdrawn.  The columns that sharing covers are emptied with it.
    """

    def __init__(self, schema: T.StructType, shared: str, covered: list[str]):
        self.schema, self.shared, self.covered = schema, shared, covered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", T.StructType([T.StructField("row", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        import pickle
        from base64 import b64decode, b64encode

        arrivals = [r.asDict() for r in rows]
        # of arrivals in one batch the first one counts, and any of them may withdraw
        arrivals.sort(key=lambda r: r["received_at"])
        known = self.first.get() if self.first.exists() else None
        row = pickle.loads(b64decode(known[0])) if known is not None else dict(arrivals[0])
        before = None if known is None else bool(row[self.shared])
        allowed = bool(row[self.shared]) and all(bool(r[self.shared]) for r in arrivals)
        row[self.shared] = allowed
        if not allowed:
            row |= dict.fromkeys(self.covered)
        if known is None:
            self.handle.registerTimer(int(row["received_at"].timestamp() * 1000) + KEPT_MS)
        if known is None or before and not allowed:
            self.first.update((b64encode(pickle.dumps(row)).decode(),))
            yield Row(**{f.name: row[f.name] for f in self.schema.fields})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


def permitted(events: DataFrame, withdrawals: DataFrame | None = None, *, installed_at=None, shared: str = "ad_sharing_allowed", covered: tuple[str, ...] = (), late: str = "1 hour") -> DataFrame:
    """A stream of accepted events without repeats, except that a retry which withdraws sharing gives the event again, unshared.

    Sharing is refused too for events before the store's connection, and for those up
    to a withdrawal of their visitor or session.  Arrivals may come ``late`` behind the newest one; an id is
    forgotten 8 days after its first arrival.  events: (event_id, event_at, received_at, session_id,
    visitor_id, ...); withdrawals: a static (scope_key, revoked_before).
    """
    columns = events.columns
    rows = events
    allowed = F.coalesce(F.col(shared), F.lit(False))
    if installed_at is not None:
        allowed = allowed & (F.col("event_at") >= installed_at)
    if withdrawals is not None:
        latest = withdrawals.groupBy("scope_key").agg(F.max("revoked_before").alias("_until"))
        for k, scope in enumerate(("visitor", "session")):
            named = latest.select(F.col("scope_key").alias(f"_s{k}"), F.col("_until").alias(f"_u{k}"))
            rows = rows.join(named, F.concat(F.lit(f"{scope}:"), F.col(f"{scope}_id").cast("string")) == F.col(f"_s{k}"), "left")
            allowed = allowed & F.coalesce(F.col("event_at") > F.col(f"_u{k}"), F.lit(True))
    rows = rows.withColumn(shared, allowed).select(*columns).where("received_at is not null").withWatermark("received_at", late)
    return rows.groupBy("event_id").transformWithState(ConsentDowngrade(rows.schema, shared, list(covered)), rows.schema, "Update", "EventTime")
