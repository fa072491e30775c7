"""Sessions that wait for the order that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linked_stream(sessions: DataFrame, orders: DataFrame, *, wait: str = "6 hours", early: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Each session that names an order, once: LINKED as soon as the order is there, UNLINKED when it can't come any more.

    A stream-stream outer join: the order may arrive up to ``early`` before and ``wait`` after the
    session by their own times; ``late`` is how far either stream may lag behind, after which
    state is dropped and sessions without an order are given out.

    sessions: (session_id, order_ext, ended_at); orders: (order_ext, order_id, created_at), an order once.
    """
    left = sessions.where("order_ext is not null").withWatermark("ended_at", late)
    right = orders.select(F.col("order_ext").alias("_ext"), "order_id", "created_at").withWatermark("created_at", late)
    near = F.expr(f"order_ext = _ext and created_at >= ended_at - interval {early} and created_at <= ended_at + interval {wait}")
    out = left.join(right, near, "leftOuter").drop("_ext")
    return out.withColumn("link_status", F.when(F.col("order_id").isNotNull(), "LINKED").otherwise("UNLINKED"))
