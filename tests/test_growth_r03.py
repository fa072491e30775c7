"""Plans of round 3's findings: what is moved, held and read once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from marketspan.operators import commerce, joins
from marketspan.plans.registry import QUERIES


def test_asof_few_moves_left_rows_once(spark):
    """what groups by the key after it needs no further exchange."""
    t = lambda m: datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([(1, t(5), 10), (1, t(1), 10), (2, t(5), 11)], "k int, t timestamp_ntz, o int")
    right = spark.createDataFrame([(1, t(2), t(9), "ends"), (1, t(2), None, "open"), (1, t(2), t(7), "soon")], "k int, f timestamp_ntz, u timestamp_ntz, v string")
    got = joins.asof_few(left.hint("merge"), right, on=["k"], at="t", begins="f", ends="u", take=["v"])
    assert sorted((r.k, r.t, r.v) for r in got.collect()) == [(1, t(1), None), (1, t(5), "open"), (2, t(5), None)]
    grouped = got.groupBy("k", "o").agg(F.max("v")).groupBy("k").agg(F.count("*"))
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_collections_hold_no_row_for_each_order_and_collection(spark):
    """orders count once in a collection, lines without one not at all, and no distinct count is planned."""
    row = "period string, order_id long, product_id long, quantity int, current_quantity int, refunded_units int, restocked_units int, revenue decimal(20,4), refund_value decimal(22,5)"
    lines = spark.createDataFrame([("CURRENT", o, p, q, q, 0, 0, None, None) for o, p, q in ((1, 1, 2), (1, 2, 3), (1, 1, 4), (2, 1, 5), (None, 1, 6), (3, 9, 7))], row).withColumn("revenue", F.col("quantity").cast("decimal(20,4)"))
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "product_id long, collection_id string")
    got = commerce.collection_performance(lines, members, spark.createDataFrame([("CURRENT",), ("COMPARISON",)], "period string"), spark.createDataFrame([("a",), ("b",), ("c",)], "collection_id string"))
    assert "count(distinct" not in got._jdf.queryExecution().analyzed().toString()
    found = {(r.period, r.collection_id): (r.orders, r.units, r.revenue) for r in got.collect()}
    assert found == {("CURRENT", "a"): (2, 20, 20.0), ("CURRENT", "b"): (2, 17, 17.0)} | {("CURRENT", "c"): (0, 0, 0.0)} | {("COMPARISON", c): (0, 0, 0.0) for c in "abc"}


def test_target_evidence_reads_written_sessions(spark):
    """F16, F20: the result reads events, sessions and touches that were written once, not the table again for each use."""
    assert not [f for f in QUERIES["O-123_target_evidence"](spark, "/root/testdata/sf0.001").inputFiles() if f.endswith("events.parquet")]
