"""Streams with state, recorded pages that resume, and keyed tables that rewrite only what they must."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketspan.sources import pages, sinks
from marketspan.streaming import consent, linking

EVENT = "event_id string, event_at timestamp, received_at timestamp, session_id string, visitor_id string, ad_sharing_allowed boolean, cipher string"
T = datetime(2024, 1, 10)


def land(spark, folder, rows, schema, name):
    """One more file of a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def drain(stream, checkpoint, out, mode="append"):
    query = stream.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.fixture()
def state_store(spark):
    """The store that state with timers needs, in one partition, as each one has a Python process of its own."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_retry_may_lower_consent_and_never_raise_it(spark, tmp_path, state_store):
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    gone = spark.createDataFrame([("visitor:w", T + timedelta(hours=1)), ("session:s9", T)], "scope_key string, revoked_before timestamp")

    def run(*rows):
        land(spark, folder, [(i, T, T + timedelta(minutes=m), s, v, ok, "c") for i, m, s, v, ok in rows], EVENT, f"b{len(os.listdir(folder)) if os.path.exists(folder) else 0}")
        stream = spark.readStream.schema(EVENT).parquet(f"{folder}/*")
        drain(consent.permitted(stream, gone, covered=("cipher",)), cp, out, "update")
        return sorted((r.event_id, r.ad_sharing_allowed, r.cipher) for r in spark.read.parquet(out).collect())

    first = [("a", True, "c"), ("b", False, None), ("w", False, None), ("x", False, None)]
    # two arrivals of one batch count as one; a withdrawal of the visitor or the session refuses
    assert run(("a", 0, "s1", "v1", True), ("b", 0, "s1", "v1", True), ("b", 1, "s1", "v1", False), ("w", 0, "s2", "w", True), ("x", 0, "s9", None, True)) == first
    # a repeat says nothing new, a late retry withdraws
    assert run(("a", 5, "s1", "v1", True)) == first
    after = sorted([*first, ("a", False, None)])
    assert run(("a", 9, "s1", "v1", False)) == after
    # a third can't grant it, and what was refused at first stays so
    assert run(("a", 12, "s1", "v1", True), ("b", 12, "s1", "v1", True)) == after


def test_sessions_wait_for_their_order(spark, tmp_path):
    s_schema, o_schema = "session_id string, order_ext string, ended_at timestamp", "order_ext string, order_id long, created_at timestamp"
    sessions, orders, out, cp = (str(tmp_path / n) for n in ("sessions", "orders", "out", "cp"))

    def run(name, new_sessions, new_orders):
        land(spark, sessions, new_sessions, s_schema, name)
        land(spark, orders, new_orders, o_schema, name)
        linked = linking.linked_stream(spark.readStream.schema(s_schema).parquet(f"{sessions}/*"), spark.readStream.schema(o_schema).parquet(f"{orders}/*"))
        drain(linked, cp, out)
        return sorted((r.session_id, r.order_id, r.link_status) for r in spark.read.parquet(out).collect()) if os.path.exists(out) else []

    h = lambda x: T + timedelta(hours=x)
    # the order was there before its session
    assert run("1", [("before", "o1", h(1))], [("o1", 1, h(0)), ("other", 9, h(0))]) == [("before", 1, "LINKED")]
    # a session comes first and waits; one without an order's name never links
    assert run("2", [("after", "o2", h(2)), ("never", "o3", h(2)), ("unnamed", None, h(2))], [("old", 8, h(1))]) == [("before", 1, "LINKED")]
    assert run("3", [("tick", "t", h(3))], [("o2", 2, h(4))]) == [("after", 2, "LINKED"), ("before", 1, "LINKED")]
    # once no order can come any more, the session is given out without one
    run("4", [("tick2", "t2", h(40))], [("late", 7, h(40))])
    got = run("5", [("tick3", "t3", h(41))], [("late2", 6, h(41))])
    assert ("never", None, "UNLINKED") in got and sum(s == "never" for s, _, _ in got) == 1 and not any(s == "unnamed" for s, _, _ in got)


def record(folder, account, page, body):
    os.makedirs(f"{folder}/{account}", exist_ok=True)
    with open(f"{folder}/{account}/{page}.json", "w") as f:
        json.dump(body, f)


def taken(df):
    return sorted((r.account, r.page, r.ordinal, r.row and json.loads(r.row)["n"], r.error and json.loads(r.error)["message"]) for r in df.collect())


def test_recorded_pages(spark, tmp_path):
    folder = str(tmp_path)
    record(folder, "a", "001", {"data": [{"n": 1}, {"n": 2}], "next": "002"})
    record(folder, "a", "002", {"data": [{"n": 3}], "next": None})
    record(folder, "b", "001", {"data": [{"n": 4}], "next": "002"})
    record(folder, "b", "002", {"data": [], "error": {"message": "limit"}, "next": "003"})
    record(folder, "b", "003", {"data": [{"n": 5}]})
    record(folder, "c", "001", {"data": [{"n": 6}], "next": "001"})
    record(folder, "d", "001", {"data": [{"n": 7}], "next": "404"})
    os.makedirs(f"{folder}/empty")
    found = pages.recorded_pages(spark, folder)
    a = [("a", "001", 0, 1, None), ("a", "001", 1, 2, None), ("a", "002", 0, 3, None)]
    # each failure ends its own account only
    assert taken(found) == sorted([*a, ("b", "001", 0, 4, None), ("b", "002", -1, None, "limit"), ("c", "001", 0, 6, None), ("c", "001", -1, None, "the pages go in a circle"), ("d", "001", 0, 7, None), ("d", "404", -1, None, "the page is missing")])
    assert found.rdd.getNumPartitions() == 4
    # resumed from a cursor, and an account left out
    assert taken(pages.recorded_pages(spark, folder, {"a": "002", "b": "003", "c": None, "d": None})) == [("a", "002", 0, 3, None), ("b", "003", 0, 5, None)]
    assert taken(pages.recorded_pages(spark, str(tmp_path / "empty"))) == []


def test_page_stream_resumes(spark, tmp_path):
    folder, out, cp = str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "cp")
    record(folder, "a", "001", {"data": [{"n": 1}, {"n": 2}]})
    record(folder, "b", "001", {"error": {"message": "limit"}})

    def run():
        query = pages.page_stream(spark, folder).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", cp).start()
        query.processAllAvailable()
        query.stop()
        return taken(spark.read.parquet(out))

    first = [("a", "001", 0, 1, None), ("a", "001", 1, 2, None), ("b", "001", -1, None, "limit")]
    assert run() == first
    assert run() == first
    record(folder, "a", "002", {"data": [{"n": 3}]})
    record(folder, "b", "002", {"data": [{"n": 4}]})
    record(folder, "c", "001", {"data": [{"n": 5}]})
    assert run() == sorted([*first, ("a", "002", 0, 3, None), ("b", "002", 0, 4, None), ("c", "001", 0, 5, None)])


ROW = "k long, v int, x string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def state(table):
    return sorted((r.k, r.x) for r in table.read().collect())


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], "v", buckets=16)
    table.upsert(spark.range(200).selectExpr("id k", "1 v", "'old' x"))
    before = files(table.path)
    changes = spark.createDataFrame([(5, 2, "new"), (6, 0, "stale"), (1000, 1, "added")], ROW)
    table.upsert(changes)
    after = files(table.path)
    touched = {r[0] for r in changes.withColumn("b", table._bucket()).select("b").collect()}
    other = {f: t for f, t in before.items() if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    assert len(other) >= 13 and all(after.get(f) == t for f, t in other.items()) and not (before.keys() - other.keys()) & after.keys()
    want = sorted([(k, "new" if k == 5 else "old") for k in range(200)] + [(1000, "added")])
    assert state(table) == want
    # a repeated batch leaves the same rows
    table.upsert(changes)
    assert state(table) == want
    table.upsert(changes.limit(0))
    table.delete(spark.range(200).selectExpr("id k"))
    assert state(table) == [(1000, "added")]


def test_streams_write_both_tables(spark, tmp_path):
    native = sinks.KeyedTable(spark, str(tmp_path / "native"), ["k"], "v", buckets=4)
    canonical = sinks.KeyedTable(spark, str(tmp_path / "canonical"), ["id"], "v", buckets=4)
    write = sinks.dual_upsert(native, canonical, lambda b: b.where("k < 100").select(F.concat(F.lit("c"), "k").alias("id"), "v", "x"))
    folder, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    for n, rows in enumerate([[(1, 1, "a"), (100, 1, "b")], [(1, 2, "c"), (1, 1, "late"), (2, 1, "d")]]):
        land(spark, folder, rows, ROW, f"f{n}")
        spark.readStream.schema(ROW).parquet(f"{folder}/*").writeStream.foreachBatch(write).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(120)
    assert state(native) == [(1, "c"), (2, "d"), (100, "b")]
    assert sorted((r.id, r.x) for r in canonical.read().collect()) == [("c1", "c"), ("c2", "d")]
