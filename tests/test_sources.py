"""Landing files, keyed writes and rollups of the event stream."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketspan.sources import landing, sinks
from marketspan.streaming import ingest


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_bulk_files(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "p", "n": 1}\n{"id": "c", "__parentId": "p", "n": 2}\n')
    parents, children = landing.bulk_jsonl(spark, str(good), "id string, n int, __parentId string")
    assert values(parents, "id", "n") == [("p", 1)] and values(children, "id", "__parentId") == [("c", "p")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        landing.bulk_jsonl(spark, str(bad), "id string, n int, __parentId string")[0].collect()


def test_json_values(spark):
    rows = [('[{"value": "10"}, {"value": 2.5}]', 12.5), ("7", 7.0), ('"8"', 8.0), ('{"value": 3}', 3.0), ("[]", None), ("x", None), (None, None)]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(rows)], "k int, j string")
    assert [r.v for r in df.select("k", landing.metric_value(F.col("j")).alias("v")).orderBy("k").collect()] == [w for _, w in rows]
    assert values(landing.recordset(spark.createDataFrame([('[{"a": 1, "b": "x"}, {"a": 2}]',), ("no",)], "j string"), "j", "a int, b string"), "a", "b") == [(1, "x"), (2, None)]
    assert str(spark.range(1).select(landing.micros(F.lit(1_234_567))).first()[0]) == "1.234567"


def test_projection_and_keys(spark):
    native = spark.createDataFrame([(1, "c", None, 5)], "id int, name string, x string, y int")
    row = landing.canonical_projection(native, {"id": "campaign_id", "name": "title"}, ["x", "y"]).first()
    assert (row.campaign_id, row.title, row.provider_metrics) == (1, "c", '{"y":5}')
    keys = spark.range(1).select(landing.insight_key(F.lit("a"), F.lit(None)), landing.insight_key(F.lit("a"), F.lit("")), landing.insight_key(F.lit(None), F.lit("a"))).first()
    assert keys[0] == keys[1] != keys[2]


def test_snapshots_are_kept_once(spark):
    levels = "item int, observed_at timestamp_ntz, available int"
    d = lambda x: datetime(2024, 1, x)
    now = spark.createDataFrame([(1, d(2), 5)], levels)
    new = spark.createDataFrame([(1, d(1), 9), (1, d(3), 4), (1, d(2), 5)], levels)
    current, history = sinks.with_snapshots(now, now, new, ["item"])
    assert values(current, "item", "available") == [(1, 4)] and values(history, "available") == [(4,), (5,), (9,)]
    kept = sinks.replaced_mappings(spark.createDataFrame([(1, 10), (2, 20)], "ad_id int, product_id int"), spark.createDataFrame([(1, 11)], "ad_id int, product_id int"), spark.createDataFrame([(1,), (3,)], "ad_id int"))
    assert values(kept, "ad_id", "product_id") == [(1, 11), (2, 20)]


def test_dual_write(spark, tmp_path):
    batch = spark.createDataFrame([("e", "2024-01-01", 5), ("none", "2024-01-01", 6)], "external_id string, date string, spend int")
    sinks.dual_write(batch, str(tmp_path / "native"), str(tmp_path / "canonical"), spark.createDataFrame([("e", 7)], "external_id string, ad_id int"))
    assert spark.read.parquet(str(tmp_path / "native")).count() == 2 and values(spark.read.parquet(str(tmp_path / "canonical")), "ad_id", "spend") == [(7, 5)]


EVENT = "event_id int, session_id string, visitor_id int, event_at timestamp_ntz, event_name string, page_url string, product_id int, order_linked boolean"


def event(i, session, at, name="PAGE_VIEW"):
    return (i, session, 1, at, name, "https://s.com/", None, False)


def test_late_event_rebuilds_both_days(spark, tmp_path):
    """A late event moves a session to the day before: the day it leaves gets zeros."""
    path = str(tmp_path / "days")
    first = [event(1, "a", datetime(2024, 1, 2, 0, 5)), event(2, "b", datetime(2024, 1, 4))]
    df = spark.createDataFrame(first, EVENT)
    ingest.rebuild_days(df, df, path)
    late = spark.createDataFrame([event(3, "a", datetime(2024, 1, 1, 23, 55))], EVENT)
    ingest.rebuild_days(df.union(late), late, path)
    got = spark.read.parquet(path).where("dimension = 'STORE'")
    assert values(got, "day", "sessions") == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 0), (date(2024, 1, 4), 1)]


def test_dirty_days_reach_later_purchases(spark):
    s = "session_id string, visitor_id int, started_at timestamp_ntz"
    d = lambda m, x: datetime(2024, m, x)
    before, after = spark.createDataFrame([("a", 1, d(1, 2))], s), spark.createDataFrame([("a", 1, d(1, 1))], s)
    bought = spark.createDataFrame([(1, d(1, 20)), (1, d(3, 1)), (2, d(1, 5)), (1, d(1, 1))], "visitor_id int, purchased_at timestamp_ntz")
    assert values(ingest.dirty_days(before, after, bought), "day") == [(date(2024, 1, 1),), (date(2024, 1, 2),), (date(2024, 1, 20),)]


def test_marks_and_repairs(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    marks = spark.createDataFrame([("a", t(5)), ("b", t(1)), ("c", t(1))], "session_id string, dirty_at timestamp_ntz")
    kind = "session_id string, rolled_at timestamp_ntz, started_at timestamp_ntz, previous_started_at timestamp_ntz, order_updated_at timestamp_ntz"
    rows = [("a", t(4), t(0), None, None), ("b", t(4), t(0), t(1), None), ("c", t(4), t(0), t(0), None), ("d", t(4), t(0), None, t(6)), ("e", None, t(0), None, None)]
    assert values(ingest.to_rebuild(marks, spark.createDataFrame(rows, kind)), "session_id") == [("a",), ("b",), ("d",)]
    later = F.lit(t(9))
    assert ingest.advanced(later, marks).first()[0] == t(5) and ingest.advanced(later, marks, repair=True).first()[0] == t(9)
    states = spark.createDataFrame([(1, "failed"), (2, "failed")], "store_id int, last_error string")
    assert values(ingest.repaired(states, spark.createDataFrame([(2, "s")], "store_id int, session_id string")), "store_id", "last_error") == [(1, None), (2, "failed")]
