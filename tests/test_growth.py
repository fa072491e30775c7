"""What operators move and hold: figures that must not grow faster than their input."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketspan.operators import commerce, delivery, mapping, storefront
from marketspan.plans import registry


def moved(spark, df) -> int:
    """Rows that a query's shuffles write."""
    store, array = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written() -> int:
        stages, total = store.stageList(None, False, False, array, None).iterator(), 0
        while stages.hasNext():
            total += stages.next().shuffleWriteRecords()
        return total

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = written()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def touch_rows(spark, rows):
    """Touches (minute, session, visitor, google click) with every other signal missing."""
    start = datetime(2024, 1, 1)
    made = spark.createDataFrame([(start + timedelta(minutes=m), s, v, g) for m, s, v, g in rows], "event_at timestamp_ntz, session_id string, visitor_id long, google_click string")
    return made.withColumns({n: F.lit(None).cast("string") for n in delivery.SIGNATURE if n != "google_click"})


def test_routing_moves_no_pairs(spark):
    touches = touch_rows(spark, [(k, f"s{k % 2}", k % 2, f"g{k}") for k in range(200)])
    asked = touches.select(F.col("google_click").alias("conversion_id"), "event_at", "session_id", "visitor_id")
    found = delivery.routing(asked, touches, since=F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {r.conversion_id: r.paid_touches for r in found.collect()} == {f"g{k}": k // 2 + 1 for k in range(200)}
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        assert moved(spark, delivery.routing(asked, touches, since=F.lit("2024-01-01").cast("timestamp_ntz"))) < 4000  # 10,100 pairs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_routing_by_sessions_of_several_visitors(spark):
    # the session s has touches of visitors 1, 2 and none; t is all of visitor 3; u has no visitor at all
    touches = touch_rows(spark, [(1, "s", 1, "a"), (2, "s", 2, "b"), (3, "s", None, "c"), (4, "r", 1, "d"), (5, "t", 3, "e"), (6, "t", 3, "e"), (7, "u", None, "f"), (8, None, 3, "g"), (9, "w", 4, "h")])
    at = F.lit("2024-01-02").cast("timestamp_ntz")
    asked = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, "t", 3), (4, "u", None), (5, None, 1), (6, "x", 3), (7, "r", 4), (8, "w", 4), (8, "t", 3)], "conversion_id long, session_id string, visitor_id long").withColumn("event_at", at)
    found = delivery.routing(asked, touches, since=F.lit("2024-01-01").cast("timestamp_ntz"))
    assert sorted((r.conversion_id, r.paid_touches) for r in found.collect()) == [(1, 4), (2, 3), (3, 2), (4, 1), (5, 2), (6, 2), (7, 2), (8, 3), (8, 3)]


def test_inventory_history_moves_changes_only(spark):
    snaps = spark.createDataFrame([(k, 1, datetime(2024, 1, d), 10 * k + d) for k in range(20) for d in (1, 5, 9)], "item_id long, location_id int, observed_at timestamp_ntz, available long")
    days = spark.range(365).select(F.date_add(F.lit("2024-01-03").cast("date"), F.col("id").cast("int")).alias("day"))
    found = commerce.inventory_history(snaps, days)
    level = {r.day.isoformat(): r.available for r in found.collect()}
    tens = 10 * sum(range(20))
    assert len(level) == 365 and [level[f"2024-01-{d:02d}"] for d in (3, 4, 5, 8, 9, 31)] == [tens + 20 * x for x in (1, 1, 5, 5, 9, 9)]
    assert moved(spark, found) < 3000  # 20 items on 365 days are 7,300


def test_inventory_history_without_levels(spark):
    schema = "item_id long, location_id int, observed_at timestamp_ntz, available long"
    days = spark.range(3).select(F.date_add(F.lit("2024-01-03").cast("date"), F.col("id").cast("int") * 2).alias("day"))  # January 3, 5, 7
    history = lambda rows: [r.available for r in commerce.inventory_history(spark.createDataFrame(rows, schema), days).orderBy("day").collect()]
    assert history([]) == []
    assert history([(1, 1, datetime(2024, 2, 1), 5)]) == [None, None, None]
    # levels that are not known, and days that are not asked for, change nothing
    assert history([(1, 1, datetime(2024, 1, 5), 5), (1, 1, datetime(2024, 1, 6), 9), (1, 1, datetime(2024, 1, 7), None)]) == [None, 5, 5]
    assert history([(1, 1, datetime(2024, 1, 1), 4), (1, 1, datetime(2024, 1, 2), None), (2, 1, datetime(2024, 1, 2), 7), (2, 1, datetime(2024, 1, 7), 1)]) == [7, 7, 1]


def test_provider_ids_gather_nothing(spark):
    rows = spark.createDataFrame([('{"sku": ["b", "a", "a"], "x": [{"ITEM_ID": 3}, [], {}]}',)] * 3 + [("[",), (None,)], "j string")
    found = mapping.provider_ids(rows, "j")
    assert sorted(str(r.ids) for r in found.collect()) == ["None", "None"] + ["['3', 'a', 'b']"] * 3
    assert not any(step in plan(found) for step in ("Aggregate", "Generate", "Join"))


def test_families_share_what_they_read(spark):
    sf = "/root/testdata/sf0.001"
    reads = sum(len(set(re.findall(r"\w+\.parquet", f))) for df in registry.families(spark, sf).values() for f in df.inputFiles() if "lineitem" in f or "events" in f)
    assert reads <= 1  # the product family's stock cover; all else reads tables written once


def test_months_are_days_of_the_current_year(spark):
    sf = "/root/testdata/sf0.001"
    month = registry.bases(spark, sf)["month"]
    own = registry.c.ad_daily(spark, sf, registry.MONTH, registry.MONTH_BEFORE).select(*month.columns)
    assert month.count() > 0 and not month.exceptAll(own).count() and not own.exceptAll(month).count()


def test_a_path_sorts_its_steps_once(spark):
    steps = spark.createDataFrame([(1, ["b", "a", "a", "b", "b"]), (2, []), (3, ["a"])], "n int, sources array<string>")
    made = F.transform("sources", lambda x, k: F.struct(k.alias("k"), x.alias("source")))
    found = steps.select("n", storefront._path(F.reverse(made)).alias("path"))
    assert [r.path for r in found.orderBy("n").collect()] == ["b>a>b", "UNKNOWN", "a"]
    sorts = plan(found).count("array_sort") + plan(found).count("sort_array")
    assert sorts <= 2  # in the condition of a length and in the text, but not in the comparison of neighbours
