"""Composite reads and signals on cases that the tables don't have."""

from pyspark.sql import functions as F

from marketspan.operators import economics, rules, storefront


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_spend_needs_every_account(spark):
    facts = spark.createDataFrame([("CURRENT", 1, "EUR", 5.0), ("CURRENT", 2, "EUR", 6.0), ("COMPARISON", 1, "EUR", 7.0), ("CURRENT", 3, "USD", 9.0)], "period string, account_id int, currency string, spend double")
    accounts = facts.select("account_id", "currency")
    assert rows(economics.compatible_spend(facts, accounts, "EUR")) == [("COMPARISON", 1, None), ("CURRENT", 0, 11.0)]
    assert rows(economics.compatible_spend(facts, accounts, "GBP")) == []


def test_customers_have_all_segments(spark):
    sums = spark.createDataFrame([("CURRENT", "NEW", 3, 4, 30.0), ("CURRENT", "UNKNOWN", 1, 1, 5.0), ("COMPARISON", "NEW", 2, 2, 20.0)], "period string, segment string, orders long, units long, order_value double")
    found = {r.segment: r for r in economics.customers(sums).collect()}
    assert sorted(found) == sorted(economics.SEGMENTS)
    assert (found["TOTAL"].orders, found["TOTAL"].orders0, found["TOTAL"].coverage, found["TOTAL"].coverage0) == (4, 2, 0.75, 1.0)
    assert found["RETURNING"].orders == 0 and found["RETURNING"].orders_change == 0.0 and found["UNKNOWN"].orders_change is None
    empty = economics.customers(sums.limit(0)).collect()
    assert len(empty) == 4 and all(r.coverage == 0.0 for r in empty)


def test_cover_needs_trust(spark):
    items = spark.createDataFrame([(1, True), (2, False), (3, True)], "product_id int, tracked boolean")
    levels = spark.createDataFrame([(1, 5, 0), (1, -9, 2), (2, 8, 0)], "product_id int, available int, incoming int")
    lines = spark.createDataFrame([(1, 10, 10, 0, 0, 1.0, 0.0), (2, 10, 10, 0, 0, 1.0, 0.0)], "product_id int, quantity int, current_quantity int, refunded_units int, restocked_units int, revenue double, refund_value double")
    got = {r.product_id: r for r in economics.inventory_cover(items, levels, lines, days=5, trusted=True).collect()}
    assert (got[1].available, got[1].units_per_day, got[1].days_cover) == (-4, 2.0, 0.0)
    assert got[2].days_cover is None and got[3].units_sold == 0 and got[3].days_cover is None
    assert all(r.days_cover is None for r in economics.inventory_cover(items, levels, lines, days=5, trusted=False).collect())


def test_signals_stop_at_thin_evidence(spark):
    names = ["source_rows", "impressions", "spend", "conversions", "roas", "cpc", "ctr"]
    schema = "entity_id string, " + ", ".join(f"{n} double, {n}0 double" for n in names)
    data = [
        ("none", None, 3, None, 500, None, 1, None, 1, None, 1, None, 1, None, 1),
        ("thin", 2, 3, 99, 500, 9, 1, 0, 1, 1, 2, 9, 1, 0, 1),
        ("thin before", 2, 3, 500, 99, 9, 1, 0, 1, 1, 2, 9, 1, 0, 1),
        ("worse", 2, 3, 500, 500, 2, 1, 8, 10, 0.5, 1, 1.25, 1, 0.5, 1),
        ("better", 2, 3, 1000, 1000, 1, 1, 5, 5, 1.2, 1, 1, 1, 1, 1),
    ]
    entities = spark.createDataFrame([(d[0], *[None if x is None else float(x) for x in d[1:]]) for d in data], schema)
    got = {}
    for e, code, severity in rows(rules.entity_signals(entities)):
        got.setdefault(e, {})[code] = severity
    assert got == {
        "none": {"INSUFFICIENT_CURRENT_EVIDENCE": "WARNING"},
        "thin": {"LOW_DELIVERY_INSUFFICIENT_EVIDENCE": "INFO"},
        "thin before": {"NO_CONVERSION_SPEND": "WARNING"},
        "worse": {"SPEND_UP_EFFICIENCY_DOWN": "HIGH", "CPC_DETERIORATION": "WARNING", "CTR_DETERIORATION": "HIGH", "CONVERSIONS_DOWN_SPEND_UP": "HIGH", "SUDDEN_DELIVERY_CHANGE": "WARNING"},
        "better": {"STRONG_PROVIDER_EFFICIENCY": "INFO"},
    }


def test_actions(spark):
    drafts = spark.createDataFrame([("ad_efficiency_deterioration", "HIGH"), ("ad_efficiency_deterioration", "MEDIUM"), ("inventory_runway_risk", "HIGH"), ("anything", "HIGH")], "rule_id string, severity string")
    assert [r.action for r in rules.with_actions(drafts).collect()] == ["REDUCE", "HOLD", "HOLD", "INVESTIGATE"]


def test_video_retention(spark):
    video = spark.createDataFrame([("a", "READY", "HIGH", True, 100, 50, 0.5, 0.7, 0.2, None, 0.1), ("b", "READY", "LOW", True, 100, 50, 0.5, 0.7, 0.2, 0.2, 0.1), ("c", "READY", "MEDIUM", True, 40, 50, 0.5, 0.7, 0.2, 0.2, 0.1), ("d", "READY", "MEDIUM", True, 60, 50, None, 0.7, 0.25, 0.375, 0.1)], "entity_id string, status string, evidence_quality string, comparison_valid boolean, plays0 int, minimum_plays int, hook double, hook0 double, completion double, completion0 double, spend_share double")
    drafts = rules.apply_rules({"creative_video": video}).collect()
    assert sorted((r.entity_id, r.severity, r.impact, r.confidence) for r in drafts) == [("a", "MEDIUM", 0.2, 0.9), ("d", "MEDIUM", 0.2, 0.78)]


def test_reorder_state(spark):
    cover = spark.createDataFrame([(1, 20, 2.0), (2, 21, 2.0), (3, 10, 2.0), (4, -1, 2.0), (5, 5, 0.0), (6, None, 1.0)], "product_id int, available int, units_per_day double")
    got = {r.product_id: (r.reorder_point, r.at_risk, r.critical, r.urgency) for r in economics.with_reorder_state(cover, lead_days=10).collect()}
    assert got[1] == (20, True, False, 0.55) and got[2] == (20, False, False, 0.55)
    assert got[3][:3] == (20, True, True) and abs(got[3][3] - 0.775) < 1e-9
    assert got[4] == got[5] == got[6] == (None, None, None, None)


def test_shared_exposure_needs_confidence(spark):
    stock = spark.createDataFrame([(1, True, False, 0.6, 3.0), (2, None, None, None, None)], "product_id int, at_risk boolean, critical boolean, urgency double, days_cover double")
    targets = spark.createDataFrame([(7, 1, 0.8, False), (7, 2, 0.8, False), (8, 1, 0.2, False), (8, 2, 0.2, False), (9, 1, 0.9, True)], "ad_id int, product_id int, confidence double, is_merchant_confirmed boolean")
    sums = spark.createDataFrame([(7, 1.0, 1000), (8, 1.0, 1000), (9, 1.0, 1000)], "ad_id int, spend double, impressions int")
    assert rows(economics.shared_exposure_conflicts(sums, targets, stock)) == [(7, 2, 1, 1.0, 1000, "HIGH", 0.6, 3.0)]
    assert rows(economics.shared_exposure_conflicts(sums.withColumn("impressions", F.lit(999)), targets, stock)) == []


def test_delay_without_sessions(spark):
    bought = spark.sql("select 1L purchase_id, 5L visitor_id, timestamp'2024-03-01 10:00:00' purchased_at union all select 2L, 6L, timestamp'2024-03-01 10:00:00'")
    sessions = spark.sql("select 5L visitor_id, timestamp'2024-03-01 09:59:58.5' started_at union all select 5L, timestamp'2023-03-01 09:00:00' union all select 6L, timestamp'2024-03-01 10:00:01'")
    got = {r.purchase_id: r.delay_ms for r in storefront.conversion_delays(bought, sessions).collect()}
    assert got == {1: 1500, 2: None}


def test_largest_drop_skips_stages_without_evidence(spark):
    names = ["sessions", "view_sessions", "cart_sessions", "checkout_sessions", "cart_view_checkout_sessions", "checkout_purchase_sessions", "cart_view_sessions"]
    data = [(10, 5, 4, 2, 2, 2, 4), (10, 12, 6, 0, 0, 0, 6), (0, 0, 0, 0, 0, 0, 0), (10, 5, 5, 4, 5, 2, 5)]
    got = [(r.largest_drop_stage, r.largest_drop) for r in storefront.largest_drop(spark.createDataFrame(data, names)).collect()]
    assert got == [("SESSION_TO_PRODUCT", 0.5), ("CART_TO_CHECKOUT", 1.0), (None, None), ("SESSION_TO_PRODUCT", 0.5)]


def test_weighted_confidence_is_exact(spark):
    """The mean of equal confidences is that confidence, however spend adds up."""
    from marketspan.operators import advertising as ads

    facts = spark.range(600).selectExpr("'CURRENT' period", "id ad_id", "'EUR' currency", "explode(transform(sequence(1, 9), j -> cast((id * 7919 + j * 104729) / 10000 as decimal(24,4)))) spend", "1L impressions", "cast(null as decimal(24,2)) conversion_value")
    classes = spark.range(600).selectExpr("id ad_id", "'EXACT' mapping_class", "id div 3 product_id", "0.7D confidence", "false merchant_confirmed")
    metrics = spark.createDataFrame([], "period string, product_id long, net_units long, net_revenue double, cost_coverage double, contribution_before_ads double")
    got = ads.product_ads(metrics, facts, classes, "EUR").where("period = 'CURRENT'")
    assert {r.mapping_confidence for r in got.collect()} == {0.7}


def test_decisions_in_sql_do_not_hang_on_the_order_of_sums():
    from marketspan.plans.registry import ORACLE_SQL

    for name in ("R-25_product_decisions", "W-16_decisions"):
        assert "cast(spend as double) * cast(confidence as double)" not in ORACLE_SQL[name] and "round(w / exact_spend, 12)" in ORACLE_SQL[name]
