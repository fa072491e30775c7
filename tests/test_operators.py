"""Null and edge rules on hand-made rows."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from marketspan.functions import dates, exprs, web
from marketspan.operators import advertising, changes, commerce, delivery, joins, mapping, rules, storefront, textindex, workspaces
from marketspan.sources import sinks
from marketspan.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_changes_and_division(spark):
    n = F.lit
    row = one(spark, exprs.percent_change(n(0), n(0)), exprs.percent_change(n(5), n(0)), exprs.percent_change(n(5), n(-10)), exprs.rule_change(n(0), n(0)), exprs.safe_div(n(1), n(0)), exprs.half_up(n(-2.5), 0), exprs.complement(n(None).cast("double")), exprs.numeric(n("x")))
    assert list(row) == [0.0, None, 1.5, None, None, -2.0, None, 0.0]


def test_incomplete_sums_stay_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    got = {r.k: r.s for r in df.groupBy("k").agg(exprs.sum_if_complete(F.col("v")).alias("s")).collect()}
    assert got == {"a": None, "b": 2}


def test_empty_choice_selects_nothing(spark):
    assert spark.range(3).where(exprs.selected(F.col("id"), [])).count() == 0


def test_line_refunds_are_capped_and_removals_count(spark):
    schema = "quantity int, current_quantity int, refunded_units int, restocked_units int, revenue decimal(20,4), refund_value decimal(20,4)"
    df = spark.createDataFrame([(10, 10, 5, 2, 100, 150), (10, 7, 0, 0, 100, 0), (0, 0, 0, 0, 0, 0)], "quantity int, current_quantity int, refunded_units int, restocked_units int, revenue int, refund_value int").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.replace("decimal(20,4)", "decimal(20\u00014)").replace(", ", ",").split(",") for c in [c.replace("\u0001", ",")]])
    got = [(r.adjusted_units, r.adjusted_value, r.cost_units) for r in commerce.with_adjustments(df).collect()]
    assert got == [(5, 100.0, 8), (3, 30.0, 10), (0, 0.0, 0)]


def test_asof_takes_the_latest_start_and_excludes_the_end(spark):
    t = lambda x: None if x is None else datetime(2024, 1, 1, 0, x)
    left = spark.createDataFrame([(1, t(5)), (1, t(10)), (1, t(1)), (2, t(5)), (1, None), (None, t(5))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, t(2), t(10), "a"), (1, t(4), None, "b"), (1, t(10), t(11), "c"), (1, t(9), t(9), "never"), (None, t(1), None, "no key"), (1, None, None, "no start")], "k int, f timestamp_ntz, u timestamp_ntz, v string")
    for join in (joins.asof_join, joins.asof_few):
        got = join(left, right, on=["k"], at="t", begins="f", ends="u", take=["v"])
        assert sorted(((r.k, r.t, r.v) for r in got.collect()), key=str) == sorted([(1, t(1), None), (1, t(5), "b"), (1, t(10), "c"), (2, t(5), None), (1, None, None), (None, t(5), None)], key=str)


def test_asof_with_nested_versions(spark):
    """Versions inside of each other, over days and years, against every pair."""
    import random

    rng, day = random.Random(4), datetime(2024, 1, 1)
    at = lambda: day + timedelta(seconds=rng.choice([60, 3600, 86400]) * rng.randint(-400, 400))
    versions = [(k % 3, b, rng.choice([None, b + timedelta(minutes=rng.choice([1, 300, 40_000, 900_000]))]) if k % 20 == 0 else b + timedelta(minutes=rng.choice([1, 300, 40_000])), k) for k in range(120) for b in [at()]]
    times = [(k % 4, at(), k) for k in range(300)]
    got = joins.asof_join(spark.createDataFrame(times, "k int, t timestamp_ntz, n int"), spark.createDataFrame(versions, "k int, f timestamp_ntz, u timestamp_ntz, v int"), on=["k"], at="t", begins="f", ends="u", take=["v"])
    end = datetime(9999, 1, 1)
    best = lambda k, t: max(((f, u or end, v) for k2, f, u, v in versions if k2 == k and f <= t and (u is None or u > t)), default=(0, 0, None))[2]
    assert {r.n: r.v for r in got.collect()} == {n: best(k, t) for k, t, n in times}


def test_asof_with_many_versions_of_one_key(spark):
    """The rows that joins and windows see are in proportion to versions plus times, not to their product."""
    n = 10_000
    versions = spark.range(n).selectExpr("1 k", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, cast(id as int) * 10) f", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, cast(id as int) * 10 + 9) u", "id v")
    times = spark.range(n).selectExpr("1 k", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, cast(id as int) * 10 + cast(id as int) % 10) t", "id n")
    got = joins.asof_join(times, versions, on=["k"], at="t", begins="f", ends="u", take=["v"])
    got.collect()
    wrong = got.where("not (v <=> if(n % 10 = 9, null, n))").count()
    plan = got._jdf.queryExecution().executedPlan()
    most, stack = 0, [plan]
    while stack:
        node = stack.pop()
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            most = max(most, rows.get().value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    assert wrong == 0 and 0 < most < 10 * n


def test_band_join(spark):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    left = [(k % 2, k, t(37 * k)) for k in range(60)] + [(None, 99, t(0)), (0, 98, None)]
    right = [(k % 2, k, t(23 * k + 0.5)) for k in range(100)] + [(0, 200, t(37 * 4 - 60)), (0, 201, t(37 * 4 + 5))]
    got = joins.band_join(spark.createDataFrame(left, "k int, a int, t timestamp_ntz"), spark.createDataFrame(right, "k int, b int, u timestamp_ntz"), on=["k"], at="t", when="u", before=60, after=5)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    want = [(a, b) for k, a, x in left for k2, b, y in right if k is not None and k == k2 and x is not None and -60 <= (y - x).total_seconds() <= 5]
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want) and (4, 200) in want and (4, 201) in want


def test_or_key_counts(spark):
    a = spark.createDataFrame([(1, "s", "v"), (2, "s", None), (3, None, "v"), (4, "q", "q"), (1, "s", "v")], "i int, s string, v string")
    b = spark.createDataFrame([(7, "s", "v"), (8, "x", "v"), (9, None, "v"), (10, None, None), (11, "s", None)], "j int, s2 string, v2 string")
    assert sorted((r.i, r.n) for r in joins.or_key_counts(a, b, ("s", "s2"), ("v", "v2"), "n").collect()) == [(1, 4), (1, 4), (2, 2), (3, 3), (4, 0)]


def test_or_keys_join_once(spark):
    a = spark.createDataFrame([(1, "s", "v")], "i int, s string, v string")
    b = spark.createDataFrame([(7, "s", "v"), (8, "x", "v"), (9, None, "v"), (10, None, None)], "j int, s2 string, v2 string")
    got = joins.or_key_join(a, b, [("s", "s2"), ("v", "v2")])
    assert sorted(r.j for r in got.collect()) == [7, 8, 9]


def test_withdrawn_events_go(spark):
    e = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 1), (4, None, 1)], "id int, s string, t int")
    gone = spark.createDataFrame([("a", 5), ("a", 3)], "scope_key string, revoked_before int")
    assert sorted(r.id for r in joins.without_revoked(e, gone, scopes=["s"], at="t").collect()) == [2, 3, 4]


def test_mapping_classes(spark):
    m = spark.createDataFrame([(1, 10, 0.7, False), (2, 10, 0.69, False), (3, 10, 0.1, True), (3, 11, 0.99, False), (4, 10, 1.0, True), (4, 11, 1.0, True), (5, 10, 0.4, True), (7, 1, 0.8, False), (7, 2, 0.9, None)], "ad_id int, product_id int, confidence double, is_merchant_confirmed boolean")
    got = {r.ad_id: (r.mapping_class, r.product_id, r.confidence) for r in advertising.classify_mappings(m, spark.createDataFrame([(5,)], "ad_id int")).collect()}
    assert got == {1: ("EXACT", 10, 0.7), 2: ("AMBIGUOUS", None, 0.0), 3: ("EXACT", 10, 1.0), 4: ("AMBIGUOUS", None, 1.0), 5: ("SHARED", None, 0.4), 7: ("AMBIGUOUS", None, 0.9)}


def test_product_ads_never_take_missing_spend_as_none(spark):
    metrics = spark.createDataFrame([("CURRENT", 1, 5, 100.0, 1.0, 40.0), ("CURRENT", 2, 5, 300.0, 0.5, None)], "period string, product_id int, net_units int, net_revenue double, cost_coverage double, contribution_before_ads double")
    facts = spark.createDataFrame([("CURRENT", 8, "EUR", 30.0, 10, 60.0), ("CURRENT", 9, "EUR", 10.0, 10, None), ("CURRENT", 8, "USD", 99.0, 10, 1.0)], "period string, ad_id int, currency string, spend double, impressions int, conversion_value double")
    classes = spark.createDataFrame([(8, "EXACT", 2, 0.8, False), (7, "EXACT", 3, 0.9, True), (9, "SHARED", None, 0.9, True)], "ad_id int, mapping_class string, product_id int, confidence double, merchant_confirmed boolean")
    got = {r.product_id: r for r in advertising.product_ads(metrics, facts, classes, "EUR").where("period = 'CURRENT'").collect()}
    assert (got[1].contribution_after_ads, got[1].exact_spend, got[1].revenue_share, got[1].mapped_ads) == (None, 0.0, 0.25, 0)
    assert (got[2].contribution_after_ads, got[2].exact_spend, got[2].spend_share, got[2].roas, got[2].mapping_confidence) == (None, 30.0, 0.75, 2.0, 0.8)
    assert (got[3].net_revenue, got[3].contribution_after_ads, got[3].mapping_confidence, got[3].merchant_confirmed) == (0.0, None, 0.9, True)


def test_daily_series_keeps_currencies_and_levels_apart(spark):
    d = date(2024, 1, 1)
    rows = [(d, "META", "AD", "EUR", 1.0, 1, 1, 1, 5.0), (d, "META", "CAMPAIGN", "EUR", 9.0, 9, 9, 9, 9.0), (d, "GOOGLE", "ACCOUNT", "EUR", 2.0, 1, 1, None, 1.0), (d, "GOOGLE", "AD", "EUR", 9.0, 9, 9, 9, 9.0), (d, "TIKTOK", "AD", None, 4.0, 1, 1, 1, 1.0)]
    facts = spark.createDataFrame(rows, "date date, provider string, level string, currency string, spend double, impressions int, clicks int, conversions int, conversion_value double")
    assert sorted((r.currency, r.spend, r.purchases, r.purchase_value) for r in advertising.daily_series(facts).collect()) == [("EUR", 3.0, None, 6.0), ("UNKNOWN", 4.0, 1, 1.0)]


def test_purchase_actions_pick_one_type(spark):
    a = spark.createDataFrame([(1, "ACTION", "purchase", 1.0), (1, "ACTION", "offsite_pixel_purchase", 2.0), (1, "ACTION", "omni_purchase", 3.0), (2, "ACTION", "b_purchase", 1.0), (2, "ACTION", "a_purchase", 1.0), (3, "ACTION", "click", 1.0)], "insight_id int, kind string, action_type string, value double")
    assert sorted((r.insight_id, r.action_type) for r in advertising.purchase_actions(a).collect()) == [(1, "offsite_pixel_purchase"), (2, "a_purchase")]


SESSION = "session_id string, visitor_id int, started_at timestamp_ntz, ended_at timestamp_ntz, checkout_completed_at timestamp_ntz, linked_purchase boolean"


def test_attribution_gives_no_credit_after_the_purchase(spark):
    """META first and assisting, C last; the touch after the checkout counts as touched only."""
    d = lambda x, h=0: datetime(2024, 2, x, h)
    sessions = spark.createDataFrame([(f"s{k}", 7, d(k), d(k, 9), d(k, 5) if k == 20 else None, k == 20) for k in (1, 10, 20)], SESSION)
    t = spark.createDataFrame([("s1", 7, d(1), d(1), 1, "META", 4), ("s10", 7, d(10), d(10), 1, "B", None), ("s20", 7, d(20), d(20), 1, "C", 5), ("s20", 7, d(20), d(20, 6), 2, "D", None)], "session_id string, visitor_id int, session_started_at timestamp_ntz, touched_at timestamp_ntz, ordinal int, source string, ad_id int")
    got = {r.key: r for r in storefront.attribution(sessions, t).collect() if r.purchases}
    assert {k: (r.first_touch, r.last_touch, r.assisted, r.single_touch, r.cross_session) for k, r in got.items()} == {"META": (1, 0, 1, 0, 1), "4": (1, 0, 1, 0, 1), "B": (0, 0, 1, 0, 1), "C": (0, 1, 0, 0, 1)}
    assert {r.delay_ms for r in got.values()} == {(19 * 24 + 5) * 3600 * 1000}
    assert {r.key: r.touched_sessions for r in storefront.attribution(sessions, t).where("day = '2024-02-20'").collect()}["D"] == 1


def test_attribution_of_one_visitor_with_many_events(spark):
    """A bot's purchases and touches meet by day, not all with all."""
    n = 3000
    sessions = spark.range(n).selectExpr("concat('s', id) session_id", "7 visitor_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int) * 20) started_at").withColumn("ended_at", F.col("started_at")).withColumn("checkout_completed_at", F.col("started_at")).withColumn("linked_purchase", F.lit(True))
    t = sessions.selectExpr("session_id", "visitor_id", "started_at session_started_at", "started_at touched_at", "1 ordinal", "concat('S', cast(substr(session_id, 2) as int) % 3) source", "cast(null as int) ad_id")
    total = storefront.attribution(sessions, t).agg(F.sum("last_touch"), F.sum("first_touch"), F.sum("touched_sessions")).first()
    assert list(total) == [n, n, n]


def test_last_before_takes_ties_and_bounds(spark):
    d = lambda x, h=0: datetime(2024, 2, x, h)
    left = spark.createDataFrame([(1, d(20, 5)), (2, d(20, 5)), (3, d(20, 5))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, d(20, 5), 1), (1, d(20, 5), 2), (1, d(20, 6), 9), (2, d(18), 3), (2, d(17), 4), (3, d(10, 4), 5)], "k int, u timestamp_ntz, id int")
    got = joins.last_before(left, right, on=["k"], at="t", when="u", days=10, ties=["id"], take=[])
    assert sorted((r.k, r._last.id if r._last else None) for r in got.collect()) == [(1, 2), (2, 3), (3, None)]


def test_late_bounds(spark):
    e = spark.sql("select timestamp'2024-01-08 00:00:00' received_at, x event_at from values (timestamp'2024-01-01 00:00:00'), (timestamp'2023-12-31 23:59:59.999'), (timestamp'2024-01-08 00:10:00'), (timestamp'2024-01-08 00:10:00.001') t(x)")
    assert storefront.accepted(e).count() == 2


def test_landing_pages_and_urls(spark):
    urls = {
        "https://X.com/products/a?q=1": "https://x.com/products/a", "https://x.com/fr/products/a": "https://x.com/:other", "https://x.com:443/collections/c/d": "https://x.com/collections/c", "https://x.com/blogs/n/p/q": "https://x.com/blogs/n/p", "https://x.com/blogs/n/-": "https://x.com/blogs/n",
        "https://x.com": "https://x.com/", "https://x.com/cart/7": "https://x.com/cart", "https://x.com/search/x": "https://x.com/search", "https://x.com/products/-a": "https://x.com/:other", "http://x.com:8080/account/1": "http://x.com:8080/:other", "ftp://x": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", web.landing_page(F.col("u")).alias("p"))
    assert {r.u: r.p for r in df.collect()} == urls
    n = F.lit
    row = one(spark, web.sanitize_url(n("HTTPS://me:pw@X.com/a?b#c")), web.query_value(n("https://x/?utm_source=a%20b"), "utm_source"), web.host(n("https://www.X.com:80/")), web.numeric_tail(n("gid/12")), web.sanitize_url(n("https://x.com/123/Checkouts/secret")), web.sanitize_url(n("https://x.com/cart/c/tok")), web.attribution_value(n("https://x/?fbclid=a%20b"), "fbclid"), web.attribution_value(n("https://x/?utm_term=a@b.c"), "utm_term"), web.attribution_value(n("https://x/?ad_id=12"), "ad_id"))
    assert list(row) == ["https://x.com/a", "a b", "x.com", "12", "https://x.com/checkouts", "https://x.com/cart", None, None, "12"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"meta_click": "m", "google_click": "g"}, ("PAID_SOCIAL", "META", "META_CLICK", True)),
        ({"google_click": "g"}, ("OTHER", "GOOGLE", "GOOGLE_CLICK", True)),
        ({"google_click": "g", "utm_medium": "PPC"}, ("PAID_SEARCH", "GOOGLE", "GOOGLE_CLICK", True)),
        ({"utm_source": "fb", "utm_medium": "cpc"}, ("PAID_SOCIAL", "META", "UTM", True)),
        ({"utm_source": "google", "utm_medium": "cpc"}, ("OTHER", "GOOGLE", "UTM", True)),
        ({"utm_source": "Klaviyo", "utm_medium": "email"}, ("EMAIL", "KLAVIYO", "UTM", False)),
        ({"utm_source": "x", "utm_medium": "affiliate"}, ("AFFILIATE", "OTHER", "UTM", None)),
        ({"utm_medium": "organic", "utm_source": "youtube"}, ("ORGANIC_SOCIAL", "YOUTUBE", "UTM", False)),
        ({"referrer": "https://www.google.co.uk/"}, ("ORGANIC_SEARCH", "GOOGLE", "REFERRER", False)),
        ({"referrer": "https://mail.google.com/"}, ("EMAIL", "GOOGLE", "REFERRER", False)),
        ({"referrer": "https://l.facebook.com/"}, ("ORGANIC_SOCIAL", "META", "REFERRER", False)),
        ({"referrer": "https://news.org/"}, ("REFERRAL", "OTHER", "REFERRER", None)),
        ({"referrer": "https://shop.example/a"}, ("DIRECT", None, "NO_EXTERNAL_EVIDENCE", None)),
        ({"page": None}, ("UNKNOWN", None, "NO_EVIDENCE", None)),
    ],
)
def test_acquisition(spark, given, want):
    names = ["meta_click", "tiktok_click", "google_click", "tiktok_link", "meta_link", "utm_source", "utm_medium", "utm_campaign", "referrer", "page"]
    values = dict.fromkeys(names) | {"page": "https://shop.example/"} | given
    assert tuple(one(spark, web.acquisition(**{k: F.lit(v).cast("string") for k, v in values.items()}))[0]) == want


def fired(spark, family, values):
    """Rule -> (severity, impact, confidence, urgency) over one row of evidence."""
    kinds = {c: "double" if isinstance(v, (int, float)) and not isinstance(v, bool) or v is None else "boolean" if isinstance(v, bool) else "string" for c, v in values.items()}
    row = [float(v) if kinds[c] == "double" and v is not None else v for c, v in values.items()]
    e = spark.createDataFrame([("e", *row)], "entity_id string, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return {r.rule_id: (r.severity, round(r.impact, 4), round(r.confidence, 4), round(r.urgency, 4)) for r in rules.apply_rules({family: e}).collect()}


STORE = {"orders": 20, "orders0": 20, "refund_rate": 0.08, "refund_rate0": 0.04, "discount_rate": 0.0, "discount_rate0": 0.0, "segment_coverage": 0.0, "segment_coverage0": 0.0, "known_orders": 0, "known_orders0": 0, "returning_share": 0.0, "returning_share0": 0.0}
PAID = {"impressions": 1000, "impressions0": 1000, "spend": 115, "spend0": 100, "roas": 1.6, "roas0": 2.0, "cpa": None, "cpa0": None, "ctr": 0.01, "ctr0": 0.01, "cpm": 1.0, "cpm0": 1.0, "frequency": 1.0, "frequency0": 1.0, "spend_share": 0.3}
PRODUCT = {"units": 5, "net_revenue": 100, "revenue_share": 0.3, "spend": 0, "impressions": 0, "spend_share": 0.0, "mapping_confidence": 0.9, "mapping_coverage": 0.7, "cost_coverage": 0.9, "roas": None, "contribution_after_ads": None, "inventory_trusted": False, "stock": None, "velocity": None}
FUNNEL = {k + z: v for k, v in {"sessions": 200, "view_sessions": 100, "cart_view_sessions": 40, "checkout_sessions": 30, "conversion_rate": 0.05, "view_to_cart": 0.2, "cart_abandonment": 0.4, "checkout_abandonment": 0.2}.items() for z in ("", "0")}


@pytest.mark.parametrize(("change", "fires"), [({}, True), ({"refund_rate": 0.049}, False), ({"orders": 19}, False), ({"refund_rate0": None}, False), ({"refund_rate0": 0.0}, True)])
def test_refund_rule_thresholds(spark, change, fires):
    assert ("refund_rate_deterioration" in fired(spark, "store", STORE | change)) == fires


@pytest.mark.parametrize(
    ("family", "values", "rule", "want"),
    [
        ("campaign", PAID | {"roas": 1.5}, "campaign_efficiency_deterioration", ("MEDIUM", 0.3, 0.575, 0.625)),
        ("campaign", PAID | {"roas": 1.3}, "campaign_efficiency_deterioration", ("HIGH", 0.3, 0.575, 0.675)),
        ("campaign", PAID | {"spend": 114}, "campaign_efficiency_deterioration", None),
        ("campaign", PAID | {"impressions0": 999}, "campaign_efficiency_deterioration", None),
        ("ad", PAID | {"roas": 1.5}, "ad_efficiency_deterioration", ("MEDIUM", 0.3, 0.725, 0.6625)),
        ("ad", PAID | {"roas": 1.2, "ctr": None}, "ad_efficiency_deterioration", ("HIGH", 0.3, 0.645, 0.73)),
        ("ad", PAID, "ad_efficiency_deterioration", None),
        ("creative", PAID | {"frequency": 1.25, "ctr": 0.006, "roas": 1.5}, "creative_fatigue_symptoms", ("HIGH", 0.3, 0.6667, 0.73)),
        ("creative", PAID | {"frequency": 1.19, "ctr": 0.006, "roas": 1.5}, "creative_fatigue_symptoms", None),
        ("product", PRODUCT, "underexposed_commerce_winner", ("HIGH", 0.3, 0.915, 0.9)),
        ("product", PRODUCT | {"mapping_coverage": 0.2}, "underexposed_commerce_winner", ("HIGH", 0.3, 0.489, 0.9)),
        ("product", PRODUCT | {"units": 4}, "underexposed_commerce_winner", None),
        ("product", PRODUCT | {"spend_share": 0.5, "revenue_share": 0.2, "impressions": 10_000}, "paid_commerce_exposure_mismatch", ("HIGH", 0.5, 0.92, 0.9)),
        ("product", PRODUCT | {"roas": 1.5, "contribution_after_ads": 0.0}, "provider_roas_margin_trap", ("HIGH", 0.3, 0.965, 0.8)),
        ("product", PRODUCT | {"inventory_trusted": True, "spend": 1, "stock": 20, "velocity": 2}, "inventory_spend_conflict", ("HIGH", 0.3, 0.8, 0.55)),
        ("product", PRODUCT | {"inventory_trusted": True, "spend": 1, "stock": 10, "velocity": 2}, "inventory_spend_conflict", ("CRITICAL", 0.3, 0.8, 0.775)),
        ("product", PRODUCT | {"inventory_trusted": True, "spend": 1, "stock": -1, "velocity": 2}, "inventory_spend_conflict", None),
        ("product", PRODUCT | {"inventory_trusted": True, "stock": 14, "velocity": 2}, "inventory_runway_risk", ("CRITICAL", 0.3, 0.82, 0.55)),
        ("product", PRODUCT | {"inventory_trusted": True, "stock": -3, "velocity": 2}, "inventory_runway_risk", None),
        ("store", STORE | {"refund_rate": 0.13}, "refund_rate_deterioration", ("HIGH", 0.18, 0.72, 0.64)),
        ("store", STORE | {"discount_rate": 0.2, "discount_rate0": 0.1}, "discount_dependency_deterioration", ("HIGH", 0.2, 0.7, 0.55)),
        ("store", STORE | {"segment_coverage": 0.8, "segment_coverage0": 0.8, "known_orders": 20, "known_orders0": 20, "returning_share": 0.35, "returning_share0": 0.6}, "returning_customer_deterioration", ("HIGH", 0.7, 0.74, 0.7)),
        ("mapping", {"spend": 1, "mapping_coverage": 0.29}, "mapping_coverage_degraded", ("HIGH", 0.71, 0.95, 0.8)),
        ("mapping", {"spend": 1, "mapping_coverage": 0.6}, "mapping_coverage_degraded", None),
        ("attribution", {"quality": "READY", "provider_purchases": 20, "first_party_purchases": 14, "sessions": 100}, "provider_first_party_purchase_gap", ("MEDIUM", 0.3, 0.7236, 0.63)),
        ("attribution", {"quality": "DEGRADED", "provider_purchases": 20, "first_party_purchases": 10, "sessions": 100}, "provider_first_party_purchase_gap", None),
        ("storefront", FUNNEL | {"cart_abandonment": 0.52}, "cart_abandonment_deterioration", ("MEDIUM", 0.52, 0.62, 0.67)),
        ("storefront", FUNNEL | {"cart_abandonment": 0.5, "cart_view_sessions0": 29}, "cart_abandonment_deterioration", None),
        ("storefront", FUNNEL | {"checkout_abandonment": 0.4}, "checkout_abandonment_deterioration", ("HIGH", 0.4, 0.62, 0.8)),
        ("storefront", FUNNEL | {"view_to_cart": 0.1}, "view_to_cart_deterioration", ("HIGH", 0.625, 0.76, 0.65)),
        ("storefront", FUNNEL | {"conversion_rate": 0.03}, "storefront_conversion_deterioration", ("MEDIUM", 0.67, 0.76, 0.65)),
        ("landing_page", FUNNEL | {"conversion_rate": 0.03}, "landing_page_quality_deterioration", ("MEDIUM", 0.48, 0.76, 0.59)),
        ("storefront_product", {"product_views": 500, "product_views0": 500, "purchase_rate": 0.01, "purchase_rate0": 0.05}, "high_traffic_low_conversion_product", ("HIGH", 0.65, 0.9, 0.6333)),
        ("storefront_product", {"product_views": 500, "product_views0": 500, "purchase_rate": 0.01, "purchase_rate0": 0.05}, "product_conversion_deterioration", None),
        ("storefront_product", {"product_views": 100, "product_views0": 100, "purchase_rate": 0.01, "purchase_rate0": 0.05}, "product_conversion_deterioration", ("HIGH", 0.52, 0.76, 0.74)),
    ],
)
def test_rules(spark, family, values, rule, want):
    got = fired(spark, family, values).get(rule)
    assert got == want


def test_data_quality_lowers_confidence(spark):
    drafts = spark.createDataFrame([("r", "META_PROVIDER", 0.9, "HIGH"), ("p", "EXACT_PRODUCT", 0.9, "HIGH")], "rule_id string, precision string, confidence double, evidence_quality string")
    quality = spark.createDataFrame([("PRODUCT_AD_MAPPING_LOW", "WARNING"), ("PIXEL_NOT_ACTIVE", "WARNING"), ("CORE", "HEALTHY")], "code string, status string")
    got = {r.rule_id: (r.limitations, round(r.confidence, 4), r.evidence_quality) for r in rules.with_data_quality(drafts, quality).collect()}
    assert got == {"r": ([], 0.9, "HIGH"), "p": (["PRODUCT_AD_MAPPING_LOW"], 0.828, "HIGH")}


def test_catalog_items(spark):
    v = spark.createDataFrame([(1, "A", 10, "h", "red", "m"), (2, "B", 10, "h", "blue", "m"), (3, "A", 11, "k", "red", "m")], "variant_id long, sku string, product_id long, handle string, color string, size string")
    u = "https://s.com/products/"
    items = [(1, "B", None, None, None, None), (2, "A", None, None, None, None), (3, None, u + "h?variant=2", None, None, None), (4, None, u + "h", None, "red", None), (5, None, u + "k", None, "blue", None), (6, None, u + "h", None, None, "m"), (7, None, None, "10", None, None), (8, None, None, "11", None, None), (9, "zz", u + "none", None, None, None)]
    i = spark.createDataFrame(items, "item_id long, retailer_id string, url string, group_id string, color string, size string")
    got = {r.item_id: (r.state, r.confidence, r.variant_id) for r in mapping.resolve_catalog_items(i, v).collect()}
    assert got == {1: ("MAPPED", 1.0, 2), 2: ("AMBIGUOUS", 0.0, None), 3: ("MAPPED", 1.0, 2), 4: ("MAPPED", 0.99, 1), 5: ("MAPPED", 0.95, 3), 6: ("MAPPED", 0.95, None), 7: ("AMBIGUOUS", 0.0, None), 8: ("MAPPED", 0.95, 3), 9: ("UNMAPPED", 0.0, None)}


def test_ad_targets_and_ids(spark):
    e = spark.createDataFrame([(1, "URL_PRODUCT", "p"), (1, "STRUCTURED_ID", "q"), (2, "TAG_PRODUCT", "p"), (2, "TAG_PRODUCT", "q"), (3, "COLLECTION", "c")], "ad_id int, source string, target_id string")
    got = {r.ad_id: (r.target_scope, r.confidence, r.target_id) for r in mapping.resolve_ads(spark.createDataFrame([(k,) for k in range(1, 5)], "ad_id int"), e).collect()}
    assert got == {1: ("PRODUCT", 1.0, "q"), 2: ("MULTI_PRODUCT", 0.95, None), 3: ("COLLECTION", 0.95, "c"), 4: ("UNKNOWN", 0.0, None)}
    j = spark.createDataFrame([('{"a": [{"Product_ID": 7}, {"x": {"sku": "S-1"}}], "item_ids": ["3", 4], "other": 9}',), (None,)], "j string")
    assert [r.ids for r in mapping.provider_ids(j, "j").collect()] == [["3", "4", "7", "S-1"], None]
    deep = ['{"note": "\\"sku\\": \\"no\\" {[", "a": {"b": [{"c": {"d": [{"SKU": "deep"}]}}]}}', '{"sku": ["a", ["nested"], {"sku": " b "}, true, null, ""], "product_ids": {"sku_id": 5}}', "[[[[[1]]]]]", "no json", "7", "{}", '[{"item_id": 1.5}, {"item_id": 1.5}]']
    j = spark.createDataFrame(list(enumerate(deep)) + [(7, None), (8, "{}")], "n int, j string")
    assert [r.ids for r in mapping.provider_ids(j, "j").orderBy("n").collect()] == [["deep"], ["5", "a", "b"], [], None, [], [], ["1.5"], None, []]
    with pytest.raises(Exception, match="deeper"):
        mapping.provider_ids(j, "j", depth=3).collect()
    assert one(spark, mapping.compatible_form(F.lit("ﬁ①")))[0] == "fi1"


def test_text_suggestions_contain_titles(spark):
    ads = spark.createDataFrame([(1, "Red Shoe"), (2, "The red-shoe, now!"), (3, "hundred shoes"), (3, "red  SHOE"), (4, None), (5, "")], "ad_id int, text string")
    got = mapping.text_suggestions(ads, spark.createDataFrame([("Red shoe",), ("red",), ("shoes",), (None,), ("now!",)], "title string"))
    assert sorted((r.ad_id, r.title, r.confidence) for r in got.where("title <> 'now!'").collect()) == [(1, "Red shoe", 0.75), (2, "Red shoe", 0.65), (3, "Red shoe", 0.75), (3, "shoes", 0.65)]
    many = spark.createDataFrame([(f"title {k}",) for k in range(9)], "title string")
    assert [r.title for r in mapping.text_suggestions(spark.createDataFrame([(1, " ".join(f"title {k}" for k in range(9)))], "ad_id int, text string"), many).orderBy("place").collect()] == [f"title {k}" for k in range(5)]


def test_containment_equals_all_pairs(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    needles, texts = sorted({word(rng.randint(0, 7)) for _ in range(120)}), sorted({word(rng.randint(0, 40)) for _ in range(150)})
    got = textindex.contained(spark.createDataFrame([(x,) for x in [*needles, None]], "needle string"), spark.createDataFrame([(x,) for x in [*texts, None]], "text string"), needle="needle", text="text")
    assert sorted((r.needle, r.text) for r in got.collect()) == sorted((a, b) for a in needles for b in texts if a and a in b)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_search_by_grams(spark):
    p = spark.createDataFrame([(1, "Red shoe", "Acme"), (2, "Blue", None), (3, None, "red"), (4, "x", "y")], "product_id int, title string, vendor string")
    v = spark.createDataFrame([(2, "SKU-RED-1"), (4, "z"), (4, None)], "product_id int, sku string")
    find = lambda q: sorted(r.product_id for r in commerce.search(p, v, q, commerce.search_index(p, v)).collect())
    assert (find("RED"), find("d s"), find("u"), find("nothing"), find("")) == ([1, 2, 3], [1], [2], [], [1, 2, 3, 4])


def test_customer_matching(spark):
    n = lambda x: F.lit(x).cast("string")
    row = one(spark, delivery.normalized_email(n(" A.b+c@GMail.com ")), delivery.normalized_email(n("A.b+c@gmail.com"), True), delivery.normalized_email(n("x@y")), delivery.normalized_phone(n("+49 (30) 123-4567")), delivery.normalized_phone(n("030 1234567")))
    assert list(row) == ["a.b+c@gmail.com", "ab@gmail.com", None, "+49301234567", None]


def test_keyed_identity_and_lists(spark):
    import hashlib
    import hmac

    for secret in ("k", "x" * 64, "long" * 40, "schlüssel"):
        row = one(spark, delivery.hmac_sha256(secret, F.lit("a ü \n")), delivery.customer_identity(secret, F.lit(7), F.lit("c\"1")))
        assert list(row) == [hmac.new(secret.encode(), m.encode(), "sha256").hexdigest() for m in ("a ü \n", '["customer-v1","7","c\\"1"]')]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    n, arr = (lambda x: F.lit(x).cast("string")), (lambda *x: F.array(*[F.lit(v).cast("string") for v in x]))
    match = lambda **k: one(spark, *[v.alias(n) for n, v in delivery.customer_match(**(dict.fromkeys(("first_name", "last_name", "city", "region", "postal_code", "country", "external_id"), n(None)) | {"emails": arr(None), "phones": arr(None)} | k)).items()])
    assert len(delivery.iso_countries()) > 240
    got = match(emails=arr(" A@b.de", "a@B.de ", None, "no", *[f"u{k}@x.io" for k in range(12)]), phones=arr("+49 30 1", "+49 (30) 123456", "030 1"), first_name=n("Ann-Marie 2"), last_name=n("O'Neil"), city=n("St. Gallen"), region=n(" "), postal_code=n(" SW1 2-3 "), country=n(" NZ"), external_id=n("7"))
    assert got.em == [sha("a@b.de"), *[sha(f"u{k}@x.io") for k in range(9)]] and got.ph == [sha("4930123456")] and got.tiktok_phone == sha("+4930123456")
    assert (got.fn, got.ln, got.ct, got.st, got.zp, got.country, got.external_id) == (sha("annmarie "), sha("oneil"), sha("stgallen"), None, sha("sw12"), sha("nz"), sha("7"))
    assert len(got.google_identifiers) == 10
    got = match(emails=arr("a.b+c@gmail.com"), first_name=n("A"), last_name=n("B"), postal_code=n("1 a"), country=n("de"))
    assert got.google_identifiers == [sha("ab@gmail.com"), f"{sha('a')}|{sha('b')}|DE|1 a"]
    assert list(match(country=n("zz"))) == [[], [], None, None, None, None, None, None, None, None, None, [], False, False]


def test_retries_and_sweeps(spark):
    t = lambda *x: datetime(2024, 1, 1, *x)
    at, lit = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit
    waits = one(spark, *[delivery.retry_at(at, lit(a), lit(r), None if x is None else lit(x)) for a, r, x in ((0, 1.0, None), (1, 1.0, None), (2, 1.0, None), (2, 0.0, None), (9, 1.0, None), (50, 1.0, None), (1, 0.0, 90_000), (3, 1.0, 1000))])
    assert list(waits) == [t(0, 1), t(0, 1), t(0, 2), t(0, 1), t(4, 16), t(4, 16), t(0, 1, 30), t(0, 4)]
    drawn = one(spark, delivery.retry_at(at, lit(3)))[0]
    assert t(0, 2) <= drawn <= t(0, 4)
    asked = one(spark, *[delivery.retry_after_ms(lit(v).cast("string"), at) for v in ("120", " 1.5 ", "9999999", "Mon, 01 Jan 2024 00:01:00 GMT", "Sun, 31 Dec 2023 00:00:00 GMT", "soon", "", None, "-5")])
    assert list(asked) == [120_000, 1500, 604_800_000, 60_000, None, None, None, None, None]
    assert one(spark, delivery.delivery_deadline(at))[0] == datetime(2024, 1, 7, 23, 55)
    assert list(one(spark, *[storefront.link_retry_at(at, lit(a)) for a in (0, 1, 2, 7, 9)])) == [t(0, 5), t(0, 5), t(0, 10), t(5, 20), t(6)]
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 0)], "a int, b int")
    assert [tuple(r) for r in delivery.swept(df, ["a", "b"], [F.lit(1), F.lit(1)], 2).collect()] == [(1, 2), (2, 0)]
    assert [tuple(r) for r in delivery.swept(df, ["a", "b"], [F.lit(9), F.lit(1)], 1).collect()] == [(1, 1)]


def test_links_contents_and_overrides(spark):
    s = spark.sql("select 's' session_id, 'o1' order_ext, 3 attempts, timestamp_ntz'2024-01-01' tried_at union all select 't', 'o2', 20, timestamp_ntz'2024-01-01'")
    got = {r.session_id: (r.link_status, r.next_try_at) for r in storefront.linked_orders(s, spark.createDataFrame([("o1", 5)], "order_ext string, order_id int")).collect()}
    assert got == {"s": ("LINKED", None), "t": ("PENDING", datetime(2024, 1, 1, 6))}
    items = spark.createDataFrame([(1, "v", 2, 5.0), (1, "w", 1, 3.0), (1, "x", 1, 1.0)], "source_event_id int, variant_id string, quantity int, price double")
    known = spark.createDataFrame([("v", "c1"), ("w", "c1"), ("w", "c2")], "variant_id string, catalog_item_id string")
    assert tuple(delivery.contents(items, known).first()) == (1, 3, 1, 1, 4, 14.0)
    now = spark.sql("select 1 ad_id, 10 product_id, 0.8d confidence, false is_merchant_confirmed, timestamp_ntz'2024-01-01' valid_from, cast(null as timestamp_ntz) valid_until")
    after = advertising.overridden_mappings(now, spark.createDataFrame([(1, 11)], "ad_id int, product_id int"), F.lit("2024-02-01").cast("timestamp_ntz"))
    assert sorted((r.product_id, r.is_merchant_confirmed, r.valid_until) for r in after.collect()) == [(10, False, datetime(2024, 2, 1)), (11, True, None)]


def test_video_retention_states(spark):
    rows = [("a", "CURRENT", 100, 50, 40, 30, 20, 10, 4.0), ("b", "CURRENT", 40, 50, 40, 30, 20, 10, 4.0), ("c", "CURRENT", 100, 50, 60, 30, 20, 10, None)]
    got = {r.creative_id: (r.status, r.to_p25, r.largest_drop_stage, r.average_watch_seconds) for r in storefront.video_retention(spark.createDataFrame(rows, "creative_id string, period string, plays int, p25 int, p50 int, p75 int, p95 int, p100 int, watch_seconds double")).collect()}
    assert got["a"] == ("READY", 0.5, "PLAYS_TO_P25", 4.0) and got["b"][0] == "INSUFFICIENT_PLAYS" and got["c"][0] == "INCONSISTENT" and got["c"][3] is None


def test_keyed_writes(spark, tmp_path):
    now = spark.createDataFrame([(1, 1, "old"), (2, 5, "kept")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "new"), (2, 4, "late"), (3, 1, "added")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in sinks.upsert(now, new, ["k"], "v").collect()) == [(1, "new"), (2, "kept"), (3, "added")]
    assert sorted(r.k for r in sinks.delete_missing(now, new.where("k = 2"), ["k"], F.col("k") < 5).collect()) == [2]
    path = str(tmp_path / "days")
    sinks.replace_days(spark.createDataFrame([(1, "a"), (2, "b")], "x int, day string"), path, "day")
    sinks.replace_days(spark.createDataFrame([(3, "b")], "x int, day string"), path, "day")
    assert sorted((r.x, r.day) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-08 00:00:00' received_at, timestamp'2024-01-07 00:00:00' event_at, id % 3 event_id from range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    s = ingest.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    s.awaitTermination(60)
    assert spark.table("seen").count() == 3


def test_windows():
    now = datetime(2024, 3, 10, 3, tzinfo=timezone.utc)
    assert dates.completed_window(now, "America/New_York", 7) == (date(2024, 3, 2), date(2024, 3, 9))
    assert dates.preceding((date(2024, 1, 8), date(2024, 1, 15))) == (date(2024, 1, 1), date(2024, 1, 8))
    with pytest.raises(ValueError):
        dates.ranged_window(None, date(2024, 1, 1))


TOUCH = {n: None for n in delivery.SIGNATURE}


def route(spark, touches, **options):
    """The routing of one conversion on January 31 by touches (days before it, values)."""
    end = datetime(2024, 1, 31)
    rows = [(end - timedelta(days=d), "s", "v", *(TOUCH | t).values()) for d, t in touches]
    schema = "event_at timestamp_ntz, session_id string, visitor_id string, " + ", ".join(f"{n} string" for n in TOUCH)
    made = spark.createDataFrame([(1, end, "s", "v")], "conversion_id int, event_at timestamp_ntz, session_id string, visitor_id string")
    return delivery.routing(made, spark.createDataFrame(rows, schema), since=F.lit("2023-12-15").cast("timestamp_ntz"), **options).first()


def test_routing_by_paid_touches(spark):
    facebook = {"utm_source": "facebook", "utm_medium": "paid_social"}
    r = route(spark, [(3, facebook | {"meta_click": "m"}), (2, {"google_click": "g"}), (1, facebook | {"meta_click": "m", "utm_campaign": "again"})])
    assert (r.eligible_providers, r.paid_touches, r.reason, r.last_provider, r.last_basis) == ("GOOGLE_ADS,META", 2, "PAID_TOUCH_FOUND", "GOOGLE_ADS", "GOOGLE_CLICK")
    # a click alone may decorate any link; with an id in the link it is paid
    assert route(spark, [(1, {"meta_click": "m"})]).reason == "NO_PAID_TOUCH"
    r = route(spark, [(1, {"meta_click": "m", "meta_ad": "7", "meta_campaign": "c"})])
    assert (r.eligible_providers, r.last_ad, r.last_campaign) == ("META", "7", "c")
    assert route(spark, [(1, {"utm_source": "tiktok", "utm_medium": "paid"})]).eligible_providers == "TIKTOK"


def test_routing_refuses_what_is_ambiguous(spark):
    two = route(spark, [(2, {"google_click": "g"}), (1, {"meta_click": "m", "tiktok_click": "t"})])
    assert (two.eligible_providers, two.ambiguous_touches, two.reason, two.last_provider) == ("", 1, "AMBIGUOUS_TOUCH", None)
    assert route(spark, [(1, {"google_click": "g", "utm_source": "facebook", "utm_medium": "cpc"})]).reason == "AMBIGUOUS_TOUCH"
    assert route(spark, [(1, {"google_click": "g", "utm_source": "google", "utm_medium": "organic"})]).reason == "AMBIGUOUS_TOUCH"
    assert route(spark, [(1, {"utm_source": "newsletter", "utm_medium": "email"})]).reason == "NO_PAID_TOUCH"


def test_routing_window_and_limit(spark):
    google = {"google_click": "g"}
    # the first time of a signature counts: one that began before the window is out, one before the store's connection isn't seen
    assert route(spark, [(31, google), (1, google)]).reason == "NO_PAID_TOUCH"
    assert route(spark, [(60, google), (1, google)]).reason == "PAID_TOUCH_FOUND"
    assert route(spark, [(-1, google)]).reason == "NO_PAID_TOUCH"
    assert route(spark, []).reason == "NO_PAID_TOUCH"
    many = route(spark, [(k, {"google_click": f"g{k}"}) for k in range(1, 5)], most=3)
    assert (many.eligible_providers, many.paid_touches, many.reason) == ("", 0, "EVIDENCE_LIMIT_REACHED")


def test_worst_resolution_stands_for_all(spark):
    rows = [("a", "EXACT"), ("a", "PARTIAL"), ("b", "EXACT"), ("b", "NONE"), ("c", "UNRESOLVED"), ("c", "EXACT"), ("d", "CONFLICT"), ("d", "UNRESOLVED")]
    got = storefront.worst_resolution(spark.createDataFrame(rows, "k string, resolution string"), "k").collect()
    assert {r.k: r.resolution for r in got} == {"a": "PARTIAL", "b": "EXACT", "c": "UNRESOLVED", "d": "CONFLICT"}


def test_confidence_needs_both_periods(spark):
    n = lambda *x: advertising.entity_confidence(*[F.lit(v).cast("int") for v in x])
    assert list(one(spark, n(1, 1000, 1, 1000), n(1, 1000, 1, 999), n(1, 999, 1, 1000), n(1, 5000, 0, 5000), n(1, 5000, None, None), n(0, 5000, 1, 5000), n(1, 99, 1, 5000))) == ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_delivery_health(spark):
    at = lambda m: datetime(2024, 1, 31) - timedelta(minutes=m)
    rows = [("META", "DELIVERED", None, False, 1, None)] * 45 + [("META", "DEAD", "REJECTED", False, 1, None)] * 5 + [("META", "SKIPPED", "SHADOW_MODE", False, 1, None), ("META", "SKIPPED", "NO_CONSENT", False, 1, None), ("META", "RETRY", "CONNECTION_REAUTH_REQUIRED", False, 1, at(9))]
    rows += [("TIKTOK", "PENDING", None, False, 1, at(11)), ("TIKTOK", "PROCESSING", None, False, 1, at(-5)), ("TIKTOK", "DEAD", None, True, 1, None), ("TIKTOK", "DEAD", None, False, 31, None)]
    made = spark.createDataFrame([(p, "PURCHASE", s, r, t, datetime(2024, 1, 31) - timedelta(days=d), n) for p, s, r, t, d, n in rows], "provider string, event_name string, status string, reason_code string, is_test boolean, created_at timestamp_ntz, next_attempt_at timestamp_ntz")
    got = {r.provider: r for r in delivery.health(made, F.lit("2024-01-31").cast("timestamp_ntz")).collect()}
    m, t, g = got["META"], got["TIKTOK"], got["GOOGLE_ADS"]
    assert (m.eligible, m.acknowledged, m.shadow, m.excluded, m.retrying, m.terminal, m.acceptance_rate, m.alerts) == (52, 45, 1, 1, 1, 5, 45 / 52, "CREDENTIAL_RECONNECT_REQUIRED,DELIVERY_FAILURE_RATE")
    assert (t.eligible, t.pending, t.terminal, t.acceptance_rate, t.alerts) == (2, 2, 0, 0.0, "DELIVERY_QUEUE_STALE") and (g.eligible, g.acceptance_rate, g.alerts) == (0, None, "")


def test_paths_and_targets(spark):
    """A visitor's journey over two sessions, a session without touches, and one without a visitor."""
    d = lambda x, h: datetime(2024, 1, x, h)
    rows = [("a", 1, d(1, 1), d(1, 2), None, False), ("b", 1, d(2, 1), d(2, 5), d(2, 4), True), ("c", 2, d(2, 1), d(2, 2), None, False), ("n", None, d(3, 1), d(3, 2), d(3, 2), True), ("old", 1, datetime(2023, 11, 1), datetime(2023, 11, 1), None, False)]
    s = spark.createDataFrame(rows, "session_id string, visitor_id int, started_at timestamp_ntz, ended_at timestamp_ntz, checkout_completed_at timestamp_ntz, linked_purchase boolean")
    touches = [("a", 1, d(1, 1), d(1, 1), 1, "META", 8), ("b", 1, d(2, 1), d(2, 1), 1, "META", None), ("b", 1, d(2, 1), d(2, 3), 2, "GOOGLE", 9), ("b", 1, d(2, 1), d(2, 5), 3, "LATE", None), ("n", None, d(3, 1), d(3, 1), 1, "META", 16), ("old", 1, datetime(2023, 11, 1), datetime(2023, 11, 1), 1, "OLD", None)]
    t = spark.createDataFrame(touches, "session_id string, visitor_id int, session_started_at timestamp_ntz, touched_at timestamp_ntz, ordinal int, source string, ad_id int")
    got = {(r.day, r.path): (r.sessions, r.purchase_sessions, r.cross_session, r.delay_ms, r.delays) for r in storefront.path_daily(storefront.source_paths(t, s)).collect()}
    hour = 3600_000
    assert got == {
        (date(2024, 1, 1), "SESSION:META"): (1, 0, 0, 0, 0), (date(2024, 1, 2), "SESSION:META>GOOGLE"): (1, 1, 0, 0, 0), (date(2024, 1, 2), "JOURNEY:META>GOOGLE"): (0, 1, 1, 27 * hour, 1), (date(2024, 1, 2), "SESSION:UNKNOWN"): (1, 0, 0, 0, 0),
        (date(2024, 1, 3), "SESSION:META"): (1, 1, 0, 0, 0), (date(2024, 1, 3), "JOURNEY:META"): (0, 1, 0, hour, 1), (date(2023, 11, 1), "SESSION:OLD"): (1, 0, 0, 0, 0),
    }
    credit = {(r.purchase_id, r.dimension, r.key): (r.is_first, r.is_last, r.is_assisted, r.single_touch, r.cross_session, r.delay_ms) for r in storefront.credits(s, t).collect()}
    assert credit == {
        ("b", "SOURCE", "META"): (True, False, True, False, True, 27 * hour), ("b", "META_AD", "8"): (True, False, True, False, True, 27 * hour), ("b", "SOURCE", "GOOGLE"): (False, True, False, False, True, 27 * hour),
        ("n", "SOURCE", "META"): (True, True, False, True, False, hour), ("n", "META_AD", "16"): (True, True, False, True, False, hour),
    }
    products = spark.createDataFrame([("n", 5, 1, 0), ("n", 6, 0, 2), ("a", 5, 1, 1)], "session_id string, product_id int, views int, adds int")
    seen = spark.createDataFrame([("n", "k", 2)], "session_id string, collection_id string, views int")
    ordered = spark.createDataFrame([("n", 6), ("b", 5), ("n", 6)], "session_id string, product_id int")
    rows = storefront.target_evidence(t, products, s, ordered=ordered, collections=seen).collect()
    assert sorted((r.ad_id, r.target, r.target_id, r.interacted_sessions, r.viewed_sessions, r.cart_sessions, r.purchase_sessions, r.first_touch, r.last_touch, r.assisted) for r in rows) == [
        ("16", "COLLECTION", "k", 1, 1, 0, 1, 1, 1, 0), ("16", "PRODUCT", "5", 1, 1, 0, 0, 0, 0, 0), ("16", "PRODUCT", "6", 1, 0, 1, 1, 1, 1, 0), ("8", "PRODUCT", "5", 1, 1, 1, 0, 0, 0, 0),
    ]


def test_snapshot_changes(spark):
    schema = "ad_id int, campaign_id int, name string"
    before = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, None), (4, 2, "d"), (5, 2, "e"), (7, None, "x|y")], schema)
    after = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 1, ""), (5, 2, "e2"), (6, 2, "f"), (7, None, "x|y"), (7, None, "x|y")], schema)
    got = changes.changed_keys(before, after, key="ad_id", parents=["campaign_id"], values=["name"])
    assert {r.ad_id: r.change for r in got.collect()} == {2: "MOVED", 3: "CHANGED", 4: "DELETED", 5: "CHANGED", 6: "ADDED"}
    renamed = spark.createDataFrame([(2,)], "campaign_id int")
    below = changes.with_descendants(renamed, before.union(after).select("ad_id", "campaign_id"), key="ad_id", parent="campaign_id")
    assert sorted(r.ad_id for r in below.collect()) == [2, 4, 5, 6]
    named = spark.createDataFrame([("s", 1, 4), ("s", 9, 6), ("t", 3, 1), ("u", 5, 3), ("u", 7, None)], "session_id string, received_at int, ad_id int")
    stale = changes.invalidated_sessions([(named, got, "ad_id")])
    assert sorted(tuple(r) for r in stale.collect()) == [("s", 9), ("u", 5)]
    marks = changes.reissued(spark.createDataFrame([("s", 3, "old"), ("z", 2, "old")], "session_id string, source_received_at int, generation string"), stale, "g2")
    assert sorted((r.session_id, r.source_received_at) for r in marks.collect()) == [("s", 9), ("u", 5), ("z", 2)] and "old" not in {r.generation for r in marks.collect()}


def test_browser_pairs(spark):
    """One event that may be sent, and the same with each condition broken."""
    now, ok = datetime(2024, 1, 31, 12), {"event_name": "PAGE_VIEW", "lag": 30, "arrived": 20, "shared": True, "consent_state": "GRANTED", "kept": 60}
    broken = [{}, {"event_name": "SEARCH"}, {"lag": 61}, {"lag": -6, "arrived": 0}, {"arrived": 61}, {"arrived": -1}, {"shared": False}, {"consent_state": "DENIED"}, {"kept": 0}, {"lag": -5, "arrived": 0}]
    rows = [(k, 1, *(ok | b).values()) for k, b in enumerate(broken)]
    e = spark.createDataFrame(rows, "event_id int, store_id int, event_name string, lag int, arrived int, shared boolean, consent_state string, kept int")
    t = F.lit(now)
    ago = lambda c: t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(c).cast("decimal(18,6)"))
    e = e.select("event_id", "store_id", "event_name", ago("lag").cast("timestamp_ntz").alias("event_at"), ago("arrived").cast("timestamp_ntz").alias("received_at"), F.col("event_id").alias("session_id"), F.lit(None).cast("int").alias("visitor_id"), "shared", "consent_state", (t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("kept").cast("decimal(18,6)"))).cast("timestamp_ntz").alias("retention_expires_at"))
    ask = spark.createDataFrame([(1, 1, now)], "request_id int, store_id int, requested_at timestamp_ntz")
    dest = spark.sql("select 'd' destination_id, 1 store_id, 'META' provider, 'ACTIVE' status, true browser_events, true funnel_events, 'EXCLUSIVE' overlap_policy, cast(null as string) delivery_mode, 'META_CONNECTION' auth_source, 'a1' ad_account_id")
    store = spark.sql("select 1 store_id, 'ACTIVE' status, timestamp_ntz'2024-01-01' installed_at, array('read_customer_events') scopes, 'ACTIVE' installation_status, 'ACTIVE' ads_status, array('ads_management') ads_scopes, array('a1') ads_accounts, cast(null as timestamp_ntz) token_expires_at")
    none = spark.createDataFrame([], "store_id int, scope_key string, revoked_before timestamp_ntz")
    routes = e.select("event_id", F.lit("META").alias("provider"))
    ids = lambda requests=ask, events=e, destinations=dest, stores=store, withdrawals=none, routed=routes: sorted(r.event_id for r in delivery.permitted_browser_pairs(requests, events, destinations, stores, withdrawals, routed).collect())
    assert ids() == [0, 9]
    assert ids(routed=routes.where("event_id > 0")) == [9]
    for column, value in (("status", "PAUSED"), ("provider", "TIKTOK"), ("browser_events", False), ("overlap_policy", "SHARED"), ("delivery_mode", "SHADOW"), ("ad_account_id", "a2")):
        assert ids(destinations=dest.withColumn(column, F.lit(value))) == []
    assert ids(destinations=dest.withColumn("auth_source", F.lit("TOKEN")), stores=store.withColumn("ads_accounts", F.array())) == [0, 9]
    assert ids(stores=store.withColumn("installed_at", F.lit("2024-01-31 12:00:01").cast("timestamp_ntz"))) == []
    for column, value in (("status", "PAUSED"), ("installation_status", "PAUSED"), ("ads_status", "EXPIRED")):
        assert ids(stores=store.withColumn(column, F.lit(value))) == []
    gone = lambda scope, lag: spark.createDataFrame([(1, scope, now - timedelta(seconds=lag))], none.schema)
    assert ids(withdrawals=gone("session:0", 30)) == [9] and ids(withdrawals=gone("session:0", 31)) == [0, 9]
    later = e.where("event_id = 0").select(F.lit(77).alias("event_id"), "store_id", F.lit("SEARCH").alias("event_name"), F.lit(now).cast("timestamp_ntz").alias("event_at"), "received_at", "session_id", "visitor_id", F.lit(False).alias("shared"), "consent_state", "retention_expires_at")
    assert ids(events=e.union(later)) == [9]


def test_totals_by_mapping_class(spark):
    rows = [("CURRENT", "META", "EXACT", 60.0), ("CURRENT", "GOOGLE", "EXACT", 5.0), ("CURRENT", "META", "SHARED", 25.0), ("CURRENT", "META", "AMBIGUOUS", 7.0), ("COMPARISON", "META", "EXACT", 9.0)]
    accounting = spark.createDataFrame(rows, "period string, provider string, mapping_class string, spend double")
    spend = spark.createDataFrame([("CURRENT", 0, 100.0), ("COMPARISON", 1, None)], "period string, missing_accounts long, spend double")
    got = {r.period: r for r in workspaces.mapping_totals(accounting, spend).collect()}
    now, then = got["CURRENT"], got["COMPARISON"]
    assert (now.exact_spend, now.shared_spend, now.ambiguous_spend, now.unmapped_spend, now.mapping_coverage, now.by_provider) == (65.0, 25.0, 7.0, 10.0, 0.65, "GOOGLE:5.00,META:60.00")
    assert (then.exact_spend, then.shared_spend, then.unmapped_spend, then.mapping_coverage) == (9.0, 0.0, None, None)


def most_rows(df):
    """The most rows that any step of a collected plan gave."""
    most, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        for name in ("numOutputRows", "shuffleRecordsWritten"):
            rows = node.metrics().get(name)
            if rows.isDefined():
                most = max(most, rows.get().value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return most


def test_asof_with_open_versions_below_short_ones(spark):
    """Times whose last version has ended, while an earlier one is open, move no more rows than others do."""
    n = 2_000
    versions = spark.range(n).selectExpr("id % 50 k", "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int)) f", "if(id < 50, null, timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int), 1)) u", "id v")
    times = spark.range(n).selectExpr("id % 50 k", "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int), cast(id % 2 as int) * 2) t", "id n")
    got = joins.asof_join(times, versions, on=["k"], at="t", begins="f", ends="u", take=["v"])
    assert {r.n: r.v for r in got.collect()} == {k: k % 50 if k % 2 else k for k in range(n)}
    assert n <= most_rows(got) <= 3 * n


def test_product_search_pages_through_all_that_hold_the_text(spark):
    """Twenty of all the products with a 5 in any text, not a few of one brand."""
    from marketspan.plans.registry import QUERIES

    rows = QUERIES["O-12_product_search"](spark, "/root/testdata/sf0.001").collect()
    held = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("concat_ws(' ', p_name, p_brand, p_partkey) like '%5%'")
    assert len(rows) == 20 and {r.total for r in rows} == {held.count()}
