"""Queries over the canonical views, and the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..functions.exprs import numeric, period_label, point_change, safe_div, selected
from ..functions.dates import date_spine, store_date
from ..operators import advertising as ads
from ..operators import changes, commerce, delivery, evidence, economics as eco, mapping, rules, storefront, workspaces
from ..operators.joins import asof_few, asof_join, or_key_counts, without_revoked
from ..operators.shared import written
from ..sources import canonical as c
from ..sources import sinks
from ..streaming import ingest
from .oracle import ORACLE_SQL as ORACLE_SQL


def costed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a product has two cost ranges
    return asof_few(c.period_lines(spark, sf_dir), c.costs(spark, sf_dir), on=["product_id"], at="demand_at", begins="effective_from", ends="effective_until", take=["unit_cost"])


def economics(s, d):
    return commerce.product_economics(costed_lines(s, d))


def metrics(s, d):
    return commerce.product_metrics(economics(s, d))


def collections(s, d):
    p = c.table(s, d, "part")
    members = p.select(F.col("p_partkey").alias("product_id"), F.explode(F.array("p_brand", "p_type")).alias("collection_id"))
    periods = s.createDataFrame([("CURRENT",), ("COMPARISON",)], "period string")
    return commerce.collection_performance(c.period_lines(s, d), members, periods, members.select("collection_id").distinct())


def classes(s, d):
    return ads.classify_mappings(c.mappings(s, d), c.table(s, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("ad_id")))


def sessions(s, d):
    return storefront.materialize_sessions(storefront.sessions_by_gap(c.events(s, d), 720))


def gapped(s, d):
    return storefront.sessions_by_gap(c.events(s, d), 720)


def products_seen(s, d):
    return storefront.session_products(gapped(s, d))


def touch(s, d):
    return touches_of(gapped(s, d))


def touches_of(e):
    t = storefront.touches(e, ["source", "ad_id"])
    return t.select("session_id", "visitor_id", "session_started_at", F.col("event_at").alias("touched_at"), "ordinal", "source", "ad_id")


def collections_seen(s, d):
    return storefront.session_collections(gapped(s, d))


def ordered(s, d):
    return c.storefront_order_lines(gapped(s, d))


def target_evidence(s, d):
    # events, sessions and touches are written once: else each use of them would be computed from the table on
    e = written(gapped(s, d))
    session_rows, touched = written(storefront.materialize_sessions(e)), written(touches_of(e))
    return storefront.target_evidence(touched, storefront.session_products(e), session_rows, ordered=c.storefront_order_lines(e), collections=storefront.session_collections(e))


def attribution(s, d):
    return storefront.attribution(sessions(s, d), touch(s, d))


def bought(s, d):
    return c.events(s, d).where("event_name = 'CHECKOUT_COMPLETED'")


def last_clicks(s, d):
    clicks = c.events(s, d).where("event_name = 'ADD_TO_CART' and source in ('META', 'GOOGLE')").select("visitor_id", F.col("source").alias("provider"), F.col("event_id").alias("click_id"), F.col("event_at").alias("clicked_at"), "received_at")
    return storefront.last_clicks(bought(s, d).select(F.col("event_id").alias("order_id"), "visitor_id", F.col("event_at").alias("ordered_at")), clicks, ["META", "GOOGLE"])


def events_period(day):
    return period_label(day, c.EVENTS_CURRENT, c.EVENTS_COMPARISON)


def cube(s, d):
    return storefront.behavior_daily(sessions(s, d), products_seen(s, d), collections_seen(s, d), ordered(s, d))


def behavior(s, d, dimension):
    return storefront.behavior_read(cube(s, d), dimension, events_period(F.col("day")))


def consented(s, d):
    e = gapped(s, d).withColumn("visitor_key", F.concat(F.lit("visitor:"), "visitor_id")).withColumn("session_key", F.concat(F.lit("session:"), "session_id"))
    gone = e.where("event_id % 50 = 0").select(F.when(F.col("event_id") % 100 == 0, F.col("visitor_key")).otherwise(F.col("session_key")).alias("scope_key"), F.col("event_at").alias("revoked_before"))
    return without_revoked(e, gone, scopes=["visitor_key", "session_key"], at=F.least("event_at", "received_at")).groupBy("event_name").agg(F.count("*").alias("events"))


#: Windows of the rules' evidence: a month against the month before.
MONTH, MONTH_BEFORE = ("1997-12-01", "1998-01-01"), ("1997-11-01", "1997-12-01")


def paid_evidence(s, d, kind, own=None):
    """An entity's metrics in both months, with its share of its currency's spend this month."""
    own = c.ad_daily(s, d, MONTH, MONTH_BEFORE) if own is None else own
    return evidence.paid_evidence(own, ads.ENTITY_COLUMNS[kind])


def product_evidence(s, d, base=None):
    sold, facts, known = (base["metrics"], base["facts"], base["classes"]) if base else (metrics(s, d), c.ad_daily(s, d), classes(s, d))
    return evidence.product_evidence(ads.product_ads(sold, facts, known, "EUR"), ads.mapping_coverage(facts, known, "EUR"), sold, eco.with_reorder_state(stock_cover(s, d)), days=365)


def store_evidence(orders):
    return evidence.store_evidence(commerce.order_kpis(commerce.order_aggregates(orders)), commerce.commerce_health(orders))


def attribution_evidence(own, credited):
    touched = storefront.attribution_health(credited)
    provider = own.where("period = 'CURRENT' and provider = 'META'").agg(F.sum("conversions").alias("provider_purchases"))
    return evidence.attribution_evidence(provider, touched)


#: What is taken of orders for evidence.
ORDER_COLUMNS = ("period", "segment", "units", "value", "refunds", "discounts")


def bases(s, d):
    """What several families of evidence read, written once: else each would be computed for each of them from the lines and events on."""
    e = written(gapped(s, d))
    session_rows, facts = written(storefront.materialize_sessions(e)), written(c.ad_daily(s, d))
    # both months lie in the current year, whose facts are by day
    month = facts.withColumn("period", period_label(F.col("date"), MONTH, MONTH_BEFORE)).where("period is not null")
    return {
        "facts": facts, "month": written(month), "classes": written(classes(s, d)), "metrics": written(metrics(s, d)), "orders": written(c.period_orders(s, d).select(*ORDER_COLUMNS)),
        "cube": written(storefront.behavior_daily(session_rows, storefront.session_products(e), storefront.session_collections(e), c.storefront_order_lines(e))),
        "attribution": storefront.attribution(session_rows, touches_of(e)),
    }


def families(s, d, base=None):
    base = base or bases(s, d)
    store = lambda dim: storefront.behavior_evidence(storefront.behavior_read(base["cube"], dim, events_period(F.col("day"))))
    paid = lambda kind: paid_evidence(s, d, kind, base["month"])
    return {
        "campaign": paid("CAMPAIGN"), "adset": paid("GROUP"), "ad": paid("AD"), "creative": paid("CREATIVE"),
        "product": product_evidence(s, d, base), "store": store_evidence(base["orders"]), "mapping": evidence.mapping_evidence(ads.mapping_coverage(base["facts"], base["classes"], "EUR")), "attribution": attribution_evidence(base["month"], base["attribution"]),
        "storefront": store("STORE"), "storefront_product": store("PRODUCT"), "landing_page": store("LANDING_PAGE"),
    }


SCORES = {"impact": 6, "confidence": 6, "urgency": 6}


def snapshot(s, d, base=None):
    return rules.with_actions(rules.apply_rules(families(s, d, base)))


def store_state(s, d, base=None):
    """What data quality looks at; connections are not in the tables and taken as active, the pixel as stale."""
    sold, facts, known = (base["metrics"], base["facts"], base["classes"]) if base else (metrics(s, d), c.ad_daily(s, d), classes(s, d))
    coverage = ads.mapping_coverage(facts, known, "EUR").where("period = 'CURRENT'")
    costs = sold.where("period = 'CURRENT'").agg(F.sum("sold_units").alias("units"), safe_div(F.sum(F.col("sold_units") * F.col("cost_coverage")), F.sum("sold_units")).alias("cost_coverage"))
    counts = facts.agg(F.count("*").alias("ads_rows"), F.count_distinct("account_id").alias("selected_accounts"))
    fixed = {"commerce_status": F.lit("ACTIVE"), "reads_all_orders": F.lit(False), "commerce_age_hours": F.lit(3), "ads_status": F.lit("ACTIVE"), "ads_age_hours": F.lit(49), "pixel_status": F.lit("ACTIVE"), "pixel_age_hours": F.lit(48), "rollup_failed": F.lit(False), "rolled_up": F.lit(True), "storefront_rows": F.lit(1), "storefront_rows0": F.lit(1), "inventory_mode": F.lit("TRUSTED"), "inventory_rows": F.lit(1)}
    one = coverage.crossJoin(F.broadcast(costs)).crossJoin(F.broadcast(counts))  # one row each
    return one.withColumns(fixed)


def product_state(s, d):
    """Products as unified decisions see them."""
    linked = ads.product_ads(metrics(s, d), c.ad_daily(s, d), classes(s, d), "EUR").where("period = 'CURRENT'")
    stock = stock_cover(s, d).select("product_id", commerce.stock_state(F.col("available"), F.lit(True), F.col("units_per_day"), lead_days=10, low_stock=5).alias("stock_state"))
    seen = storefront.behavior_evidence(behavior(s, d, "PRODUCT")).select(F.col("entity_id").cast("long").alias("product_id"), "product_views", "view_to_cart")
    ambiguous = c.mappings(s, d).join(classes(s, d).where("mapping_class = 'AMBIGUOUS'"), "ad_id", "left_semi").select("product_id").distinct().withColumn("mapping_ambiguous", F.lit(True))
    out = linked.join(stock, "product_id", "left").join(seen, "product_id", "left").join(ambiguous, "product_id", "left").fillna(False, ["mapping_ambiguous"])
    quality = F.when((F.col("mapped_ads") == 0) | (F.col("source_rows") == 0), "LOW").when(F.col("merchant_confirmed"), "HIGH").otherwise("MEDIUM")
    spend = F.when((F.col("mapped_ads") > 0) & (F.col("source_rows") > 0) | (F.col("mapped_ads") == 0), F.col("exact_spend"))
    return out.withColumns({"spend": spend, "commerce_known": F.lit(True), "pixel_fresh": F.lit(True), "inefficient_paid_demand": F.col("contribution_after_ads") < 0, "evidence_quality": quality})


def decisions(s, d):
    """Unified decisions about entities and products."""
    drafts = rules.product_drafts(product_state(s, d))
    for kind in ("CAMPAIGN", "GROUP", "AD"):
        rows = ads.entity_metrics(c.ad_daily(s, d, MONTH, MONTH_BEFORE), kind)
        names = ["source_rows", "impressions", "spend", "conversions", "roas", "cpc", "ctr"]
        both = eco.period_changes(rows, names, ["entity_id"])
        quality = both.select("entity_id", ads.entity_confidence(*[F.col(n) for n in ("source_rows", "impressions", "source_rows0", "impressions0")]).alias("evidence_quality"))
        drafts = drafts.unionByName(rules.signal_drafts(rules.entity_signals(both).join(quality, "entity_id"), kind))
    return drafts.withColumn("priority", rules.by_weights())


def blended(s, d, base=None):
    sold, facts, orders = (base["metrics"], base["facts"], base["orders"]) if base else (metrics(s, d), c.ad_daily(s, d), c.period_orders(s, d))
    spend = eco.compatible_spend(facts, facts.select("account_id", "currency").distinct(), "EUR")
    return eco.blended_economics(commerce.order_kpis(commerce.order_aggregates(orders)), sold, spend)


def report(s, d):
    base = bases(s, d)
    return workspaces.report(blended(s, d, base), snapshot(s, d, base))


def limited_drafts(s, d):
    base = bases(s, d)
    return rules.with_data_quality(snapshot(s, d, base), rules.data_quality(store_state(s, d, base)))


def mapping_totals(s, d):
    facts = c.ad_daily(s, d)
    spend = eco.compatible_spend(facts, facts.select("account_id", "currency").distinct(), "EUR")
    return workspaces.mapping_totals(ads.mapping_accounting(facts.where("currency = 'EUR'"), classes(s, d)), spend)


def rounded(df, **digits):
    """Sums of doubles depend on their order; this keeps the digits that don't."""
    return df.withColumns({n: F.round(n, k) for n, k in digits.items()})


def stock_cover(s, d):
    p = c.table(s, d, "part")
    items = p.select(F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 4 != 0).alias("tracked"))
    places = F.array(F.struct((F.col("p_size") - 10).cast("long").alias("available"), F.lit(0).cast("long").alias("incoming")), F.struct(F.lit(3).cast("long").alias("available"), (F.col("p_size") % 7).cast("long").alias("incoming")))
    levels = p.select(F.col("p_partkey").alias("product_id"), F.inline(places))
    return eco.inventory_cover(items, levels, c.period_lines(s, d).where("period = 'CURRENT'"), days=365, trusted=True)


def ad_signals(s, d):
    facts = c.ad_daily(s, d)
    rows = facts.groupBy("period", "ad_id").agg(F.count("*").alias("source_rows"))
    both = ads.metric_sums(facts, ["period", "ad_id"]).join(rows, ["period", "ad_id"])
    names = ["source_rows", "impressions", "spend", "conversions", "roas", "cpc", "ctr"]
    return rules.entity_signals(eco.period_changes(both, names, ["ad_id"]).withColumnRenamed("ad_id", "entity_id"))


def shared_exposure(s, d):
    m = c.mappings(s, d)
    sums = ads.metric_sums(c.ad_daily(s, d).where("period = 'CURRENT'"), ["ad_id"]).select("ad_id", "spend", "impressions")
    return eco.shared_exposure_conflicts(sums, m.where("is_merchant_confirmed or confidence >= 0.7"), eco.with_reorder_state(stock_cover(s, d)))


def candidates(s, d):
    sold = metrics(s, d).where("period = 'CURRENT'").select("product_id", F.round("net_revenue", 2).alias("net_revenue"))
    exact = classes(s, d).where("mapping_class = 'EXACT'").select("ad_id", "product_id")
    spend = c.ad_daily(s, d).where("period = 'CURRENT'").join(exact, "ad_id").groupBy("product_id").agg(F.sum("spend").cast("double").alias("spend"))
    wished = c.table(s, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("product_id"))
    return eco.ranked_candidates(sold, spend, wished, offset=10, limit=50)


def stock_levels(s, d):
    li = c.table(s, d, "lineitem")
    snaps = li.groupBy(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("location_id"), F.col("l_shipdate").alias("observed_at")).agg(F.max(F.col("l_quantity").cast("long")).alias("available"))
    return commerce.latest_levels(snaps, F.lit("1997-06-30").cast("timestamp_ntz"))


def delays(s, d):
    rows = bought(s, d).select(F.col("event_id").alias("purchase_id"), "visitor_id", F.col("event_at").alias("purchased_at"))
    return storefront.conversion_delays(rows, sessions(s, d))


def landing_pages(s, d):
    url = F.col("url")
    return c.table(s, d, "pages").groupBy(web.landing_page(url).alias("landing_page"), web.host(url).alias("host"), F.coalesce(web.query_value(url, "utm_source"), F.lit("none")).alias("utm_source")).agg(F.count("*").alias("pages"))


def mapping_fixture(s, d):
    """Catalog items of a provider, most of which name a variant in one way or another, and the variants."""
    n = F.col("p_partkey")
    variants = c.table(s, d, "part").select(n.alias("variant_id"), F.concat(F.lit("SKU-"), n % 1500).alias("sku"), F.floor(n / 2).cast("long").alias("product_id"), F.concat(F.lit("h"), F.floor(n / 2).cast("long")).alias("handle"), F.when(n % 2 == 0, "red").otherwise("blue").alias("color"), F.lit("m").alias("size"))
    url = F.when(n % 4 == 1, F.concat(F.lit("https://shop.example/products/h"), F.floor(n / 2).cast("long"), F.when(n % 3 == 0, F.concat(F.lit("?variant="), n)).otherwise("")))
    items = c.table(s, d, "part").select(n.alias("item_id"), F.when(n % 4 == 0, F.concat(F.lit("SKU-"), n)).alias("retailer_id"), url.alias("url"), F.when(n % 4 == 2, F.floor(n / 2).cast("string")).alias("group_id"), F.when(n % 5 == 0, "red").alias("color"), F.lit(None).cast("string").alias("size"))
    return items, variants


def dirty_days(s, d):
    """Days to rebuild after every fiftieth event came late."""
    e = gapped(s, d)
    starts = lambda x: x.groupBy("session_id").agg(F.min("visitor_id").alias("visitor_id"), F.min("event_at").alias("started_at"))
    late = e.where("event_id % 50 = 0").select("session_id").distinct()
    own = e.join(late, "session_id", "left_semi")
    return ingest.dirty_days(starts(own.where("event_id % 50 <> 0")), starts(own), bought(s, d).select("visitor_id", F.col("event_at").alias("purchased_at")))


def contents(s, d):
    """What each order's conversion held; a third of the products have no catalog item, a third have two."""
    items = c.table(s, d, "lineitem").select(F.col("l_orderkey").alias("source_event_id"), F.col("l_partkey").alias("variant_id"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    p = c.table(s, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("variant_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_partkey") % 3)).alias("n"))
    mapped = p.select("variant_id", F.concat_ws("-", "variant_id", "n").alias("catalog_item_id"))
    return delivery.contents(items, mapped).withColumn("value", F.col("value").cast("double"))


def linked_orders(s, d):
    """Sessions that bought, with an order of which two thirds have arrived."""
    rows = sessions(s, d).where("purchases > 0").select("session_id", F.col("last_event_id").alias("order_ext"), (F.col("events") % 9 + 1).cast("int").alias("attempts"), F.col("ended_at").alias("tried_at"))
    arrived = c.table(s, d, "events").where("event_id % 3 <> 0").select(F.col("event_id").alias("order_ext"), F.concat(F.lit("o"), "event_id").alias("order_id"))
    return storefront.linked_orders(rows, arrived)


def purchase_candidates(s, d):
    """Purchases that may be sent, with the last click of each provider before them."""
    k = F.col("k")
    reason = delivery.eligibility(source=F.when(k % 9 == 0, "pos").otherwise("web"), is_test=k % 10 == 1, is_b2b=k % 11 == 2, cancelled=k % 12 == 3, linked=F.col("order_linked"), has_facts=F.lit(True), before_install=F.lit(False), value=k)
    own = bought(s, d).where(reason.isNull()).select(F.col("event_id").alias("order_id"))
    new = own.join(deliveries(s, d).where("status = 'DELIVERED'").select(F.col("source_event_id").alias("order_id")), "order_id", "left_anti")
    return last_clicks(s, d).join(new, "order_id", "left_semi")


def resolved(s, d):
    """Events as touches that name places of a hierarchy of every eighth number, some of them wrongly."""
    k = F.col("k")
    t = c.events(s, d).select(F.col("event_id").alias("touch_id"), "visitor_id", F.when(k % 5 == 0, F.floor(k / 32)).cast("long").alias("campaign_ext"), F.when(k % 3 < 2, F.floor(k / 16) + k % 3).cast("long").alias("group_ext"), F.when(k % 4 == 0, k).alias("ad_ext"))
    ads_ = s.range(0, 100, 8).select(F.floor(F.col("id") / 32).cast("long").alias("campaign_ext"), F.floor(F.col("id") / 16).cast("long").alias("group_ext"), F.col("id").alias("ad_ext"))
    return storefront.resolve_touches(t, ads_)


def store_health(s, d):
    """Events, sessions and purchases of each store, beside each other; the fifth store has no visitors, so nulls."""
    store = (F.col("visitor_id") % 4).alias("store_id")
    parts = {
        "events": c.events(s, d).groupBy(store).agg(F.count("*").alias("events"), F.max("received_at").alias("last_event_at")),
        "sessions": sessions(s, d).groupBy(store).agg(F.count("*").alias("sessions"), F.count_if("linked_purchase").alias("purchase_sessions")),
        "touches": touch(s, d).where("ad_id is not null").groupBy(store).agg(F.count("*").alias("paid_touches")),
    }
    return storefront.side_by_side(s.range(5).select(F.col("id").alias("store_id")), parts)


def health(s, d):
    """Purchases' deliveries with what their health looks at, derived from the event's number: tests, shadows, lost connections, due times."""
    n = F.col("source_event_id")
    skipped = F.when(n % 11 == 0, "SKIPPED").otherwise(F.col("status"))
    reason = F.when((n % 11 == 0) & (n % 2 == 0), "SHADOW_MODE").when(n % 13 == 0, "CONNECTION_REAUTH_REQUIRED").otherwise(F.col("reason_code"))
    rows = deliveries(s, d).withColumns({"status": skipped, "reason_code": reason, "is_test": n % 17 == 0, "created_at": F.col("event_at"), "next_attempt_at": F.col("event_at") + F.make_dt_interval(F.lit(0), F.lit(0), (n % 30).cast("int"))})
    return delivery.health(rows, F.lit("2024-02-05").cast("timestamp_ntz"))


def routed(s, d):
    """What the paid touches before each purchase make of it."""
    signals = c.landing_signals(gapped(s, d))
    return delivery.routing(signals.where("event_name = 'CHECKOUT_COMPLETED'").select(F.col("event_id").alias("conversion_id"), "event_at", "session_id", "visitor_id"), signals, since=F.lit("2024-01-02").cast("timestamp_ntz"), days=10)


def retries(s, d):
    """When each purchase's delivery is tried again; some providers say how long to wait, or until when."""
    k, at = F.col("k"), F.col("event_at")
    asked = F.when(k % 6 == 0, "900").when(k % 6 == 1, "Thu, 25 Jan 2024 00:00:00 GMT").when(k % 6 == 2, "soon")
    again = delivery.retry_at(at, k % 12, F.col("event_id") % 10 / 10, delivery.retry_after_ms(asked, at))
    return bought(s, d).select("event_id", again.alias("next_try_at"), delivery.delivery_deadline(at).alias("deadline_at"), (again > delivery.delivery_deadline(at)).alias("expired"))


def stock_history(s, d):
    li = c.table(s, d, "lineitem")
    snaps = li.groupBy(F.col("l_partkey").alias("item_id"), F.lit(1).alias("location_id"), F.col("l_shipdate").alias("observed_at")).agg(F.max(F.col("l_quantity").cast("long")).alias("available"))
    return commerce.inventory_history(snaps, date_spine(s, c.CURRENT))


def acquisitions(s, d):
    """How page views came about: the url's own parameters, and an id derived click for every seventh page."""
    url, n = F.col("url"), F.col("page_id")
    google = F.when(n % 7 == 0, F.concat(F.lit("g"), n))
    medium = F.when(n % 5 == 1, "cpc").when(n % 5 == 2, "organic").when(n % 5 == 3, "email")
    source = F.coalesce(web.query_value(url, "utm_source"), F.when(n % 5 > 0, F.element_at(F.array(*map(F.lit, ["google", "fb", "klaviyo"])), (n % 3 + 1).cast("int"))))
    referrer = F.when(n % 4 == 0, F.element_at(F.array(*map(F.lit, ["https://www.google.de/search?q=a", "https://m.facebook.com/", "https://shop.example/", "https://mail.google.com/", "https://news.example.org/x"])), (n % 5 + 1).cast("int")))
    none = F.lit(None).cast("string")
    how = web.acquisition(meta_click=F.when(n % 11 == 0, "m"), tiktok_click=none, google_click=google, tiktok_link=none, meta_link=F.when(n % 13 == 0, "1"), utm_source=source, utm_medium=medium, utm_campaign=none, referrer=referrer, page=url)
    return c.table(s, d, "pages").select(how.alias("a")).groupBy("a.channel", "a.provider", "a.basis", "a.paid").agg(F.count("*").alias("visits"))


def page_values(s, d):
    """Each page's address as it may be kept, and its parameters."""
    url = F.col("url")
    return c.table(s, d, "pages").select("page_id", web.sanitize_url(url).alias("url"), web.attribution_value(url, "utm_source").alias("utm_source"), web.host(url).alias("host"), web.numeric_tail(web.sanitize_url(url)).alias("tail"))


def deliveries(s, d):
    """Delivery attempts: two providers per completed checkout, states and coverage derived from the event's number."""
    n, p = F.col("event_id"), F.col("provider")
    state = F.element_at(F.array(*map(F.lit, ["DELIVERED", "DELIVERED", "RETRY", "DEAD", "PENDING"])), (n % 5 + 1).cast("int"))
    rows = bought(s, d).where("event_id % 3 <> 0").select("event_id", "event_at", F.explode(F.array(F.lit("META"), F.lit("TIKTOK"))).alias("provider")).where((n + F.length(p)) % 4 != 0)
    coverage = F.to_json(F.struct((n % 2 == 0).alias("email"), (n % 3 == 0).alias("clickId")))
    content = F.to_json(F.struct((n % 4).alias("observedItems"), (n % 2).alias("mappedItems")))
    return rows.select(F.col("event_id").alias("source_event_id"), "provider", F.lit("PURCHASE").alias("event_name"), state.alias("status"), F.when(state == "DEAD", "REJECTED").alias("reason_code"), F.when(n % 7 != 0, coverage).alias("match_coverage"), F.when(n % 6 != 0, content).alias("content_coverage"), "event_at")


def late_events(s, d):
    e = c.events(s, d)
    return storefront.accepted(e.withColumn("received_at", F.col("event_at") + F.make_dt_interval((F.col("event_id") % 9).cast("int")))).groupBy("event_name").agg(F.count("*").alias("events"))


def retained(s, d):
    e = c.events(s, d).withColumn("retention_expires_at", storefront.expires_at(F.col("received_at"), 10))
    return storefront.unexpired(e, F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("source").agg(F.count("*").alias("events"))


def upserted(s, d):
    o = c.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), F.lit(1).alias("v"))
    return sinks.upsert(o.where("k % 3 <> 0"), o.where("k % 2 = 0").withColumn("x", F.col("x") * 2).withColumn("v", F.lit(2)), ["k"], "v").select("k", "x", "v")


def matched_customers(s, d):
    n, lit, text = F.col("c_custkey"), F.lit, F.col("c_custkey").cast("string")
    mails = F.array(F.concat(lit(" User."), text, lit("+x@Gmail.com")), F.when(n % 4 == 0, F.concat(lit("u"), text, lit("@shop.example"))), F.concat(lit("user."), text, lit("+x@gmail.com ")), lit("no address"))
    phones = F.array(F.when(n % 3 == 0, F.concat(lit("0"), text)).otherwise(F.concat(lit("+49 (30) 1000-"), text)), F.when(n % 5 == 0, F.concat(lit("+4930 77 "), text)))
    match = delivery.customer_match(
        emails=mails, phones=phones, first_name=F.col("c_name"), last_name=F.when(n % 6 > 0, F.concat(lit(" O'Neil-"), n % 7)), city=lit("Bad Homburg v.d.H."), region=F.when(n % 2 == 0, "Hesse"), postal_code=lit(" 10115-A "),
        country=F.when(n % 2 == 0, "DE").when(n % 7 == 0, " nz").otherwise("xx"), external_id=F.when(n % 9 > 0, text),
    )
    shown = {k: F.array_join(v, ",") if k in ("em", "ph", "google_identifiers") else v for k, v in match.items()}
    return c.table(s, d, "customer").select(n.alias("customer_id"), delivery.customer_identity("k3y", F.col("c_nationkey"), n).alias("identity"), *[v.alias(k) for k, v in shown.items()])


def searched(s, d):
    p = c.table(s, d, "part")
    skus = p.select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("SKU-"), "p_partkey").alias("sku"))
    own = p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"))
    found = commerce.search(own, skus, "5", commerce.search_index(own, skus))
    return workspaces.page(found, [F.asc("title"), F.asc("product_id")], page=2, limit=20)


def all_found(s, d):
    """Everything that holds a short text, which is looked up by the whole of it."""
    p = c.table(s, d, "part")
    skus = p.select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("SKU-"), "p_partkey").alias("sku"))
    own = p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"))
    return commerce.search(own, skus, "G", commerce.search_index(own, skus)).unionByName(commerce.search(own, skus, "ku-17", commerce.search_index(own, skus)))


def suggestions(s, d):
    """Every part as an ad whose texts name parts and brands; a brand's name may be the beginning of another's."""
    p = c.table(s, d, "part")
    texts = F.array(F.concat(F.lit("New: "), "p_name", F.lit("s of "), "p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")), F.when(F.col("p_partkey") % 5 == 0, F.concat("p_brand", F.lit("!"))))
    ads_ = p.select(F.col("p_partkey").alias("ad_id"), F.explode(F.array_compact(texts)).alias("text"))
    return mapping.text_suggestions(ads_, p.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("title")).distinct())


def json_ids(s, d):
    """Ids in a payload at several depths, beside texts that only look like keys."""
    k, lit = F.col("p_partkey").cast("string"), F.lit
    said = r'{"note": "\"sku\": \"no\"", "list": [{"Product_ID": '
    payload = F.concat(lit(said), k, lit('}, {"deep": {"a": [{"b": {"sku": "S-'), F.col("p_size"), lit('"}}]}}], "item_ids": ["'), k, lit('x", 7, [8], {"retailer_id": "R-'), F.col("p_size") % 5, lit('"}], "sku_id": true, "other": 9}'))
    rows = c.table(s, d, "part").select(F.col("p_partkey").alias("product_id"), payload.alias("payload"))
    return mapping.provider_ids(rows, "payload", depth=8).select("product_id", F.array_join("ids", ",").alias("ids"))


def hierarchy(s, d, now: bool):
    """Ads below campaigns, before and after a synchronization that renames, moves, adds and drops some."""
    n = F.col("s_suppkey")
    rows = c.table(s, d, "supplier").where("s_suppkey % 17 <> 0" if not now else "s_suppkey % 13 <> 0")
    campaign, name = F.col("s_nationkey"), F.col("s_name")
    return rows.select(n.alias("ad_id"), (F.when(n % 11 == 0, campaign + 1).otherwise(campaign) if now else campaign).alias("campaign_id"), (F.when(n % 7 == 0, F.concat(name, F.lit(" II"))).otherwise(name) if now else name).alias("name"))


def campaigns(s, d, now: bool):
    n = c.table(s, d, "nation").select(F.col("n_nationkey").alias("campaign_id"), F.col("n_name").alias("name"))
    return n.withColumn("name", F.when(F.col("campaign_id") % 9 == 4, F.lower("name")).otherwise(F.col("name"))) if now else n


def catalog(s, d, now: bool):
    n = F.col("p_partkey")
    rows = c.table(s, d, "part").where("p_partkey % 19 <> 0" if now else "p_partkey % 23 <> 0")
    return rows.select(n.alias("product_id"), (F.when(n % 6 == 0, F.lit("other")).otherwise(F.col("p_brand")) if now else F.col("p_brand")).alias("vendor"), "p_name")


def changed_ads(s, d):
    return changes.changed_keys(hierarchy(s, d, False), hierarchy(s, d, True), key="ad_id", parents=["campaign_id"], values=["name"])


def invalidated(s, d):
    """Sessions to rebuild after both synchronizations: those that name a changed ad, an ad below a changed campaign, or a changed product."""
    moved = changes.changed_keys(campaigns(s, d, False), campaigns(s, d, True), key="campaign_id", parents=[], values=["name"])
    links = hierarchy(s, d, False).select("ad_id", "campaign_id").union(hierarchy(s, d, True).select("ad_id", "campaign_id"))
    below = changes.with_descendants(moved, links, key="ad_id", parent="campaign_id")
    products = changes.changed_keys(catalog(s, d, False), catalog(s, d, True), key="product_id", parents=["vendor"], values=["p_name"])
    named = gapped(s, d).select("session_id", "received_at", "ad_id", "product_id")
    return changes.invalidated_sessions([(named, changed_ads(s, d).select("ad_id").union(below), "ad_id"), (named, products, "product_id")])


def versioned_costs(s, d):
    """Each order line with the cost of its product as of the order; every delivery is a version that holds for as many days as it had pieces."""
    li = c.table(s, d, "lineitem")
    versions = li.select(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("begins"), F.when(F.col("l_linenumber") < 6, F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("ends"), F.col("l_extendedprice").cast("decimal(18,2)").alias("unit_cost"))
    o = c.table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("demand_at"))
    sold = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id")).join(o, "order_id")
    return asof_join(sold, versions, on=["product_id"], at="demand_at", begins="begins", ends="ends", take=["unit_cost"]).select("order_id", "line_number", "unit_cost")


def browser_pairs(s, d):
    """Requests of a store's browsers, one per event, the events that they may send, and where; stores and destinations are derived from regions and nations."""
    n, k, lit = F.col("event_id"), F.col("k"), F.lit
    seconds = lambda x: F.make_dt_interval(lit(0), lit(0), lit(0), x.cast("decimal(18,6)"))
    own = c.landing_signals(gapped(s, d)).withColumns({"store_id": F.col("visitor_id") % 5, "received_at": F.col("event_at") + seconds(n % 40), "shared": k % 10 != 0, "consent_state": F.when(k % 7 == 0, "DENIED").when(k % 7 == 1, "NOT_REQUIRED").otherwise("GRANTED")})
    own = own.withColumn("retention_expires_at", F.col("received_at") + F.when(n % 29 == 0, F.expr("interval 10 seconds")).otherwise(F.expr("interval 90 days")))
    requests = own.select(n.alias("request_id"), "store_id", (F.col("received_at") + seconds(n % 50)).alias("requested_at"))
    t = lambda x: lit(x).cast("timestamp_ntz")
    r = F.col("r_regionkey")
    stores = c.table(s, d, "region").select(
        r.alias("store_id"), F.when(r == 4, "PAUSED").otherwise("ACTIVE").alias("status"), F.when(r == 1, t("2024-01-10")).otherwise(t("2023-12-01")).alias("installed_at"), F.array(lit("read_customer_events")).alias("scopes"), lit("ACTIVE").alias("installation_status"),
        F.when(r != 2, "ACTIVE").alias("ads_status"), F.array(lit("ads_management")).alias("ads_scopes"), F.array(lit("act_0"), lit("act_3")).alias("ads_accounts"), F.when(r == 3, t("2024-01-20")).alias("token_expires_at"),
    )
    m = F.col("n_nationkey")
    destinations = c.table(s, d, "nation").select(
        m.alias("destination_id"), (m % 5).alias("store_id"), F.when(m % 4 == 3, "TIKTOK").otherwise("META").alias("provider"), lit("ACTIVE").alias("status"), (m % 6 != 5).alias("browser_events"), lit(True).alias("funnel_events"),
        F.when(m % 8 == 6, "SHARED").otherwise("EXCLUSIVE").alias("overlap_policy"), F.when(m % 9 == 1, "SHADOW").alias("delivery_mode"), F.when(m % 2 == 0, "META_CONNECTION").alias("auth_source"), F.concat(lit("act_"), m % 4).alias("ad_account_id"),
    )
    gone = own.where("event_id % 50 = 0").select("store_id", F.when(n % 100 == 0, F.concat(lit("visitor:"), "visitor_id")).otherwise(F.concat(lit("session:"), "session_id")).alias("scope_key"), F.col("event_at").alias("revoked_before"))
    asked = own.where(F.col("event_name").isin(*delivery.BROWSER_EVENTS)).select(n.alias("conversion_id"), "event_at", "session_id", "visitor_id")
    routes = delivery.routing(asked, own, since=t("2024-01-02")).select(F.col("conversion_id").alias("event_id"), F.explode(F.split("eligible_providers", ",")).alias("provider"))
    return delivery.permitted_browser_pairs(requests, own, destinations, stores, gone, routes)


QUERIES = {
    "O-60_order_aggregates": lambda s, d: commerce.order_aggregates(c.period_orders(s, d)),
    "O-61_product_economics": economics,
    "O-62_order_kpis": lambda s, d: rounded(commerce.order_kpis(commerce.order_aggregates(c.period_orders(s, d))), order_value=2, refunds=4, average_order_value=4),
    "O-63_product_metrics": metrics,
    "O-64_total_product_metrics": lambda s, d: commerce.total_product_metrics(metrics(s, d)).select("period", "order_count", "net_units", F.round("net_revenue", 2).alias("net_revenue"), F.round("cogs", 2).alias("cogs"), F.round("cost_coverage", 6).alias("cost_coverage")),
    "O-65_variant_depletion": lambda s, d: commerce.variant_depletion(c.period_lines(s, d)),
    "O-70_advertising_overview": lambda s, d: ads.overview(c.ad_daily(s, d)),
    "O-71_campaign_metrics": lambda s, d: ads.metric_sums(c.ad_daily(s, d), ["period", "campaign_id", "currency"]),
    "O-76_raw_refund_evidence": lambda s, d: commerce.raw_refund_evidence(c.period_lines(s, d)),
    "O-78_commerce_health": lambda s, d: rounded(commerce.commerce_health(c.period_orders(s, d)), refund_rate=9, discount_rate=9),
    "O-82_mapping_classes": classes,
    "O-83_mapping_accounting": lambda s, d: ads.mapping_accounting(c.ad_daily(s, d), classes(s, d)),
    "O-85_unified_accounts": lambda s, d: ads.unified_accounts(c.ad_daily(s, d)),
    "O-89_collection_performance": collections,
    "O-92_daily_sales": lambda s, d: commerce.daily_sales(c.period_lines(s, d)),
    "O-94_inventory_history": stock_history,
    "O-111_spend_shares": lambda s, d: ads.spend_shares(c.ad_daily(s, d), "campaign_id"),
    "O-118_sessions": sessions,
    "O-45_last_clicks": last_clicks,
    "O-50_consented_events": consented,
    "O-147_landing_pages": landing_pages,
    "O-75_adset_evidence": lambda s, d: ads.entity_evidence(c.ad_daily(s, d), "group_id"),
    "O-90_net_revenue_totals": lambda s, d: rounded(eco.net_revenue_totals(c.period_lines(s, d)), net_revenue=2),
    "O-93_latest_levels": stock_levels,
    "O-101_daily_trend": lambda s, d: eco.daily_trend(c.period_orders(s, d).where("period = 'CURRENT'"), c.ad_daily(s, d).where("period = 'CURRENT'"), date_spine(s, c.CURRENT), "EUR"),
    "O-108_ranked_candidates": candidates,
    "O-122_conversion_delays": delays,
    "W-12_shared_exposure": shared_exposure,
    "R-24_ad_signals": ad_signals,
    "W-01_overview_changes": lambda s, d: rounded(eco.period_changes(blended(s, d), ["orders", "order_value", "spend", "mer"]), order_value=2, order_value0=2, mer=6, mer0=6, order_value_change=6, mer_change=6, spend_change=6),
    "W-04_customers": lambda s, d: rounded(eco.customers(commerce.order_aggregates(c.period_orders(s, d))), order_value=2, order_value0=2, average_order_value=4, average_order_value0=4, order_value_change=6),
    "W-05_inventory_cover": stock_cover,
    "W-13_blended_economics": lambda s, d: rounded(blended(s, d), order_value=2, mer=6, ad_spend_ratio=6, contribution_before_ads=2, contribution_after_ads=2),
    "W-19_visitor_journeys": lambda s, d: storefront.visitor_journeys(sessions(s, d)),
    "O-88_monitor_summary": lambda s, d: ads.monitor_summary(c.ad_daily(s, d)),
    "O-183_monitor_entities": lambda s, d: ads.monitor_summary(c.ad_daily(s, d), keys=["campaign_id"]),
    "O-100_daily_series": lambda s, d: ads.daily_series(c.ad_daily(s, d)),
    "O-109_leaderboard": lambda s, d: rounded(commerce.leaderboard(metrics(s, d), 25), net_revenue=2, net_revenue0=2, net_revenue_change=6),
    "O-120_behavior_daily": lambda s, d: cube(s, d),
    "O-102_store_behavior": lambda s, d: behavior(s, d, "STORE"),
    "O-102_collection_behavior": lambda s, d: behavior(s, d, "COLLECTION"),
    "O-140_landing_page_drops": lambda s, d: behavior(s, d, "LANDING_PAGE"),
    "O-180_storefront_evidence": lambda s, d: storefront.behavior_evidence(behavior(s, d, "PRODUCT")),
    "O-182_insight_changes": lambda s, d: storefront.insight_changes(behavior(s, d, "STORE")),
    "O-80_checkout_purchase_overlap": lambda s, d: storefront.checkout_purchase_overlap(sessions(s, d)),
    "O-119_session_products": products_seen,
    "O-121_attribution": attribution,
    "O-103_attribution_sources": lambda s, d: workspaces.attribution_list(attribution(s, d), "SOURCE", events_period(F.col("day"))),
    "O-81_attribution_health": lambda s, d: storefront.attribution_health(attribution(s, d)),
    "O-119_session_collections": collections_seen,
    "O-123_target_evidence": target_evidence,
    "O-124_source_paths": lambda s, d: storefront.path_daily(storefront.source_paths(touch(s, d), sessions(s, d))),
    "O-174_first_touch_sources": lambda s, d: storefront.first_touch_sources(touch(s, d), products_seen(s, d)),
    "O-116_accepted_events": late_events,
    "O-26_retained_events": retained,
    "O-145_page_values": page_values,
    "O-148_acquisition": acquisitions,
    "O-82b_mapping_confidence": lambda s, d: classes(s, d).groupBy("mapping_class", "merchant_confirmed").agg(F.count("*").alias("ads"), F.round(F.sum("confidence"), 4).alias("confidence")),
    "O-84_ad_rows": lambda s, d: ads.ad_rows(c.ad_daily(s, d)),
    "O-86_group_metrics": lambda s, d: ads.entity_metrics(c.ad_daily(s, d), "GROUP"),
    "O-72_counters": lambda s, d: ads.counters(c.ad_daily(s, d)),
    "O-173_creative_rows": lambda s, d: ads.creative_rows(c.ad_daily(s, d)),
    "O-176_exposure_targets": lambda s, d: ads.exposure_targets(c.mappings(s, d), 10),
    "O-177_mapping_summary": lambda s, d: ads.mapping_summary(c.table(s, d, "supplier").select(F.col("s_suppkey").alias("ad_id"), F.when(F.col("s_suppkey") % 5 == 0, "COLLECTION").otherwise("PRODUCT").alias("target_scope")), c.mappings(s, d)),
    "O-186_mapping_coverage": lambda s, d: ads.mapping_coverage(c.ad_daily(s, d), classes(s, d), "EUR"),
    "W-11_exposure_scope": lambda s, d: ads.exposure_scope(classes(s, d), c.ad_daily(s, d)),
    "W-09_product_ads": lambda s, d: rounded(ads.product_ads(metrics(s, d), c.ad_daily(s, d), classes(s, d), "EUR"), net_revenue=2, contribution_before_ads=2, contribution_after_ads=2, revenue_share=9, spend_share=9, roas=6, mapping_confidence=6),
    "O-181_ad_evidence": lambda s, d: paid_evidence(s, d, "AD"),
    "W-21_product_evidence": lambda s, d: rounded(product_evidence(s, d), net_revenue=2, contribution_after_ads=2, revenue_share=9, spend_share=9, roas=6, mapping_confidence=6, mapping_coverage=6),
    "W-15_snapshot": lambda s, d: rounded(snapshot(s, d), **SCORES),
    "R-27_data_quality": lambda s, d: rules.data_quality(store_state(s, d)),
    "R-28_limited_drafts": lambda s, d: rounded(limited_drafts(s, d).withColumn("limitations", F.array_join("limitations", ",")).select("rule_id", "entity_id", "evidence_quality", "confidence", "limitations"), confidence=6),
    "R-29_occurrences": lambda s, d: rules.with_occurrence(snapshot(s, d), *MONTH).select("rule_id", "entity_id", "occurrence_key"),
    "R-25_product_decisions": lambda s, d: rules.product_drafts(product_state(s, d)),
    "W-16_decisions": lambda s, d: rounded(decisions(s, d), priority=6),
    "O-91_store_summary": lambda s, d: workspaces.store_summary(c.table(s, d, "part"), c.period_orders(s, d).where("period = 'CURRENT'")),
    "O-92b_variant_sales": lambda s, d: rounded(commerce.variant_sales(c.period_lines(s, d).where("period = 'CURRENT'")), gross=2, refunds=2, net=2),
    "O-12_product_search": searched,
    "O-12_short_search": all_found,
    "O-165_stock_states": lambda s, d: stock_cover(s, d).select("product_id", commerce.stock_state(F.col("available"), F.lit(True), F.col("units_per_day"), lead_days=10, low_stock=5).alias("stock_state")),
    "O-58_recent_orders": lambda s, d: workspaces.recent_orders(c.orders(s, d), c.lines(s, d), 6),
    "W-02_dashboard": lambda s, d: rounded(workspaces.dashboard(blended(s, d), eco.with_reorder_state(stock_cover(s, d))), order_value=2, mer=6),
    "W-03_products": lambda s, d: rounded(workspaces.product_page(metrics(s, d), page=2, limit=50), net_revenue=2, net_revenue0=2, net_revenue_change=6),
    "W-06_collections": lambda s, d: rounded(workspaces.collection_page(collections(s, d), page=1, limit=20), revenue=2, revenue0=2, revenue_change=6),
    "W-07_campaigns": lambda s, d: workspaces.entity_page(c.ad_daily(s, d), "CAMPAIGN", page=1, limit=20),
    "W-10_unified_product_ads": lambda s, d: rounded(workspaces.unified_page(product_state(s, d), page=1, limit=50), net_revenue=2, contribution_after_ads=2, exact_spend=4),
    "W-10_mapping_totals": lambda s, d: rounded(mapping_totals(s, d), spend=4, exact_spend=4, shared_spend=4, ambiguous_spend=4, unmapped_spend=4, mapping_coverage=9),
    "W-10_mapping_changes": lambda s, d: rounded(eco.period_changes(mapping_totals(s, d), ["spend", "exact_spend", "shared_spend", "unmapped_spend", "mapping_coverage"]), **{f"{n}{z}": 4 if z != "_change" and n != "mapping_coverage" else 9 for n in ("spend", "exact_spend", "shared_spend", "unmapped_spend", "mapping_coverage") for z in ("", "0", "_change")}),
    "W-14_unified_entities": lambda s, d: workspaces.signal_page(ads.entity_metrics(c.ad_daily(s, d, MONTH, MONTH_BEFORE), "AD"), page=1, limit=50),
    "W-17_behavior_list": lambda s, d: workspaces.behavior_list(behavior(s, d, "PRODUCT"), page=1, limit=10),
    "O-95_signal_diagnostics": lambda s, d: delivery.signal_diagnostics(deliveries(s, d)),
    "O-96_delivery_funnel": lambda s, d: delivery.funnel(c.events(s, d).withColumn("consented", F.col("event_id") % 6 != 0), deliveries(s, d)),
    "O-97_purchase_states": lambda s, d: delivery.purchase_states(bought(s, d).select("event_id"), deliveries(s, d)),
    "O-98_first_seen_touches": lambda s, d: delivery.first_seen(touch(s, d), F.lit("2024-01-05").cast("timestamp_ntz")),
    "O-169_delivery_health": health,
    "O-161_customer_match": matched_customers,
    "O-163_purchase_eligibility": lambda s, d: bought(s, d).select("event_id", delivery.eligibility(source=F.when(F.col("k") % 9 == 0, "pos").otherwise("web"), is_test=F.col("k") % 10 == 1, is_b2b=F.col("k") % 11 == 2, cancelled=F.col("k") % 12 == 3, linked=F.col("order_linked"), has_facts=F.lit(True), before_install=F.col("event_at") < F.lit("2024-01-03").cast("timestamp_ntz"), value=F.col("k")).alias("reason")).groupBy("reason").agg(F.count("*").alias("orders")),
    "O-192_enqueued": lambda s, d: delivery.enqueued(bought(s, d).select("event_id"), deliveries(s, d), ["META", "TIKTOK", "GOOGLE_ADS"]),
    "O-49_undelivered": lambda s, d: bought(s, d).join(deliveries(s, d).where("status = 'DELIVERED'"), F.col("event_id") == F.col("source_event_id"), "left_anti").groupBy("source").agg(F.count("*").alias("orders")),
    "O-54_or_key_counts": lambda s, d: or_key_counts(gapped(s, d).select("event_id", "session_id", "visitor_id"), sessions(s, d).select(F.col("session_id").alias("sid"), F.col("visitor_id").alias("vid")), ("session_id", "sid"), ("visitor_id", "vid"), "sessions").select("event_id", "sessions"),
    "O-33_selected_accounts": lambda s, d: c.ad_daily(s, d).where(selected(F.col("account_id"), [1, 3])).groupBy("account_id").agg(F.count("*").alias("facts")),
    "O-36_keyset": lambda s, d: delivery.after_key(c.events(s, d), ["received_at", "event_id"], [F.lit("2024-01-15").cast("timestamp_ntz"), F.lit(100)]).groupBy("event_name").agg(F.count("*").alias("events")),
    "O-51_still_shared": lambda s, d: delivery.still_shared(gapped(s, d).withColumn("shared", F.col("k") % 100 != 0), ["session_id", "visitor_id"]).groupBy("event_name").agg(F.count("*").alias("events")),
    "O-46_latest_runs": lambda s, d: delivery.latest_runs(c.table(s, d, "orders").select((F.col("o_custkey") % 50).alias("connection_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"))),
    "O-136_numbers": lambda s, d: c.table(s, d, "part").select(F.col("p_partkey").alias("product_id"), numeric(F.when(F.col("p_partkey") % 3 == 0, "x").when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string"))).alias("n")),
    "O-138_rate_points": lambda s, d: eco.period_changes(behavior(s, d, "STORE"), ["conversion_rate"], ["key"]).select("key", point_change(F.col("conversion_rate"), F.col("conversion_rate0")).alias("points")),
    "O-142_local_days": lambda s, d: c.table(s, d, "orders").groupBy(store_date(F.col("o_orderdate").cast("timestamp"), F.lit("America/New_York")).alias("day")).agg(F.count("*").alias("orders")),
    "O-15_upserted": upserted,
    "O-22_delete_missing": lambda s, d: sinks.delete_missing(c.table(s, d, "part").select(F.col("p_partkey").alias("k"), "p_size"), c.table(s, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k")), ["k"], F.col("p_size") < 25).select("k"),
    "O-153_normalized_text": lambda s, d: c.table(s, d, "part").select(F.col("p_partkey").alias("product_id"), web.normalized_text(F.concat_ws(" -- ", F.col("p_name"), F.lit("50% Off!"), F.col("p_brand"))).alias("text")),
    "O-156_catalog_items": lambda s, d: mapping.resolve_catalog_items(*mapping_fixture(s, d)),
    "O-158_text_suggestions": suggestions,
    "O-155_provider_ids": json_ids,
    "O-160_pixel_mappings": lambda s, d: rounded(mapping.pixel_mappings(target_evidence(s, d).where("target = 'PRODUCT'").select(F.col("ad_id").cast("long").alias("ad_id"), F.col("target_id").cast("long").alias("product_id"), "interacted_sessions", "viewed_sessions", "purchase_sessions"), c.mappings(s, d)), confidence=6),
    "O-150_routing": routed,
    "O-126_dirty_days": dirty_days,
    "O-130_invalidated_sessions": invalidated,
    "O-130_changed_ads": changed_ads,
    "O-44_versioned_costs": versioned_costs,
    "O-170_browser_pairs": browser_pairs,
    "O-191_contents": contents,
    "O-133_keyset_sweep": lambda s, d: delivery.swept(c.events(s, d).select("received_at", "event_id", "event_name"), ["received_at", "event_id"], [F.lit("2024-01-20").cast("timestamp_ntz"), F.lit(0)], 100),
    "O-135_retries": retries,
    "O-59_within_connection": lambda s, d: delivery.within_connection(c.events(s, d).withColumn("store_id", F.col("visitor_id") % 3), s.createDataFrame([(0, "2024-01-05"), (1, "2024-01-25")], "store_id long, t string").select("store_id", F.col("t").cast("timestamp_ntz").alias("installed_at"))).groupBy("store_id", "event_name").agg(F.count("*").alias("events")),
    "O-184_accounts_in_scope": lambda s, d: ads.in_scope(c.ad_daily(s, d).select("account_id", "provider", "currency").distinct(), provider="META", selected=[0, 1, 3], entitled=["META", "TIKTOK"]),
    "O-129_linked_orders": linked_orders,
    "W-24_purchase_candidates": purchase_candidates,
    "W-22_report": lambda s, d: rounded(report(s, d), order_value=2, mer=6),
    "O-48_shared_ads": lambda s, d: c.ad_daily(s, d).join(c.table(s, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("ad_id")), "ad_id", "left_semi").groupBy("provider").agg(F.count("*").alias("facts")),
    "O-38_json_counts": lambda s, d: c.table(s, d, "events").where(F.get_json_object("props", "$.k") == "7").groupBy("event_type").agg(F.count("*").alias("events")),
    "O-52_delivery_grid": lambda s, d: delivery.purchase_states(bought(s, d).select("event_id"), deliveries(s, d), ("META", "PINTEREST")),
    "O-151_touch_resolutions": lambda s, d: resolved(s, d).groupBy("resolution").agg(F.count("*").alias("touches")),
    "O-152_worst_resolutions": lambda s, d: storefront.worst_resolution(resolved(s, d), "visitor_id"),
    "O-47_store_health": store_health,
}
