"""Sessions, touches, daily behaviour and multi-touch attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import complement, safe_div, stage_drop
from ..functions.web import landing_page
from .joins import last_before

#: Events that a session counts, by the name of their counter.  Fixed values.
COUNTED = {"page_views": "PAGE_VIEW", "product_views": "PRODUCT_VIEW", "collection_views": "COLLECTION_VIEW", "searches": "SEARCH", "adds_to_cart": "ADD_TO_CART", "removes_from_cart": "REMOVE_FROM_CART", "cart_views": "CART_VIEW", "checkouts": "BEGIN_CHECKOUT", "purchases": "CHECKOUT_COMPLETED"}
#: Days that a journey looks back.
LOOKBACK_DAYS = 30


def accepted(events: DataFrame) -> DataFrame:
    """Events at most 7 days late and at most 10 minutes ahead of their arrival."""
    return events.where("event_at >= received_at - interval 7 days and event_at <= received_at + interval 10 minutes")


def expires_at(received_at: Column, days: int = 90) -> Column:
    """When an event is to be forgotten; 1 to 365 days."""
    return received_at + F.make_dt_interval(F.lit(max(1, min(365, days))))


def unexpired(events: DataFrame, now: Column, sessions_to_keep: DataFrame | None = None) -> DataFrame:
    """Events before their time, and those of sessions that are still to be rebuilt; sessions_to_keep: (session_id)."""
    live = F.col("retention_expires_at") > now
    if sessions_to_keep is None:
        return events.where(live)
    kept = sessions_to_keep.select("session_id").distinct().withColumn("_kept", F.lit(True))
    return events.join(kept, "session_id", "left").where(live | F.col("_kept")).drop("_kept")


def sessions_by_gap(events: DataFrame, minutes: int) -> DataFrame:
    """For tables without session ids: a session ends where a visitor pauses longer than the gap."""
    w = Window.partitionBy("visitor_id").orderBy("event_at", "event_id")
    new = F.coalesce((F.lag("event_at").over(w) + F.expr(f"interval {minutes} minutes")) <= F.col("event_at"), F.lit(True))
    n = F.sum(F.col("_new").cast("int")).over(w)
    return events.withColumn("_new", new).withColumn("session_id", F.concat_ws(":", "visitor_id", n)).drop("_new")


def materialize_sessions(events: DataFrame) -> DataFrame:
    """One row per session: its first event's visitor and landing page, span, counts and stages.

    Events count once however often they arrive.  several_visitors marks a session
    of doubtful quality.  A linked purchase is a completed checkout whose valid order is known.
    """
    once = events.dropDuplicates(["event_id"])
    at = F.struct("event_at", "event_id")
    n = lambda name: F.count_if(F.col("event_name") == name)
    first = lambda name: F.min(F.when(F.col("event_name") == name, F.col("event_at")))
    return once.groupBy("session_id").agg(
        F.min_by("visitor_id", at).alias("visitor_id"), (F.count_distinct("visitor_id") > 1).alias("several_visitors"), F.min("event_at").alias("started_at"), F.max("event_at").alias("ended_at"), F.count("*").alias("events"),
        *[n(name).alias(c) for c, name in COUNTED.items()],
        first("BEGIN_CHECKOUT").alias("checkout_started_at"), first("CHECKOUT_COMPLETED").alias("checkout_completed_at"), F.coalesce(F.bool_or("order_linked"), F.lit(False)).alias("linked_purchase"),
        F.min_by("page_url", F.when(F.col("page_url").isNotNull(), at)).alias("landing_url"), F.min_by("event_id", at).alias("first_event_id"), F.max_by("event_id", at).alias("last_event_id"),
    )


def session_products(events: DataFrame) -> DataFrame:
    """What a session did with each product: views, adds, removals, and when first and last."""
    n = lambda name: F.count_if(F.col("event_name") == name)
    once = events.where("product_id is not null").dropDuplicates(["event_id"])
    return once.groupBy("session_id", "product_id").agg(n("PRODUCT_VIEW").alias("views"), n("ADD_TO_CART").alias("adds"), n("REMOVE_FROM_CART").alias("removals"), F.min("event_at").alias("first_seen_at"), F.max("event_at").alias("last_seen_at"))


def session_collections(events: DataFrame) -> DataFrame:
    """How often a session saw each collection, and when first and last."""
    once = events.where("event_name = 'COLLECTION_VIEW' and collection_id is not null").dropDuplicates(["event_id"])
    return once.groupBy("session_id", "collection_id").agg(F.count("*").alias("views"), F.min("event_at").alias("first_seen_at"), F.max("event_at").alias("last_seen_at"))


def touches(events: DataFrame, signature: list[str]) -> DataFrame:
    """Touches of a session in order, with the session's start: an event whose signature differs from the one before it starts a new touch."""
    w = Window.partitionBy("session_id").orderBy("event_at", "event_id")
    now = F.struct(*signature)
    first = F.row_number().over(w) == 1
    marked = events.withColumn("session_started_at", F.min("event_at").over(Window.partitionBy("session_id"))).withColumn("_new", first | ~now.eqNullSafe(F.lag(now).over(w))).where("_new").drop("_new")
    return marked.withColumn("ordinal", F.row_number().over(w))


_FUNNEL = {
    "view_sessions": "product_views > 0", "collection_view_sessions": "collection_views > 0", "cart_sessions": "adds_to_cart > 0", "cart_view_sessions": "cart_views > 0", "cart_view_checkout_sessions": "cart_views > 0 and checkouts > 0", "cart_view_purchase_sessions": "cart_views > 0 and linked_purchase",
    "checkout_sessions": "checkouts > 0", "checkout_purchase_sessions": "checkouts > 0 and linked_purchase", "purchase_sessions": "linked_purchase",
}
FUNNEL_COLUMNS = ["sessions", *_FUNNEL]


def behavior_daily(sessions: DataFrame, products: DataFrame, collections: DataFrame | None = None, ordered: DataFrame | None = None) -> DataFrame:
    """The cube of daily behaviour: sessions by the day they start on, over the store, the landing page, each product and each collection.

    products: ``session_products``; its rows count a product's own views and adds, and a
    purchase if the session's linked order has the product.  ordered: (session_id,
    product_id) of these orders' lines; where they aren't known, a product counts as bought if it was
    added to the cart.  collections: ``session_collections``; a purchase counts for all of a session's collections.
    """
    day = F.to_date("started_at").alias("day")
    places = F.array(F.struct(F.lit("STORE").alias("dimension"), F.lit("store").alias("key")), F.struct(F.lit("LANDING_PAGE").alias("dimension"), landing_page(F.col("landing_url")).alias("key")))
    whole = sessions.select("*", F.inline(places)).where("key is not null")
    counted = [F.count("*").alias("sessions"), *[F.count_if(F.expr(e)).alias(c) for c, e in _FUNNEL.items()]]
    rows = whole.groupBy(day, "dimension", "key").agg(*counted)
    stages = sessions.select("session_id", "started_at", "cart_views", "checkouts", "linked_purchase")
    none = F.lit(0).cast("long")
    each = products.join(stages, "session_id")
    if ordered is None:
        has = F.col("adds") > 0
    else:
        each = each.join(ordered.select("session_id", "product_id").distinct().withColumn("_ordered", F.lit(True)), ["session_id", "product_id"], "left")
        has = F.coalesce("_ordered", F.lit(False))
    each = each.select("started_at", F.col("product_id").cast("string").alias("key"), F.lit("PRODUCT").alias("dimension"), F.col("views").alias("product_views"), none.alias("collection_views"), F.col("adds").alias("adds_to_cart"), "cart_views", "checkouts", (F.col("linked_purchase") & has).alias("linked_purchase"))
    if collections is not None:
        seen = collections.join(stages, "session_id")
        each = each.unionByName(seen.select("started_at", F.col("collection_id").cast("string").alias("key"), F.lit("COLLECTION").alias("dimension"), none.alias("product_views"), F.col("views").alias("collection_views"), none.alias("adds_to_cart"), none.alias("cart_views"), "checkouts", "linked_purchase"))
    return rows.unionByName(each.groupBy(day, "dimension", "key").agg(*counted))


def with_rates(funnel: DataFrame) -> DataFrame:
    """The funnel's rates and the stage that loses the largest share."""
    c = F.col
    done = safe_div(c("checkout_purchase_sessions"), c("checkout_sessions"))
    out = funnel.withColumns({
        "conversion_rate": safe_div(c("purchase_sessions"), c("sessions")), "view_to_cart": safe_div(c("cart_sessions"), c("view_sessions")), "purchase_rate": safe_div(c("purchase_sessions"), c("view_sessions")),
        "cart_abandonment": complement(safe_div(c("cart_view_purchase_sessions"), c("cart_view_sessions"))), "checkout_abandonment": complement(done),
    })
    return largest_drop(out)


def largest_drop(funnel: DataFrame) -> DataFrame:
    """The funnel stage that loses the largest share; the first of equals, null without any stage's evidence."""
    steps = [("SESSION_TO_PRODUCT", "sessions", "view_sessions"), ("PRODUCT_TO_CART", "view_sessions", "cart_sessions"), ("CART_TO_CHECKOUT", "cart_view_sessions", "cart_view_checkout_sessions"), ("CHECKOUT_TO_PURCHASE", "checkout_sessions", "checkout_purchase_sessions")]
    drops = F.array(*[F.struct(stage_drop(F.col(b), F.col(a)).alias("drop"), F.lit(-k).alias("k"), F.lit(s).alias("stage")) for k, (s, a, b) in enumerate(steps)])
    best = F.array_max(F.filter(drops, lambda d: d["drop"].isNotNull()))
    return funnel.withColumn("largest_drop_stage", best["stage"]).withColumn("largest_drop", best["drop"])


def behavior_read(cube: DataFrame, dimension: str, periods: Column) -> DataFrame:
    """A dimension's keys by period, summed over days, with rates; periods labels a day, null days are left out."""
    own = cube.where(F.col("dimension") == dimension).withColumn("period", periods).where("period is not null")
    return with_rates(own.groupBy("period", "key").agg(*[F.sum(c).alias(c) for c in FUNNEL_COLUMNS]))


def behavior_evidence(read: DataFrame) -> DataFrame:
    """Both periods of each key side by side, as rules need them: x and x0; counts of a missing period are 0."""
    names = [*FUNNEL_COLUMNS, "conversion_rate", "view_to_cart", "purchase_rate", "cart_abandonment", "checkout_abandonment"]
    pick = lambda m, p: F.max(F.when(F.col("period") == p, F.col(m)))
    out = read.groupBy(F.col("key").alias("entity_id")).agg(*[pick(m, p).alias(m + z) for m in names for p, z in (("CURRENT", ""), ("COMPARISON", "0"))])
    return out.fillna(0, [c + z for c in FUNNEL_COLUMNS for z in ("", "0")]).withColumn("product_views", F.col("view_sessions")).withColumn("product_views0", F.col("view_sessions0"))


def insight_changes(read: DataFrame) -> DataFrame:
    """Point changes of a store's rates; that of the largest drop only if both periods lose most at the same stage."""
    names = ["cart_abandonment", "checkout_abandonment", "conversion_rate", "largest_drop", "largest_drop_stage"]
    pick = lambda m, p: F.max(F.when(F.col("period") == p, F.col(m)))
    both = read.groupBy("key").agg(*[pick(m, p).alias(m + z) for m in names for p, z in (("CURRENT", ""), ("COMPARISON", "0"))])
    out = both.withColumns({f"{m}_points": F.col(m) - F.col(f"{m}0") for m in names[:3]})
    return out.withColumn("largest_drop_points", F.when(F.col("largest_drop_stage") == F.col("largest_drop_stage0"), F.col("largest_drop") - F.col("largest_drop0")))


def checkout_purchase_overlap(sessions: DataFrame) -> DataFrame:
    """By local day: sessions that began a checkout, those whose linked order is valid, and those with both."""
    return sessions.groupBy(F.to_date("started_at").alias("day")).agg(F.count_if(F.col("checkout_started_at").isNotNull()).alias("checkout_sessions"), F.count_if("linked_purchase").alias("purchase_sessions"), F.count_if(F.col("checkout_started_at").isNotNull() & F.col("linked_purchase")).alias("both_sessions"))


def _identities(source: Column, ad: Column) -> Column:
    """What a touch gives credit to: its source, and the ad of the one source whose ads are resolved, if it is known exactly."""
    at = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.cast("string").alias("key"))
    return F.array_compact(F.array(at("SOURCE", source), F.when(ad.isNotNull() & (source == "META"), at("META_AD", ad))))


def _journey_key(session: str) -> Column:
    """Who a journey belongs to: the visitor, or the session alone without one."""
    return F.coalesce(_visitor_key(), F.concat(F.lit("s"), F.col(session).cast("string"))).alias("journey_key")


def _visitor_key() -> Column:
    return F.concat(F.lit("v"), F.col("visitor_id").cast("string")).alias("journey_key")


def _touch_order() -> Column:
    return F.struct("touched_at", "ordinal", "session_started_at", "session_id")


#: Days of a bucket in which purchases meet what came before them; a look-back spans two of them, or three.
BUCKET_DAYS = 32


def _in_window(purchases: DataFrame, rows: DataFrame, days: int) -> DataFrame:
    """Purchases with the rows of their journey key whose ``day`` is from ``days`` days before the session's to the cutoff's.

    purchases: (purchase_id, journey_key, started_at, cutoff_at); rows: (journey_key, day, ...).
    """
    bucket = lambda d: F.floor(F.unix_date(d) / BUCKET_DAYS)
    low, high = F.date_sub(F.to_date("started_at"), days), F.to_date("cutoff_at")
    wanted = purchases.select("purchase_id", "journey_key", "cutoff_at", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(bucket(low), bucket(high))).alias("_bucket"))
    met = wanted.join(rows.withColumn("_bucket", bucket(F.col("day"))), ["journey_key", "_bucket"])
    return met.where("day between _low and _high").drop("_bucket", "_low", "_high")


def _bought(sessions: DataFrame) -> DataFrame:
    return sessions.where("linked_purchase").select(F.col("session_id").alias("purchase_id"), _journey_key("session_id"), "started_at", "checkout_completed_at", F.coalesce("checkout_completed_at", "ended_at").alias("cutoff_at"))


def credits(sessions: DataFrame, touch: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """(purchase_id, day, dimension, key, is_first, is_last, is_assisted, single_touch, cross_session, delay_ms): a row per identity of each purchase's journey.

    A journey has the touches up to the checkout of the visitor's sessions that
    start from ``days`` days before the purchase session's day on; without a
    visitor, the session's own.  assisted: a touch before the last one;
    single_touch: the journey is one touch; cross_session: its touches are of
    several sessions; delay: from the first of its sessions' starts to the completed checkout, null without one.
    Touches are reduced to one per visitor, identity and day before purchases meet
    them, so a visitor of many touches and purchases costs no product of both.
    """
    bought = _bought(sessions)
    marks = F.concat(_identities(F.col("source"), F.col("ad_id")), F.array(F.struct(F.lit("SESSION").alias("dimension"), F.col("session_id").cast("string").alias("key"))))
    own = touch.select(_journey_key("session_id"), F.to_date("session_started_at").alias("day"), _touch_order().alias("at"), F.inline(marks))
    start = F.struct(F.col("started_at").alias("touched_at"), F.lit(0).alias("ordinal"), F.col("started_at").alias("session_started_at"), "session_id")
    begun = sessions.select(_journey_key("session_id"), F.to_date("started_at").alias("day"), start.alias("at"), F.lit("START").alias("dimension"), F.lit("").alias("key"))
    daily = own.unionByName(begun).groupBy("journey_key", "day", "dimension", "key").agg(F.min("at").alias("at"))
    found = _in_window(bought, daily, days).where("at.touched_at <= cutoff_at").groupBy("purchase_id", "dimension", "key").agg(F.min("at").alias("first"))
    w, credited = Window.partitionBy("purchase_id"), F.col("dimension").isin("SOURCE", "META_AD")
    found = found.withColumns({
        "begin": F.min(F.when(credited, F.col("first"))).over(w), "n_sessions": F.sum(F.when(F.col("dimension") == "SESSION", 1)).over(w), "start": F.min(F.when(F.col("dimension") == "START", F.col("first.touched_at"))).over(w),
    }).where(credited)
    keyed = touch.select(_journey_key("session_id"), "touched_at", "ordinal", "session_started_at", "session_id", "source", "ad_id")
    # the purchase session's own touches are the last ones but for sessions beside it, so the search need not begin earlier
    last = last_before(bought, keyed, on=["journey_key"], at="cutoff_at", when="touched_at", days=days, since="started_at", ties=["ordinal", "session_started_at", "session_id"], take=["source", "ad_id"])
    each = found.join(last.select("purchase_id", F.to_date("started_at").alias("day"), "started_at", "checkout_completed_at", "_last"), "purchase_id")
    end = F.struct(*[F.col(f"_last.{n}").alias(n) for n in ("touched_at", "ordinal", "session_started_at", "session_id")])
    is_last = F.exists(_identities(F.col("_last.source"), F.col("_last.ad_id")), lambda x: (x["dimension"] == F.col("dimension")) & (x["key"] == F.col("key")))
    return each.select(
        "purchase_id", "day", "dimension", "key", (F.col("first") == F.col("begin")).alias("is_first"), is_last.alias("is_last"), (F.col("first") < end).alias("is_assisted"), (F.col("begin") == end).alias("single_touch"),
        (F.col("n_sessions") > 1).alias("cross_session"), _delay_ms(F.least("start", "started_at"), F.col("checkout_completed_at")).alias("delay_ms"),
    )


def _delay_ms(start: Column, end: Column) -> Column:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    delay = F.floor((us(end) - us(start)) / 1000)
    return F.when(delay >= 0, delay)


def attribution(sessions: DataFrame, touch: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Credits by day, dimension (SOURCE or META_AD) and key: see ``credits``.

    A session counts as touched by each identity of its own touches, a purchase by each of its journey's.
    """
    seen = touch.select("session_id", F.to_date("session_started_at").alias("day"), F.inline(_identities(F.col("source"), F.col("ad_id")))).distinct()
    touched = seen.groupBy("day", "dimension", "key").agg(F.count("*").alias("touched_sessions"))
    credit = credits(sessions, touch, days).groupBy("day", "dimension", "key").agg(
        F.count("*").alias("purchases"), F.count_if("is_first").alias("first_touch"), F.count_if("is_last").alias("last_touch"), F.count_if("is_assisted").alias("assisted"),
        F.count_if("single_touch").alias("single_touch"), F.count_if("cross_session").alias("cross_session"), F.coalesce(F.sum("delay_ms"), F.lit(0)).alias("delay_ms"), F.count("delay_ms").alias("delays"),
    )
    return touched.join(credit, ["day", "dimension", "key"], "full").fillna(0)


def conversion_starts(purchases: DataFrame, sessions: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Purchases with the start of the first session of their journey key in the days before, and the delay in milliseconds.

    purchases: (purchase_id, journey_key, started_at, cutoff_at); sessions without a session_id count for their visitor only.
    """
    key = _journey_key("session_id") if "session_id" in sessions.columns else _visitor_key()
    daily = sessions.groupBy(key, F.to_date("started_at").alias("day")).agg(F.min("started_at").alias("_start"))
    first = _in_window(purchases, daily, days).where("_start <= cutoff_at").groupBy("purchase_id").agg(F.min("_start").alias("journey_started_at"))
    return purchases.join(first, "purchase_id", "left").withColumn("delay_ms", _delay_ms(F.col("journey_started_at"), F.col("cutoff_at")))


def conversion_delays(purchases: DataFrame, sessions: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Milliseconds from the start of the visitor's first session of the days before a purchase; null without one."""
    rows = purchases.withColumns({"started_at": F.col("purchased_at"), "cutoff_at": F.col("purchased_at"), "journey_key": _visitor_key()})
    return conversion_starts(rows, sessions, days).drop("started_at", "cutoff_at", "journey_key")


def last_clicks(orders: DataFrame, clicks: DataFrame, providers: list[str], days: int = LOOKBACK_DAYS) -> DataFrame:
    """Each order with the visitor's last click of each provider in the days before it; ties by arrival, then id.

    clicks: (visitor_id, provider, click_id, clicked_at, received_at), those whose consent stands.
    """
    out = orders
    for p in providers:
        own = last_before(orders, clicks.where(F.col("provider") == p), on=["visitor_id"], at="ordered_at", when="clicked_at", days=days, ties=["received_at", "click_id"], take=[])
        out = out.join(own.select("order_id", F.col("_last.click_id").alias(f"{p.lower()}_click_id")), "order_id", "left")
    return out


def _path(steps: Column) -> Column:
    """Sources in order without repeats in a row; UNKNOWN without any."""
    sources = F.transform(F.array_sort(steps), lambda x: x["source"])
    # bound by a lambda of its own: named twice, the steps would be sorted again for each of them
    kept = F.get(F.transform(F.array(sources), lambda all_: F.filter(all_, lambda x, k: (k == 0) | (x != F.get(all_, k - 1)))), 0)
    return F.when(F.size(kept) > 0, F.array_join(kept, ">")).otherwise("UNKNOWN")


def source_paths(touch: DataFrame, sessions: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """(day, path, is_session, bought, cross_session, delay_ms): each session's own path, and the path of each purchase's journey.

    A session's path ends at its checkout and is SESSION:UNKNOWN without touches.  A
    journey's path goes through all sessions of ``credits``' journey; its length is that of its result.
    """
    w = Window.partitionBy("session_id").orderBy("touched_at", "ordinal")
    changes = touch.withColumn("_p", F.lag("source").over(w)).where("_p is null or _p <> source")
    step = F.struct("touched_at", "ordinal", "session_started_at", "session_id", "source").alias("step")
    cutoff = F.when(F.col("linked_purchase"), F.coalesce("checkout_completed_at", "ended_at")).otherwise(F.col("ended_at")).alias("cutoff_at")
    own = changes.join(sessions.select("session_id", cutoff), "session_id").where("touched_at <= cutoff_at").groupBy("session_id").agg(F.collect_list(step).alias("steps"))
    empty = F.coalesce("steps", F.array())
    alone = sessions.select("session_id", F.to_date("started_at").alias("day"), "linked_purchase").join(own, "session_id", "left")
    alone = alone.select("day", F.concat(F.lit("SESSION:"), _path(empty)).alias("path"), F.lit(True).alias("is_session"), F.col("linked_purchase").alias("bought"), F.lit(False).alias("cross_session"), F.lit(None).cast("long").alias("delay_ms"))

    bought = _bought(sessions)
    rows = changes.select(_journey_key("session_id"), F.to_date("session_started_at").alias("day"), step)
    met = _in_window(bought, rows, days).where("step.touched_at <= cutoff_at").groupBy("purchase_id").agg(F.collect_list("step").alias("steps"), (F.count_distinct("step.session_id") > 1).alias("cross_session"))
    timed = conversion_starts(bought, sessions, days).withColumn("delay_ms", F.when(F.col("checkout_completed_at").isNotNull(), F.col("delay_ms")))
    through = timed.join(met, "purchase_id", "left").select(F.to_date("started_at").alias("day"), F.concat(F.lit("JOURNEY:"), _path(empty)).alias("path"), F.lit(False).alias("is_session"), F.lit(True).alias("bought"), F.coalesce("cross_session", F.lit(False)).alias("cross_session"), "delay_ms")
    return alone.unionByName(through)


def path_daily(paths: DataFrame) -> DataFrame:
    """Paths by day, with a stable key: sessions, purchases, those of several sessions, and delays."""
    return paths.groupBy("day", "path", F.sha2("path", 256).alias("path_key")).agg(F.count_if("is_session").alias("sessions"), F.count_if("bought").alias("purchase_sessions"), F.count_if("cross_session").alias("cross_session"), F.coalesce(F.sum("delay_ms"), F.lit(0)).alias("delay_ms"), F.count("delay_ms").alias("delays"))


def target_evidence(touch: DataFrame, products: DataFrame, sessions: DataFrame, *, ordered: DataFrame, collections: DataFrame | None = None, days: int = LOOKBACK_DAYS) -> DataFrame:
    """By day, exact ad and target (PRODUCT or COLLECTION): sessions that the ad touched and that dealt with the target, and their purchases.

    A purchase counts if the order has the product (for a collection: at all) and
    the ad is in its journey; with it, whether the ad was the first, the last or an assisting touch.
    ordered: (session_id, product_id), the lines of sessions' linked orders.
    """
    ads = touch.select("session_id", F.inline(_identities(F.col("source"), F.col("ad_id")))).where("dimension = 'META_AD'").select("session_id", F.col("key").alias("ad_id")).distinct()
    has = ordered.select("session_id", "product_id").distinct().withColumn("has", F.lit(True))
    targets = products.join(has, ["session_id", "product_id"], "left").select("session_id", F.lit("PRODUCT").alias("target"), F.col("product_id").cast("string").alias("target_id"), "views", "adds", F.coalesce("has", F.lit(False)).alias("has"))
    if collections is not None:
        targets = targets.unionByName(collections.select("session_id", F.lit("COLLECTION").alias("target"), F.col("collection_id").cast("string").alias("target_id"), "views", F.lit(0).cast("long").alias("adds"), F.lit(True).alias("has")))
    credit = credits(sessions, touch, days).where("dimension = 'META_AD'").select(F.col("purchase_id").alias("session_id"), F.col("key").alias("ad_id"), "is_first", "is_last", "is_assisted")
    met = ads.join(targets, "session_id").join(sessions.select("session_id", F.to_date("started_at").alias("day")), "session_id").join(credit, ["session_id", "ad_id"], "left")
    bought = F.col("has") & F.col("is_first").isNotNull()
    return met.groupBy("day", "ad_id", "target", "target_id").agg(
        F.count("*").alias("interacted_sessions"), F.count_if(F.col("views") > 0).alias("viewed_sessions"), F.count_if(F.col("adds") > 0).alias("cart_sessions"), F.count_if(bought).alias("purchase_sessions"),
        *[F.count_if(bought & F.col(f"is_{n}")).alias(f"{n}_touch") for n in ("first", "last")], F.count_if(bought & F.col("is_assisted")).alias("assisted"),
    )


def attribution_health(attribution_rows: DataFrame, source: str = "META") -> DataFrame:
    """What a source touched and sold in all."""
    own = attribution_rows.where((F.col("dimension") == "SOURCE") & (F.col("key") == source))
    return own.agg(F.coalesce(F.sum("touched_sessions"), F.lit(0)).alias("touched_sessions"), F.coalesce(F.sum("purchases"), F.lit(0)).alias("purchase_sessions"))


def first_touch_sources(touch: DataFrame, products: DataFrame) -> DataFrame:
    """By product: distinct sessions by the source of their first touch."""
    first = touch.groupBy("session_id").agg(F.min_by("source", F.struct("touched_at", "ordinal")).alias("source"))
    return products.select("session_id", "product_id").distinct().join(first, "session_id").groupBy("product_id", "source").agg(F.count("*").alias("sessions"))


def link_retry_at(tried_at: Column, attempts: Column) -> Column:
    """When a session's order is looked for again: 5 minutes after the first try, doubled up to 7 times, 6 hours at most."""
    minutes = F.least(F.lit(360.0), F.lit(5.0) * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(7)))).cast("int")
    return tried_at + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def linked_orders(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Sessions that name an order with its state: LINKED once the order has arrived, PENDING until then, with the next try.

    sessions: (session_id, order_ext, attempts, tried_at), attempts with the one at tried_at; orders: (order_ext, order_id).
    """
    out = sessions.where("order_ext is not null").join(orders, "order_ext", "left")
    state = F.when(F.col("order_id").isNotNull(), "LINKED").otherwise("PENDING")
    return out.withColumn("link_status", state).withColumn("next_try_at", F.when(F.col("order_id").isNull(), link_retry_at(F.col("tried_at"), F.col("attempts"))))


def visitor_journeys(sessions: DataFrame) -> DataFrame:
    """Each visitor's sessions in order, with the pause before each and the purchases up to it."""
    w = Window.partitionBy("visitor_id").orderBy("started_at", "session_id")
    pause = F.unix_seconds(F.col("started_at").cast("timestamp")) - F.unix_seconds(F.lag("ended_at").over(w).cast("timestamp"))
    return sessions.select("visitor_id", "session_id", F.row_number().over(w).alias("ordinal"), "started_at", "ended_at", "purchases", pause.alias("seconds_since_previous"), F.sum("purchases").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("purchases_so_far"))


def video_retention(rows: DataFrame, minimum_plays: int = 50) -> DataFrame:
    """A creative's video funnel by period: rates from play to play, the stage that loses most, and watch time weighted by plays.

    rows: (creative_id, period, plays, p25, p50, p75, p95, p100, watch_seconds).  Counts that grow along the video are inconsistent.
    """
    steps = ["plays", "p25", "p50", "p75", "p95", "p100"]
    sums = rows.groupBy("creative_id", "period").agg(*[F.sum(s).alias(s) for s in steps], safe_div(F.sum(F.col("watch_seconds") * F.col("plays")), F.sum(F.when(F.col("watch_seconds").isNotNull(), F.col("plays")))).alias("average_watch_seconds"))
    consistent = reduce(lambda a, b: a & b, [F.coalesce(F.col(b) <= F.col(a), F.lit(True)) for a, b in zip(steps, steps[1:])])
    rates = {f"to_{s}": safe_div(F.col(s), F.col("plays")) for s in steps[1:]}
    drops = F.array(*[F.struct(stage_drop(F.col(b), F.col(a)).alias("drop"), F.lit(-k).alias("k"), F.lit(f"{a}_TO_{b}".upper()).alias("stage")) for k, (a, b) in enumerate(zip(steps, steps[1:]))])
    best = F.array_max(F.filter(drops, lambda d: d["drop"].isNotNull()))
    status = F.when(F.coalesce("plays", F.lit(0)) < minimum_plays, "INSUFFICIENT_PLAYS").when(~consistent, "INCONSISTENT").otherwise("READY")
    return sums.withColumns(rates).withColumn("largest_drop_stage", best["stage"]).withColumn("largest_drop", best["drop"]).withColumn("status", status)


#: What the ids of an identity come to, from the most harmless on.  Fixed values.
RESOLUTIONS = ("NONE", "EXACT", "PARTIAL", "UNRESOLVED", "CONFLICT")


def resolve_touches(touch: DataFrame, ads: DataFrame) -> DataFrame:
    """Touches with ``resolution``: whether the ids they name are one place of the hierarchy.

    EXACT: the ad is known and what else is named fits it; CONFLICT: it doesn't;
    PARTIAL: only the group or the campaign is known; UNRESOLVED: nothing named
    is known; NONE: nothing is named.  touch: (touch_id, campaign_ext, group_ext, ad_ext); ads: the same three, a row per ad.
    """
    by_ad = ads.select("ad_ext", F.col("group_ext").alias("_g"), F.col("campaign_ext").alias("_c"))
    groups = ads.groupBy("group_ext").agg(F.min("campaign_ext").alias("_gc"))
    campaigns = ads.select("campaign_ext").distinct().withColumn("_known", F.lit(True))
    out = touch.join(by_ad, "ad_ext", "left").join(groups, "group_ext", "left").join(campaigns, "campaign_ext", "left")
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    named = F.col("ad_ext").isNotNull() | F.col("group_ext").isNotNull() | F.col("campaign_ext").isNotNull()
    state = (
        F.when(~named, "NONE")
        .when(F.col("_g").isNotNull(), F.when(differs("group_ext", "_g") | differs("campaign_ext", "_c"), "CONFLICT").otherwise("EXACT"))
        .when(F.col("_gc").isNotNull(), F.when(differs("campaign_ext", "_gc"), "CONFLICT").otherwise("PARTIAL"))
        .when(F.col("_known"), "PARTIAL")
        .otherwise("UNRESOLVED")
    )
    return out.select(*touch.columns, state.alias("resolution"))


def worst_resolution(touch: DataFrame, key: str) -> DataFrame:
    """The resolution that stands for all of a key's touches: that of the worst one."""
    rank = F.array_position(F.array(*map(F.lit, RESOLUTIONS)), F.col("resolution"))
    return touch.groupBy(key).agg(F.max_by("resolution", rank).alias("resolution"))


def side_by_side(stores: DataFrame, parts: dict[str, DataFrame], key: str = "store_id") -> DataFrame:
    """Stores with aggregates of several tables beside each other; each part has a row per store and comes in under its own columns."""
    return reduce(lambda out, part: out.join(part, key, "left"), parts.values(), stores)
