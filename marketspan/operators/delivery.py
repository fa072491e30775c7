"""Conversions sent to providers: what was collected, queued and accepted, who can be matched, what may be sent."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..functions.web import acquisition
from .joins import band_join

PROVIDERS = ("META", "TIKTOK", "GOOGLE_ADS")
_WAITING = ("PENDING", "PROCESSING", "RETRY")


def _flag(column: str, path: str) -> Column:
    return F.count_if(F.get_json_object(column, f"$.{path}") == "true")


def signal_diagnostics(deliveries: DataFrame) -> DataFrame:
    """By provider, event, state and reason: how many, how many were measured, and what their matching and contents cover."""
    total = lambda p: F.coalesce(F.sum(F.get_json_object("content_coverage", f"$.{p}").cast("long")), F.lit(0))
    return deliveries.groupBy("provider", "event_name", "status", "reason_code").agg(F.count("*").alias("total"), F.count("match_coverage").alias("measured"), _flag("match_coverage", "email").alias("email"), _flag("match_coverage", "clickId").alias("click_id"), F.count("content_coverage").alias("content_measured"), total("observedItems").alias("observed_items"), total("mappedItems").alias("mapped_items"))


def _grid(df: DataFrame, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    return df.withColumn("provider", F.explode(F.array(*map(F.lit, providers))))


def funnel(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """By provider and event: collected, consented, queued, acknowledged; every provider has a row for every event."""
    collected = events.groupBy("event_name").agg(F.count("*").alias("collected"), F.count_if("consented").alias("consented"))
    # one row per event and provider first, so that counts of events need no distinct
    once = deliveries.groupBy("source_event_id", "provider").agg(F.bool_or(F.col("match_coverage").isNotNull()).alias("measured"), F.bool_or(F.col("status") == "DELIVERED").alias("acknowledged"))
    sent = once.join(events.select(F.col("event_id").alias("source_event_id"), "event_name"), "source_event_id").groupBy("provider", "event_name").agg(F.count("*").alias("queued"), F.count_if("measured").alias("matching_measured"), F.count_if("acknowledged").alias("acknowledged"))
    return _grid(collected).join(sent, ["provider", "event_name"], "left").fillna(0)


def purchase_states(orders: DataFrame, deliveries: DataFrame, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """By provider: orders accepted, else waiting, else failed, or never queued.  orders: (event_id)."""
    own = deliveries.where("event_name = 'PURCHASE'").groupBy(F.col("source_event_id").alias("event_id"), "provider").agg(F.bool_or(F.col("status") == "DELIVERED").alias("accepted"), F.bool_or(F.col("status").isin(*_WAITING)).alias("waiting"))
    states = _grid(orders.select("event_id"), providers).join(own, ["event_id", "provider"], "left")
    queued = F.col("accepted").isNotNull()
    return states.groupBy("provider").agg(F.count("*").alias("orders"), F.count_if(F.col("accepted")).alias("accepted"), F.count_if(queued & ~F.col("accepted") & F.col("waiting")).alias("waiting"), F.count_if(queued & ~F.col("accepted") & ~F.col("waiting")).alias("failed"), F.count_if(~queued).alias("not_queued"))


def health(deliveries: DataFrame, now: Column, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """By provider, over the real purchases of 30 days: states, the share of eligible ones accepted, and alerts.

    Eligible is all but what was skipped; what was only shadowed counts as eligible.  Alerts: a
    connection to be renewed; 5 dead ones that are a tenth of all that ended; what waits
    being due for more than 10 minutes.

    deliveries: (provider, event_name, status, reason_code, is_test, created_at, next_attempt_at).
    """
    own = deliveries.where((F.col("event_name") == "PURCHASE") & ~F.col("is_test") & (F.col("created_at") >= now - F.expr("interval 30 days")))
    n = lambda c: F.count_if(c)
    is_ = lambda *x: F.col("status").isin(*x)
    shadow = F.coalesce(F.col("reason_code") == "SHADOW_MODE", F.lit(False))
    sums = own.groupBy("provider").agg(
        n(~is_("SKIPPED") | shadow).alias("eligible"), n(is_("DELIVERED")).alias("acknowledged"), n(shadow).alias("shadow"), n(is_("PENDING", "PROCESSING")).alias("pending"), n(is_("RETRY")).alias("retrying"), n(is_("DEAD")).alias("terminal"),
        (n(is_("SKIPPED")) - n(shadow)).alias("excluded"), n(F.col("reason_code") == "CONNECTION_REAUTH_REQUIRED").alias("_reauth"), F.min(F.when(is_(*_WAITING), F.col("next_attempt_at"))).alias("_oldest"),
    )
    grid = deliveries.sparkSession.createDataFrame([(p,) for p in providers], "provider string")
    out = grid.join(sums, "provider", "left").fillna(0)
    ended = F.greatest(F.lit(1), F.col("acknowledged") + F.col("terminal"))
    alerts = F.array_compact(F.array(
        F.when(F.col("_reauth") > 0, "CREDENTIAL_RECONNECT_REQUIRED"), F.when((F.col("terminal") >= 5) & (F.col("terminal") / ended >= 0.1), "DELIVERY_FAILURE_RATE"), F.when(F.col("_oldest") < now - F.expr("interval 10 minutes"), "DELIVERY_QUEUE_STALE"),
    ))
    return out.withColumn("acceptance_rate", safe_div(F.col("acknowledged"), F.col("eligible"))).withColumn("alerts", F.array_join(alerts, ",")).drop("_reauth", "_oldest")


def first_seen(touch: DataFrame, since: Column) -> DataFrame:
    """Ads whose first touch of a visitor is not before a time."""
    return touch.where("ad_id is not null").groupBy("visitor_id", "ad_id").agg(F.min("touched_at").alias("first_touched_at")).where(F.col("first_touched_at") >= since)


def ordered_touches(touch: DataFrame) -> DataFrame:
    """Each session's touches as one JSON array in order."""
    return touch.groupBy("session_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("touched_at", "ordinal", "source")))).alias("touches"))


#: What identifies a touch for routing: its clicks, its utm values, the ids in its link.
SIGNATURE = ("meta_click", "tiktok_click", "google_click", "utm_source", "utm_medium", "utm_campaign", "utm_content", "meta_campaign", "meta_group", "meta_ad", "tiktok_campaign", "tiktok_group", "tiktok_ad")
#: What utm_medium may call paid media.  Fixed values.
PAID_MEDIA = ("paid_social", "paidsocial", "social_paid", "paid_search", "sem", "ppc", "cpc")


def routed_touches(touches: DataFrame) -> DataFrame:
    """Touches with ``provider``, ``basis``, ``campaign``, ``ad``, ``touch_key``, and whether they are ``paid`` or ``ambiguous``.

    A touch is ambiguous if its own signals name two providers, another one than its utm
    values do, or paid media where these say it isn't.  A click of the first provider alone
    may decorate any link, so its touches are paid only with a paid medium or an id.
    touches: the columns of SIGNATURE.
    """
    c, none = F.col, F.lit(None).cast("string")
    any_ = lambda *names: F.coalesce(*[F.when(c(n) != "", True) for n in names], F.lit(False))
    meta_link, tiktok_link = any_("meta_ad", "meta_group", "meta_campaign"), any_("tiktok_campaign", "tiktok_group", "tiktok_ad")
    utm = {"utm_source": c("utm_source"), "utm_medium": c("utm_medium"), "utm_campaign": c("utm_campaign")}
    link = lambda flag: F.when(flag, "1")
    found = acquisition(meta_click=c("meta_click"), tiktok_click=c("tiktok_click"), google_click=c("google_click"), tiktok_link=link(tiktok_link), meta_link=link(meta_link), referrer=none, page=none, **utm)
    declared = acquisition(meta_click=none, tiktok_click=none, google_click=none, tiktok_link=none, meta_link=none, referrer=none, page=none, **utm)
    canonical = lambda p: F.when(p.isin("META", "INSTAGRAM"), "META").when(p == "TIKTOK", "TIKTOK").when(p == "GOOGLE", "GOOGLE_ADS")
    out = touches.withColumn("_found", found).withColumn("_declared", declared)
    signals = F.array_distinct(F.array_compact(F.array(F.when(any_("meta_click") | meta_link, "META"), F.when(any_("tiktok_click") | tiktok_link, "TIKTOK"), F.when(any_("google_click"), "GOOGLE_ADS"))))
    provider, said = canonical(c("_found.provider")), canonical(c("_declared.provider"))
    signalled = F.size(signals) > 0
    twofold = (F.size(signals) > 1) | (signalled & F.coalesce(~said.eqNullSafe(provider) & said.isNotNull(), F.lit(False)))
    medium = F.coalesce(F.lower(F.trim("utm_medium")).isin(*PAID_MEDIA), F.lit(False))
    paid = provider.isNotNull() & F.coalesce(c("_found.paid"), F.lit(False)) & ((provider != "META") | medium | meta_link)
    denied = paid & signalled & F.coalesce(~c("_declared.paid"), F.lit(False))
    click = F.when(provider == "META", c("meta_click")).when(provider == "TIKTOK", c("tiktok_click")).otherwise(c("google_click"))
    others = F.to_json(F.struct(*[c(n) for n in SIGNATURE if not n.endswith("_click")]))
    is_tiktok = provider == "TIKTOK"
    return out.withColumns({
        "ambiguous": twofold | denied, "paid": paid & ~twofold & ~denied, "provider": provider, "basis": c("_found.basis"), "touch_key": F.concat_ws("|", provider, F.when(click != "", click).otherwise(others)),
        "campaign": F.coalesce(F.when(is_tiktok, c("tiktok_campaign")).otherwise(c("meta_campaign")), c("utm_campaign")), "ad": F.when(is_tiktok, c("tiktok_ad")).otherwise(F.coalesce("meta_ad", "utm_content")),
    }).drop("_found", "_declared")


def routing(conversions: DataFrame, touches: DataFrame, *, since: Column, days: int = 30, most: int = 1000) -> DataFrame:
    """Per conversion: which providers its paid touches make eligible, the last of these, and why.

    Touches of the visitor or the session up to the conversion and not before
    ``since`` count once per signature, by their first time, which must be within
    ``days`` days.  One ambiguous touch makes no provider eligible; nor do more than ``most`` touches.
    A signature's first time doesn't depend on the conversion, so touches are reduced to one row per visitor (or
    session) and signature before conversions meet them.  Where all touches of a conversion's session are of its
    visitor, the session adds nothing to the visitor's touches and isn't looked at.

    conversions: (conversion_id, event_at, session_id, visitor_id); touches: (event_at, session_id, visitor_id, SIGNATURE).
    """
    visitor = F.concat(F.lit("visitor:"), F.col("visitor_id").cast("string"))
    scopes = F.array_compact(F.array(F.concat(F.lit("session:"), F.col("session_id").cast("string")), visitor))
    signed = touches.where((F.col("event_at") >= since) & F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in SIGNATURE if n not in ("utm_medium", "utm_campaign", "utm_content", "meta_group")], F.lit(False)))
    first = signed.select(F.explode(scopes).alias("scope"), "event_at", *SIGNATURE).groupBy("scope", *SIGNATURE).agg(F.min("event_at").alias("first_at"))
    known = routed_touches(first)
    owners = signed.where("session_id is not null").groupBy("session_id").agg(F.min("visitor_id").alias("_least"), F.max("visitor_id").alias("_greatest"), F.count_if(F.col("visitor_id").isNull()).alias("_unknown"))
    asked = conversions.select("conversion_id", "event_at", "session_id", "visitor_id").withColumn("_times", F.count("*").over(Window.partitionBy("conversion_id"))).join(owners, "session_id", "left")
    foreign = (F.col("_unknown") > 0) | (F.col("_least") != F.col("visitor_id")) | (F.col("_greatest") != F.col("visitor_id"))
    alone = F.col("visitor_id").isNotNull() & (F.col("_times") == 1) & ~F.coalesce(foreign, F.lit(False))
    wanted = asked.select("conversion_id", "event_at", alone.alias("_alone"), F.explode(F.when(alone, F.array(visitor)).otherwise(scopes)).alias("scope"))
    # a key's first touch stands for it
    seen = F.struct("first_at", "touch_key", "provider", "basis", "campaign", "ad")
    recent = F.col("first_at") >= F.col("event_at") - F.make_dt_interval(F.lit(days))

    def summed(met, by):
        keys = met.where(recent).groupBy(*by, "touch_key", "paid", "ambiguous").agg(F.min(F.when(F.col("paid"), seen)).alias("touch"), F.count("*").alias("rows"))
        return keys.groupBy(*by).agg(
            F.sum("rows").alias("_rows"), F.coalesce(F.sum(F.when(F.col("ambiguous"), F.col("rows"))), F.lit(0)).alias("ambiguous_touches"), F.count_if("paid").alias("_paid"),
            F.array_sort(F.collect_set(F.when(F.col("paid"), F.col("touch.provider")))).alias("_providers"), F.max("touch").alias("_last"),
        ).drop("scope")

    # rows of one scope stay where they met, so a scope's pairs are summed without being moved
    single = summed(wanted.where("_alone").join(known, "scope").where("first_at <= event_at"), ["scope", "conversion_id"])
    twice = wanted.where("not _alone").join(known, "scope").where("first_at <= event_at").groupBy("conversion_id", "event_at", *SIGNATURE, "ambiguous", "paid", "provider", "basis", "touch_key", "campaign", "ad").agg(F.min("first_at").alias("first_at"))
    sums = single.unionByName(summed(twice, ["conversion_id"]))
    out = conversions.select("conversion_id").join(sums, "conversion_id", "left").fillna(0, ["_rows", "ambiguous_touches", "_paid"])
    over, unsure = F.col("_rows") > most, F.col("ambiguous_touches") > 0
    sure = ~over & ~unsure
    reason = F.when(over, "EVIDENCE_LIMIT_REACHED").when(unsure, "AMBIGUOUS_TOUCH").when(F.col("_paid") > 0, "PAID_TOUCH_FOUND").otherwise("NO_PAID_TOUCH")
    last = lambda n: F.when(sure, F.col(f"_last.{n}"))
    return out.select(
        "conversion_id", F.array_join(F.when(sure, F.coalesce("_providers", F.array())).otherwise(F.array()), ",").alias("eligible_providers"), F.when(over, 0).otherwise(F.col("_paid")).alias("paid_touches"), "ambiguous_touches", reason.alias("reason"),
        last("provider").alias("last_provider"), last("first_at").alias("last_touch_at"), last("basis").alias("last_basis"), last("campaign").alias("last_campaign"), last("ad").alias("last_ad"),
    )


def _filled(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v != "", v)


def iso_countries() -> list[str]:
    """All two-letter country codes in lower case, as the JVM lists them."""
    return [c.lower() for c in SparkSession.active()._jvm.java.util.Locale.getISOCountries()]


def normalized_email(c: Column, google: bool = False) -> Column:
    """Trimmed and lower-cased if it is an address; for Google, Gmail's dots and what follows a plus are dropped."""
    v = F.regexp_replace(_filled(c), r"\s", "") if google else _filled(c)
    v = F.when(v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), v)
    if not google:
        return v
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    return F.when(domain.isin("gmail.com", "googlemail.com"), F.concat(F.regexp_replace(F.substring_index(local, "+", 1), r"\.", ""), F.lit("@"), domain)).otherwise(v)


def normalized_phone(c: Column) -> Column:
    """Only international numbers; a national number's country isn't guessed."""
    v = F.regexp_replace(F.trim(c), r"[\s().-]", "")
    return F.when(v.rlike(r"^\+[1-9]\d{6,14}$"), v)


#: Hashes of one kind that a provider takes.  Fixed value.
MOST_HASHES = 10


def _hashes(values: Column, normalize) -> Column:
    """The distinct hashes of an array's values that are well-formed, the first ten in order."""
    return F.slice(F.array_distinct(F.transform(F.filter(F.transform(values, normalize), lambda x: x.isNotNull()), lambda x: F.sha2(x, 256))), 1, MOST_HASHES)


def hmac_sha256(secret: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA-256 of a text, from two hashes over padded keys; the secret is a constant of the plan."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def customer_identity(secret: str, store_id: Column, customer_id: Column, version: str = "customer-v1") -> Column:
    """A customer's keyed identity within a store; without the secret it can't be made from the ids."""
    return hmac_sha256(secret, F.to_json(F.array(F.lit(version), store_id.cast("string"), customer_id.cast("string"))))


def customer_match(
    *, emails: Column, phones: Column, first_name: Column, last_name: Column, city: Column, region: Column, postal_code: Column, country: Column, external_id: Column, countries: list[str] | None = None
) -> dict[str, Column]:
    """Hashes by which providers may know a customer, and flags of what is there.

    emails and phones are arrays of which all well-formed values count, each once.
    countries: the codes that are known, all of ISO 3166 by default.  The address takes both names, a country and a postal code.
    """
    sha = lambda c: F.sha2(c, 256)
    filled = lambda c: F.when(c != "", c)
    name = lambda c: filled(F.regexp_replace(_filled(c), r"[\p{P}\p{S}\p{N}]", ""))
    compact = lambda c: filled(F.regexp_replace(_filled(c), r"[\s\p{P}\p{S}]", ""))
    land = F.when(_filled(country).isin(iso_countries() if countries is None else list(countries)), _filled(country))
    postal = filled(F.substring_index(F.regexp_replace(_filled(postal_code), r"\s", ""), "-", 1))
    given, family, raw_postal = name(first_name), name(last_name), filled(F.trim(postal_code))
    external = filled(external_id)
    ph = _hashes(phones, lambda p: F.substring(normalized_phone(p), 2, 20))
    google_phones, google_emails = _hashes(phones, normalized_phone), _hashes(emails, lambda e: normalized_email(e, True))
    em = _hashes(emails, lambda e: normalized_email(e))
    address = F.when(given.isNotNull() & family.isNotNull() & land.isNotNull() & raw_postal.isNotNull(), F.concat_ws("|", sha(given), sha(family), F.upper(land), raw_postal))
    return {
        "em": em, "ph": ph, "fn": sha(given), "ln": sha(family), "ct": sha(compact(city)), "st": sha(compact(region)), "zp": sha(postal), "country": sha(land), "external_id": sha(external),
        "tiktok_email": F.get(em, 0), "tiktok_phone": F.get(google_phones, 0),
        "google_identifiers": F.slice(F.concat(google_emails, google_phones, F.when(address.isNotNull(), F.array(address)).otherwise(F.array())), 1, MOST_HASHES),
        "has_email": F.size(em) > 0, "has_phone": F.size(ph) > 0,
    }


#: Events that a browser may report itself.  Fixed values.
BROWSER_EVENTS = ("PAGE_VIEW", "PRODUCT_VIEW", "ADD_TO_CART")


def permitted_browser_pairs(requests: DataFrame, events: DataFrame, destinations: DataFrame, stores: DataFrame, withdrawals: DataFrame, routes: DataFrame, *, overlap_policy: str = "EXCLUSIVE") -> DataFrame:
    """(request_id, event_id, destination_id): which events of a request's store its browser may send where, as things stand at the request.

    An event counts from 60 seconds before the request to 5 after it (browser
    clocks lead a little), and must have arrived in the 60 seconds before it.  It must
    be unexpired, shared, since the store's connection, not withdrawn for its session or visitor at or after the earlier of
    its time and its arrival, and the newest event of its session and visitor must be shared
    too.  The store must be connected with the scope to read events and an active installation; its destination must be an
    active one for browser and funnel events, live, alone responsible, and authorized.  The event's paid touches must lead to the destination's provider.

    requests: (request_id, store_id, requested_at); events: (event_id, store_id, event_name, event_at, received_at, session_id,
    visitor_id, shared, consent_state, retention_expires_at); destinations: (destination_id, store_id, provider, status, browser_events,
    funnel_events, overlap_policy, delivery_mode, auth_source, ad_account_id); stores: (store_id, status, installed_at, scopes, installation_status,
    ads_status, ads_scopes, ads_accounts, token_expires_at), ads columns null without an ads connection; withdrawals: (store_id, scope_key, revoked_before); routes: (event_id, provider) that are eligible.
    """
    named = F.array_compact(F.array(F.concat(F.lit("session:"), F.col("session_id").cast("string")), F.concat(F.lit("visitor:"), F.col("visitor_id").cast("string"))))
    # the newest event of each scope says whether it is shared, whatever the event asked about
    newest = F.max(F.struct("event_at", "received_at", "event_id", "shared")).alias("_newest")
    latest = events.select("store_id", "event_at", "received_at", "event_id", "shared", F.explode(named).alias("scope_key")).groupBy("store_id", "scope_key").agg(newest)
    revoked = withdrawals.groupBy("store_id", "scope_key").agg(F.max("revoked_before").alias("_revoked"))
    open_ = events.where(F.col("event_name").isin(*BROWSER_EVENTS) & F.col("shared") & F.col("consent_state").isin("GRANTED", "NOT_REQUIRED")).select("event_id", "store_id", "event_at", "received_at", "session_id", "visitor_id", "retention_expires_at")
    near = band_join(requests.select("request_id", "store_id", "requested_at"), open_, on=["store_id"], at="requested_at", when="event_at", before=60, after=5)
    near = near.where((F.col("received_at") >= F.col("requested_at") - F.expr("interval 60 seconds")) & (F.col("received_at") <= F.col("requested_at")) & (F.col("retention_expires_at") > F.col("requested_at")))
    # what a band holds is little beside the events, so scopes are looked up only now
    scoped = near.select("event_id", "store_id", "event_at", "received_at", "session_id", "visitor_id").distinct().select("*", F.explode(named).alias("scope_key"))
    said = scoped.join(revoked, ["store_id", "scope_key"], "left").join(latest, ["store_id", "scope_key"], "left")
    stands = said.groupBy("event_id").agg(F.bool_or(F.coalesce(F.col("_revoked") >= F.least("event_at", "received_at"), F.lit(False))).alias("_gone"), F.max("_newest").alias("_n")).where("not _gone and _n.shared").select("event_id")
    ok = near.join(stands, "event_id", "left_semi").join(stores.where("status = 'ACTIVE' and installation_status = 'ACTIVE' and array_contains(scopes, 'read_customer_events') and (ads_status is null or ads_status = 'ACTIVE')"), "store_id")
    ok = ok.where((F.col("event_at") >= F.col("installed_at")) & (F.col("received_at") >= F.col("installed_at"))).select("request_id", "requested_at", "event_id", "store_id", "ads_status", "ads_scopes", "ads_accounts", "token_expires_at")
    live = destinations.where((F.col("status") == "ACTIVE") & (F.col("provider") == "META") & F.col("browser_events") & F.col("funnel_events") & (F.col("overlap_policy") == overlap_policy) & (F.coalesce("delivery_mode", F.lit("LIVE")) == "LIVE"))
    met = ok.join(live.select("destination_id", "store_id", "provider", "auth_source", "ad_account_id"), "store_id")
    token = F.col("token_expires_at").isNull() | (F.col("token_expires_at") > F.col("requested_at"))
    authorized = F.col("ads_status").isNotNull() & F.array_contains("ads_scopes", "ads_management") & token & F.array_contains("ads_accounts", F.col("ad_account_id"))
    met = met.where(~F.coalesce(F.col("auth_source") == "META_CONNECTION", F.lit(False)) | F.coalesce(authorized, F.lit(False)))
    return met.join(routes.select("event_id", "provider").distinct(), ["event_id", "provider"], "left_semi").select("request_id", "event_id", "destination_id")


def eligibility(*, source: Column, is_test: Column, is_b2b: Column, cancelled: Column, linked: Column, has_facts: Column, before_install: Column, value: Column) -> Column:
    """Why a purchase may not be sent, the first reason that holds; null if it may."""
    return (
        F.when(is_test, "TEST_ORDER").when(cancelled, "ORDER_CANCELLED").when(~F.coalesce(F.lower(source) == "web", F.lit(False)), "ORDER_SOURCE_EXCLUDED").when(is_b2b, "B2B_ORDER_EXCLUDED")
        .when(~linked, "CHECKOUT_LINK_UNAVAILABLE").when(~has_facts, "PURCHASE_FACTS_UNAVAILABLE").when(before_install, "ORDER_BEFORE_INSTALLATION").when(value <= 0, "ZERO_VALUE_ORDER")
    )


def enqueued(orders: DataFrame, deliveries: DataFrame, providers: list[str]) -> DataFrame:
    """By provider: orders that have no delivery yet, which are to be queued."""
    done = deliveries.select(F.col("source_event_id").alias("event_id"), "provider").distinct()
    return _grid(orders.select("event_id"), tuple(providers)).join(done, ["event_id", "provider"], "left_anti").groupBy("provider").agg(F.count("*").alias("new_deliveries"))


def after_key(df: DataFrame, columns: list[str], values: list[Column]) -> DataFrame:
    """Rows after a key of several columns, compared from the first on."""
    return df.where(F.struct(*columns) > F.struct(*[v.alias(c) for c, v in zip(columns, values)]))


def swept(df: DataFrame, columns: list[str], values: list[Column], limit: int) -> DataFrame:
    """The next rows after a key in order; from the start again if none is left.

    Both are looked for in one lazy plan; the first rows of all count only without any after the key.
    """
    after = after_key(df, columns, values).orderBy(*columns).limit(limit).withColumn("_from", F.lit(0))
    both = after.unionAll(df.orderBy(*columns).limit(limit).withColumn("_from", F.lit(1)))
    w = Window.partitionBy()  # at most twice the limit
    return both.withColumn("_least", F.min("_from").over(w)).where("_from = _least").drop("_from", "_least")


def still_shared(events: DataFrame, keys: list[str]) -> DataFrame:
    """Shared events without a later arrival, of the same value of any of the keys, by which sharing was withdrawn."""
    kept = events.where("shared")
    for key in keys:
        last = events.where(f"not shared and {key} is not null").groupBy(key).agg(F.max("received_at").alias("_withdrawn"))
        kept = kept.join(last, key, "left").where("_withdrawn is null or _withdrawn <= received_at").drop("_withdrawn")
    return kept


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each connection's newest run that succeeded."""
    best = F.max_by(F.struct("run_id", "created_at"), F.struct("created_at", "run_id"))
    return runs.where("status = 'SUCCEEDED'").groupBy("connection_id").agg(best.alias("_r")).select("connection_id", "_r.run_id", "_r.created_at")


def within_connection(events: DataFrame, connections: DataFrame) -> DataFrame:
    """Events since their store's connection was made.  connections: (store_id, installed_at)."""
    return events.join(connections, "store_id").where("installed_at <= event_at").drop("installed_at")


def contents(items: DataFrame, mapped: DataFrame) -> DataFrame:
    """What a conversion held: its items' quantities and value, and how many are mapped to one or to several catalog items.

    items: (source_event_id, variant_id, quantity, price); mapped: (variant_id, catalog_item_id).
    """
    known = mapped.groupBy("variant_id").agg(F.count_distinct("catalog_item_id").alias("_n"))
    each = items.join(known, "variant_id", "left")
    return each.groupBy("source_event_id").agg(F.count("*").alias("observed_items"), F.count_if(F.col("_n") == 1).alias("mapped_items"), F.count_if(F.col("_n") > 1).alias("ambiguous_items"), F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("value"))


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a column replaced by that of their change; rows without one keep theirs."""
    return rows.join(changes.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def retry_after_ms(value: Column, now: Column) -> Column:
    """How long a provider asks to wait: seconds, or a date after ``now``; 7 days at most, null for anything else."""
    v = F.trim(value)
    seconds = F.when(v.rlike(r"^\d+(?:\.\d+)?$"), v.try_cast("double") * 1000)
    date = F.coalesce(F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")), v.try_cast("timestamp"))
    ms = F.coalesce(seconds, F.when(~v.rlike(r"^[\d.]+$"), F.unix_millis(date) - F.unix_millis(now.cast("timestamp"))).cast("double"))
    return F.when(ms >= 0, F.least(ms, F.lit(7 * 86400_000.0))).cast("long")


def retry_at(failed_at: Column, attempts: Column, random: Column | None = None, retry_after: Column | None = None) -> Column:
    """60 seconds after the first attempt, doubled up to 8 times, 6 hours at most, times a jitter of a half to 1; not before ``retry_after`` milliseconds.

    random: from 0 to 1, drawn by default.
    """
    base = F.least(F.lit(60_000.0) * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(8))), F.lit(6 * 3600_000.0))
    jitter = (F.rand() if random is None else random) * 0.5 + 0.5
    wait = F.greatest(F.floor(base * jitter), F.lit(0) if retry_after is None else F.coalesce(retry_after, F.lit(0)))
    return failed_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (wait / 1000).cast("decimal(18,6)"))


def delivery_deadline(event_at: Column, days: int = 7) -> Column:
    """Until when a provider takes an event: its age limit less 5 minutes."""
    return event_at + F.make_dt_interval(F.lit(days)) - F.expr("interval 5 minutes")


def forgotten(rows: DataFrame, customers: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of customers who asked for it with their personal columns emptied.  customers: (customer_id)."""
    asked = customers.select("customer_id").distinct().withColumn("_f", F.lit(True))
    return rows.join(asked, "customer_id", "left").withColumns({c: F.when(F.col("_f").isNull(), F.col(c)) for c in columns}).drop("_f")


def latest_consent(events: DataFrame) -> DataFrame:
    """Each visitor's newest consent by arrival."""
    w = Window.partitionBy("visitor_id").orderBy(F.desc("received_at"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("visitor_id", "consent_state", "received_at")
