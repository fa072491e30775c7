"""Urls, acquisition and landing pages of storefront events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand as a handle in a durable path.
_HANDLE = r"^[a-zA-Z0-9][a-zA-Z0-9_-]{0,127}$"
#: Query parameters of attribution by their kind: numeric ids, click ids, free values.  Fixed values.
ID_KEYS = ("utm_id", "campaign_id", "adset_id", "ad_id")
CLICK_KEYS = {"fbclid": "META", "ttclid": "TIKTOK", "gclid": "GOOGLE", "gbraid": "GOOGLE", "wbraid": "GOOGLE"}
UTM_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)


def origin(url: Column) -> Column:
    """Scheme and host of an http(s) url, lower-cased, without user info and default port; null for all others."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    authority = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1), r"^.*@", ""))
    host = F.regexp_replace(authority, F.when(scheme == "https", r":443$").otherwise(r":80$"), F.lit(""))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host))


def sanitize_url(url: Column) -> Column:
    """http(s) urls without user info, query and fragment; what follows checkout, account and order paths is cut off."""
    path = _path(url)
    private = F.lower(F.regexp_extract(path, r"(?i)^/(?:\d+/)?(checkouts?|account|orders)(?:/|$)", 1))
    kept = F.when(private != "", F.concat(F.lit("/"), private)).when(path.rlike(r"(?i)^/cart/c(?:/|$)"), "/cart").when(path == "", "/").otherwise(path)
    return F.concat(origin(url), kept)


def query_value(url: Column, key: str) -> Column:
    """A query parameter's first value, decoded and trimmed; null if it is missing or empty."""
    raw = F.regexp_extract(url, rf"^[^#]*?[?&]{key}=([^&#]*)", 1)
    found = F.trim(F.try_url_decode(raw))
    return F.when(found != "", found)


def attribution_value(url: Column, key: str) -> Column:
    """A parameter that may be kept: ids are digits, click ids have no other signs; e-mails, urls and control characters are dropped."""
    v = query_value(url, key)
    if key in ID_KEYS:
        return F.when((F.length(v) <= 128) & v.rlike(r"^\d+$"), v)
    v = F.substring(v, 1, 512 if key in CLICK_KEYS else 255)
    clean = ~v.contains("@") & ~v.rlike(r"(?i)https?://") & ~v.rlike(r"[\x00-\x1f]")
    return F.when(clean & v.rlike(r"^[A-Za-z0-9._~-]+$") if key in CLICK_KEYS else clean, v)


def attribution_parameters(url: Column) -> Column:
    """A map of all parameters that may be kept; http(s) urls only."""
    every = [*UTM_KEYS, *CLICK_KEYS, *ID_KEYS]
    pairs = F.array_compact(F.array(*[F.when(attribution_value(url, k).isNotNull(), F.struct(F.lit(k).alias("k"), attribution_value(url, k).alias("v"))) for k in every]))
    return F.when(origin(url).isNotNull(), F.map_from_entries(pairs))


def landing_page(url: Column) -> Column:
    """The durable shape of a page: its origin with the entity it shows, a known route, or ``/:other``; null for no http(s) url."""
    parts = F.filter(F.split(_path(url), "/"), lambda x: x != "")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    safe = lambda k: F.coalesce(at(k).rlike(_HANDLE), F.lit(False))
    path = (
        F.when(F.size(parts) == 0, "/")
        .when(at(1).isin("products", "collections", "pages") & safe(2), F.concat(F.lit("/"), at(1), F.lit("/"), at(2)))
        .when((at(1) == "blogs") & safe(2) & safe(3), F.concat(F.lit("/blogs/"), at(2), F.lit("/"), at(3)))
        .when((at(1) == "blogs") & safe(2), F.concat(F.lit("/blogs/"), at(2)))
        .when(at(1).isin("search", "cart"), F.concat(F.lit("/"), at(1)))
        .otherwise("/:other")
    )
    return F.concat(origin(url), path)


def host(url: Column) -> Column:
    """The lower-cased host without a leading ``www.``; null without one."""
    found = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^(?i)www\.", ""))
    return F.when(found != "", found)


def numeric_tail(c: Column) -> Column:
    """The digits at the end; null without any."""
    digits = F.regexp_extract(c, r"(\d+)$", 1)
    return F.when(digits != "", digits)


def normalized_text(c: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces.  Compatibility forms are left as they are."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def journey_source(meta: Column, google: Column, tiktok: Column, utm_source: Column, referrer_host: Column, landing: Column) -> Column:
    """Click ids before utm before referrer before direct."""
    return F.when(meta.isNotNull(), "META").when(google.isNotNull(), "GOOGLE").when(tiktok.isNotNull(), "TIKTOK").when(utm_source.isNotNull(), F.concat(F.lit("UTM:"), F.lower(utm_source))).when(referrer_host.isNotNull(), F.concat(F.lit("REFERRER:"), referrer_host)).when(landing.isNotNull(), "DIRECT").otherwise("UNKNOWN")


#: What utm_source may call a provider.  Fixed values.
SOURCE_ALIASES = {
    "facebook": "META",
    "fb": "META",
    "meta": "META",
    "instagram": "INSTAGRAM",
    "ig": "INSTAGRAM",
    "tiktok": "TIKTOK",
    "tik_tok": "TIKTOK",
    "google": "GOOGLE",
    "bing": "BING",
    "youtube": "YOUTUBE",
    "pinterest": "PINTEREST",
    "klaviyo": "KLAVIYO",
    "mailchimp": "MAILCHIMP",
}
#: Domains of social networks.  Fixed values.
SOCIAL_DOMAINS = {"instagram.com": "INSTAGRAM", "facebook.com": "META", "tiktok.com": "TIKTOK", "youtube.com": "YOUTUBE", "pinterest.com": "PINTEREST"}
_GOOGLE_SEARCH = r"^(?:(?:www|images|news|maps|encrypted)\.)?google\.(?:com|[a-z]{2}|co\.[a-z]{2}|com\.[a-z]{2})$"


def _found(channel, provider, basis: str, paid: bool | None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(channel).alias("channel"), lit(provider).cast("string").alias("provider"), F.lit(basis).alias("basis"), F.lit(paid).cast("boolean").alias("paid"))


def _of_referrer(h: Column) -> Column:
    """Channel and provider of a referring host."""
    out = F.when(h == "mail.google.com", _found("EMAIL", "GOOGLE", "REFERRER", False)).when(h.isin("docs.google.com", "drive.google.com", "accounts.google.com"), _found("REFERRAL", "GOOGLE", "REFERRER", None))
    out = out.when(h.rlike(_GOOGLE_SEARCH), _found("ORGANIC_SEARCH", "GOOGLE", "REFERRER", False)).when((h == "bing.com") | h.endswith(".bing.com"), _found("ORGANIC_SEARCH", "BING", "REFERRER", False))
    for domain, provider in SOCIAL_DOMAINS.items():
        out = out.when((h == domain) | h.endswith(f".{domain}"), _found("ORGANIC_SOCIAL", provider, "REFERRER", False))
    return out.otherwise(_found("REFERRAL", "OTHER", "REFERRER", None))


def acquisition(*, meta_click: Column, tiktok_click: Column, google_click: Column, tiktok_link: Column, meta_link: Column, utm_source: Column, utm_medium: Column, utm_campaign: Column, referrer: Column, page: Column) -> Column:
    """How a visit came about, as struct(channel, provider, basis, paid): the surest evidence decides.

    Clicks, then ids in the link, then utm parameters, then a referrer from elsewhere.
    A Google click alone doesn't tell search from other channels.
    """
    plain_host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source, medium = F.lower(F.trim(utm_source)), F.lower(F.trim(utm_medium))
    named = F.create_map(*[F.lit(x) for pair in SOURCE_ALIASES.items() for x in pair])
    provider = F.coalesce(F.try_element_at(named, source), F.lit("OTHER"))
    search, social = provider.isin("GOOGLE", "BING"), provider.isin("META", "INSTAGRAM", "TIKTOK", "PINTEREST")
    is_in = lambda *x: F.coalesce(medium.isin(*x), F.lit(False))
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    utm = (
        F.when(is_in("email", "e-mail", "newsletter"), _found("EMAIL", provider, "UTM", False))
        .when(is_in("affiliate", "affiliates", "partner"), _found("AFFILIATE", provider, "UTM", None))
        .when(is_in("paid") & (provider == "TIKTOK") | is_in("paid_social", "paidsocial", "social_paid"), _found("PAID_SOCIAL", provider, "UTM", True))
        .when(is_in("paid_search", "sem", "ppc"), _found("PAID_SEARCH", provider, "UTM", True))
        .when(is_in("cpc"), _found(F.when(social, "PAID_SOCIAL").otherwise("OTHER"), provider, "UTM", True))
        .when(is_in("organic"), _found(F.when(search, "ORGANIC_SEARCH").when(social | (provider == "YOUTUBE"), "ORGANIC_SOCIAL").otherwise("OTHER"), provider, "UTM", False))
        .when(is_in("social", "social-network", "social_media"), _found("ORGANIC_SOCIAL", provider, "UTM", False))
        .when(is_in("referral"), _found("REFERRAL", provider, "UTM", None))
        .otherwise(_found("OTHER", provider, "UTM", None))
    )
    return (
        F.when(filled(meta_click), _found("PAID_SOCIAL", "META", "META_CLICK", True))
        .when(filled(tiktok_click), _found("PAID_SOCIAL", "TIKTOK", "TIKTOK_CLICK", True))
        .when(filled(google_click), _found(F.when(is_in("paid_search", "search", "sem", "ppc"), "PAID_SEARCH").otherwise("OTHER"), "GOOGLE", "GOOGLE_CLICK", True))
        .when(filled(tiktok_link), _found("PAID_SOCIAL", "TIKTOK", "TIKTOK_LINK_ID", True))
        .when(filled(meta_link), _found("PAID_SOCIAL", "META", "META_LINK_ID", True))
        .when(filled(source) | filled(medium) | filled(utm_campaign), utm)
        .when(filled(plain_host(referrer)) & F.coalesce(plain_host(referrer) != plain_host(page), F.lit(True)), _of_referrer(plain_host(referrer)))
        .when(filled(page), _found("DIRECT", None, "NO_EXTERNAL_EVIDENCE", None))
        .otherwise(_found("UNKNOWN", None, "NO_EVIDENCE", None))
    )
