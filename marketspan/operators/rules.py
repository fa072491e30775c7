"""Deterministic recommendations: a rule is a filter over evidence and a few expressions.

Evidence has a row per entity with current (``x``) and comparison (``x0``)
values.  A null anywhere in a condition keeps the rule silent.  The
expressions are plain SQL, so that another engine can evaluate them too.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp01


class Rule(NamedTuple):
    """Evidence family, what is named, condition, severity and the scores (clamped to 0..1 where they leave it)."""

    family: str
    category: str
    entity: str
    precision: str
    when: str
    severity: str
    impact: str
    confidence: str
    urgency: str
    quality: str


def rel(x: str) -> str:
    """Change relative to the comparison; null for a comparison of 0."""
    return f"(({x} - {x}0) / nullif(abs({x}0), 0))"


def _c01(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _high(when: str, high: str = "HIGH", other: str = "MEDIUM") -> str:
    return f"case when {when} then '{high}' else '{other}' end"


def _context(confidence: str) -> str:
    """Quality of evidence without limitations."""
    return f"case when {confidence} >= 0.82 then 'HIGH' when {confidence} >= 0.58 then 'MEDIUM' else 'LOW' end"


_PAID = "impressions >= 1000 and impressions0 >= 1000"
_BOTH_SPEND = f"{_PAID} and spend > 0 and spend0 > 0 and {rel('spend')} >= 0.15"
_SIZE = f"greatest(abs(coalesce({rel('roas')}, 0.0)), greatest(coalesce({rel('cpa')}, 0.0), 0.0))"
_TIRED = f"greatest(coalesce({rel('frequency')}, 0.0), abs(coalesce({rel('ctr')}, 0.0)), coalesce({rel('cpa')}, abs(coalesce({rel('roas')}, 0.0))))"
_SUPPORT = _c01("least(impressions, impressions0) / 10000.0")


def _worse(t: float) -> str:
    return f"(coalesce({rel('roas')} <= -{t}, false) or coalesce({rel('cpa')} >= {t}, false))"


def _efficiency(family: str, category: str, entity: str) -> Rule:
    confidence = _c01(f"0.62 + {_SUPPORT} * 0.25 + case when {rel('ctr')} is not null then 0.08 else 0.0 end")
    return Rule(family, category, entity, "META_PROVIDER", f"{_BOTH_SPEND} and {_worse(0.25)}", _high(f"{_SIZE} >= 0.4"), _c01("greatest(spend_share, 0.1)"), confidence, _c01(f"0.55 + {_SIZE} * 0.45"), f"case when {_SUPPORT} >= 0.5 then 'HIGH' else 'MEDIUM' end")


#: A product's confidence suffers from a low mapping coverage twice: by a factor, and by a limitation.
_COVERED = f"case when mapping_coverage >= 0.6 then 1.0 else 0.7 + 0.3 * {_c01('mapping_coverage / 0.6')} end"
_LIMITED = "case when mapping_coverage >= 0.6 then 1.0 when mapping_coverage < 0.3 then 0.75 else 0.88 end"


def _product(category: str, when: str, severity: str, impact: str, base: str, urgency: str) -> Rule:
    confidence = _c01(f"{_c01(f'({base}) * {_COVERED}')} * {_LIMITED}")
    quality = f"case when mapping_coverage >= 0.3 and {confidence} >= 0.82 then 'HIGH' when {confidence} >= 0.58 then 'MEDIUM' else 'LOW' end"
    return Rule("product", category, "PRODUCT", "EXACT_PRODUCT", when, severity, _c01(impact), confidence, _c01(urgency), quality)


def _reorder(lead_days: int) -> str:
    """The reorder point at the item's velocity, without a threshold of its own for low stock."""
    return f"ceil(velocity * {lead_days})"


_KNOWN_STOCK = "inventory_trusted and stock >= 0 and velocity > 0"


def _short(lead_days: int) -> str:
    return f"0.55 + greatest(0, {_reorder(lead_days)} - stock) / greatest(1.0, {_reorder(lead_days)}) * 0.45"


def _store(when: str, severity: str, impact: str, confidence: str, urgency: str, precision: str = "SHOPIFY_COMMERCE", category: str = "COMMERCE_HEALTH", quality: str | None = None) -> Rule:
    return Rule("store", category, "STORE", precision, when, severity, _c01(impact), _c01(confidence), _c01(urgency), quality or f"case when {confidence} >= 0.82 then 'HIGH' else 'MEDIUM' end")


def _behaviour(family: str, category: str, entity: str, when: str, severity: str, n: str, impact: str, urgency: str, n0: str | None = None) -> Rule:
    support = f"least({n}, {n0 or n + '0'})"
    confidence = f"case when {support} >= 250 then 0.9 when {support} >= 75 then 0.76 else 0.62 end"
    return Rule(family, category, entity, "FIRST_PARTY_OBSERVED", when, severity, _c01(impact), confidence, _c01(urgency), f"case when {support} >= 250 then 'HIGH' else 'MEDIUM' end")


def _points(x: str) -> str:
    return f"({x} - {x}0)"


_DRIVERS = f"least(2, case when {rel('ctr')} <= -0.15 then 1 else 0 end + case when {rel('cpm')} >= 0.15 then 1 else 0 end + case when {rel('cpa')} >= 0.2 then 1 else 0 end)"
_CAMPAIGN = _c01(f"0.55 + {_SUPPORT} * 0.25 + {_DRIVERS} * 0.1")
_FATIGUE = _c01(f"0.65 + {_c01('least(impressions, impressions0) / 15000.0')} * 0.25")
_GAP = "abs(provider_purchases - first_party_purchases) / greatest(provider_purchases, first_party_purchases, 1.0)"
_VIDEO = "greatest(abs(coalesce(hook - hook0, 0.0)), abs(coalesce(completion - completion0, 0.0)))"
_LOW_VALUE = "product_views >= 150 and purchase_rate <= 0.015"

#: All thresholds and weights are fixed values.
RULES: dict[str, Rule] = {
    "campaign_efficiency_deterioration": Rule("campaign", "CAMPAIGN_EFFICIENCY", "CAMPAIGN", "META_PROVIDER", f"{_BOTH_SPEND} and {_worse(0.2)}", _high(f"{_SIZE} >= 0.35"), _c01("greatest(spend_share, 0.15)"), _CAMPAIGN, _c01(f"0.5 + {_c01(_SIZE)} * 0.5"), _context(_CAMPAIGN)),
    "creative_fatigue_symptoms": Rule("creative", "CREATIVE_FATIGUE", "CREATIVE", "META_PROVIDER", f"{_PAID} and {rel('frequency')} >= 0.2 and {rel('ctr')} <= -0.2 and (coalesce({rel('cpa')} >= 0.15, false) or coalesce({rel('roas')} <= -0.2, false))", _high(f"{_TIRED} >= 0.4"), _c01("greatest(spend_share, 0.1)"), _FATIGUE, _c01(f"0.55 + {_c01(_TIRED)} * 0.45"), _context(_FATIGUE)),
    "video_retention_deterioration": Rule("creative_video", "VIDEO_RETENTION", "CREATIVE", "META_PROVIDER", "status = 'READY' and evidence_quality <> 'LOW' and comparison_valid and plays0 >= minimum_plays and (coalesce(hook - hook0 <= -0.1, false) or coalesce(completion - completion0 <= -0.1, false))", _high(f"{_VIDEO} >= 0.2"), "greatest(0.2, least(1.0, spend_share))", "case when evidence_quality = 'HIGH' then 0.9 else 0.78 end", f"least(1.0, 0.55 + {_VIDEO})", "evidence_quality"),
    "underexposed_commerce_winner": _product("UNDEREXPOSED_PRODUCT", "units >= 5 and mapping_confidence >= 0.7 and revenue_share >= 0.08 and spend_share < revenue_share * 0.6", _high("revenue_share - spend_share >= 0.2"), "greatest(revenue_share, 0.1)", "0.55 + mapping_confidence * 0.25 + least(mapping_coverage, 1.0) * 0.2", "(revenue_share - spend_share) * 3"),
    "paid_commerce_exposure_mismatch": _product("PAID_COMMERCE_MISMATCH", "(units >= 2 or impressions >= 1000) and mapping_confidence >= 0.7 and spend_share >= 0.08 and revenue_share <= spend_share * 0.55", _high("spend_share - revenue_share >= 0.2"), "greatest(spend_share, 0.1)", f"0.5 + mapping_confidence * 0.2 + least(mapping_coverage, 1.0) * 0.2 + {_c01('impressions / 10000.0')} * 0.1", "(spend_share - revenue_share) * 3"),
    "provider_roas_margin_trap": _product("MARGIN_TRAP", "cost_coverage >= 0.8 and roas >= 1.5 and contribution_after_ads <= 0", "'HIGH'", "greatest(spend_share, revenue_share)", "0.65 + cost_coverage * 0.25 + mapping_confidence * 0.1", "0.8"),
    "inventory_spend_conflict": _product("INVENTORY_SPEND_CONFLICT", f"{_KNOWN_STOCK} and spend > 0 and stock <= {_reorder(10)}", _high("stock <= 0 or stock <= velocity * 5", "CRITICAL", "HIGH"), "greatest(revenue_share, spend_share)", "0.8", _short(10)),
    "adset_efficiency_deterioration": _efficiency("adset", "ADSET_EFFICIENCY", "AD_SET"),
    "ad_efficiency_deterioration": _efficiency("ad", "AD_EFFICIENCY", "AD"),
    "refund_rate_deterioration": _store(f"orders >= 20 and orders0 >= 20 and refund_rate >= 0.05 and {_points('refund_rate')} >= 0.04 and coalesce({rel('refund_rate')} >= 0.4, true)", _high(f"{_points('refund_rate')} >= 0.08"), f"greatest(refund_rate, {_points('refund_rate')} * 2)", "least(0.92, 0.7 + least(orders, orders0) / 1000.0)", f"0.55 + {_points('refund_rate')}"),
    "discount_dependency_deterioration": _store(f"orders >= 20 and orders0 >= 20 and discount_rate >= 0.1 and {_points('discount_rate')} >= 0.05", _high(f"{_points('discount_rate')} >= 0.1"), f"greatest(discount_rate, {_points('discount_rate')} * 2)", "least(0.9, 0.68 + least(orders, orders0) / 1000.0)", f"0.45 + {_points('discount_rate')}"),
    "returning_customer_deterioration": _store(f"segment_coverage >= 0.8 and segment_coverage0 >= 0.8 and known_orders >= 20 and known_orders0 >= 20 and {_points('returning_share')} <= -0.1", _high(f"{_points('returning_share')} <= -0.2"), f"0.45 + least(0.35, abs{_points('returning_share')})", "least(0.9, 0.72 + least(known_orders, known_orders0) / 1000.0)", f"0.45 + least(0.35, abs{_points('returning_share')})"),
    "inventory_runway_risk": Rule("product", "INVENTORY_RISK", "PRODUCT", "SHOPIFY_COMMERCE", f"{_KNOWN_STOCK} and (units >= 3 or revenue_share >= 0.03) and coalesce(spend, 0) <= 0 and stock <= {_reorder(7)}", _high("stock <= 0 or stock <= velocity * 7", "CRITICAL", "HIGH"), _c01("greatest(0.25, revenue_share)"), "0.82", _c01(_short(7)), "'HIGH'"),
    "mapping_coverage_degraded": Rule("mapping", "MAPPING_HEALTH", "STORE", "STORE", "spend > 0 and mapping_coverage < 0.6", _high("mapping_coverage < 0.3"), _c01("1 - mapping_coverage"), "0.95", "case when mapping_coverage < 0.3 then 0.8 else 0.6 end", "'HIGH'"),
    "provider_first_party_purchase_gap": Rule("attribution", "ATTRIBUTION_HEALTH", "STORE", "STORE", f"quality = 'READY' and provider_purchases >= 20 and first_party_purchases >= 10 and sessions >= 100 and {_GAP} >= 0.3", _high(f"{_GAP} >= 0.5"), f"least(1.0, {_GAP})", "least(0.9, 0.72 + least(sessions / 5000.0, 1.0) * 0.18)", f"least(1.0, 0.45 + {_GAP} * 0.6)", "case when sessions >= 1000 then 'HIGH' else 'MEDIUM' end"),
    "cart_abandonment_deterioration": _behaviour("storefront", "STOREFRONT_FUNNEL", "STORE", f"cart_view_sessions >= 30 and cart_view_sessions0 >= 30 and cart_abandonment >= 0.45 and {_points('cart_abandonment')} >= 0.1", _high(f"{_points('cart_abandonment')} >= 0.18"), "cart_view_sessions", f"greatest(cart_abandonment, {_points('cart_abandonment')} * 2)", f"0.55 + {_points('cart_abandonment')}"),
    "checkout_abandonment_deterioration": _behaviour("storefront", "STOREFRONT_FUNNEL", "STORE", f"checkout_sessions >= 25 and checkout_sessions0 >= 25 and checkout_abandonment >= 0.3 and {_points('checkout_abandonment')} >= 0.08", _high(f"{_points('checkout_abandonment')} >= 0.15"), "checkout_sessions", f"greatest(checkout_abandonment, {_points('checkout_abandonment')} * 2)", f"0.6 + {_points('checkout_abandonment')}"),
    "view_to_cart_deterioration": _behaviour("storefront", "STOREFRONT_FUNNEL", "STORE", f"view_sessions >= 75 and view_sessions0 >= 75 and {_points('view_to_cart')} <= -0.04 and {rel('view_to_cart')} <= -0.25", _high(f"abs{_points('view_to_cart')} >= 0.08"), "view_sessions", f"0.45 + {_c01('abs' + rel('view_to_cart'))} * 0.35", f"0.5 + {_c01('abs' + rel('view_to_cart'))} * 0.3"),
    "storefront_conversion_deterioration": _behaviour("storefront", "STOREFRONT_FUNNEL", "STORE", f"sessions >= 150 and sessions0 >= 150 and {_points('conversion_rate')} <= -0.01 and {rel('conversion_rate')} <= -0.2", _high(f"abs{_points('conversion_rate')} >= 0.025"), "sessions", f"0.55 + {_c01('abs' + rel('conversion_rate'))} * 0.3", f"0.55 + {_c01('abs' + rel('conversion_rate'))} * 0.25"),
    "high_traffic_low_conversion_product": _behaviour("storefront_product", "PRODUCT_CONVERSION", "PRODUCT", _LOW_VALUE, _high("product_views >= 500 and purchase_rate <= 0.01"), "product_views", f"0.45 + {_c01('product_views / 1000.0')} * 0.4", f"0.55 + {_c01('(0.015 - purchase_rate) / 0.015')} * 0.25", "greatest(product_views, product_views0)"),
    "product_conversion_deterioration": _behaviour("storefront_product", "PRODUCT_CONVERSION", "PRODUCT", f"not coalesce({_LOW_VALUE}, false) and product_views >= 40 and product_views0 >= 40 and {_points('purchase_rate')} <= -0.015 and {rel('purchase_rate')} <= -0.3", _high(f"abs{_points('purchase_rate')} >= 0.04"), "product_views", f"0.45 + {_c01('product_views / 500.0')} * 0.35", f"0.5 + {_c01('abs' + rel('purchase_rate'))} * 0.3"),
    "landing_page_quality_deterioration": _behaviour("landing_page", "LANDING_PAGE_QUALITY", "LANDING_PAGE", f"sessions >= 75 and sessions0 >= 75 and {_points('conversion_rate')} <= -0.015 and {rel('conversion_rate')} <= -0.3", _high(f"abs{_points('conversion_rate')} >= 0.04"), "sessions", f"0.4 + {_c01('sessions / 1000.0')} * 0.4", f"0.45 + {_c01('abs' + rel('conversion_rate'))} * 0.35"),
}

#: Rule -> action; all others are to be investigated.  Fixed values.
ACTIONS = {
    "creative_fatigue_symptoms": "TEST",
    "video_retention_deterioration": "TEST",
    "underexposed_commerce_winner": "TEST",
    "provider_roas_margin_trap": "REDUCE",
    "inventory_spend_conflict": "HOLD",
    "shared_exposure_inventory_conflict": "HOLD",
    "inventory_runway_risk": "HOLD",
}
#: Rules whose action is to reduce spend at HIGH severity and to hold it otherwise.
BY_SEVERITY = ("campaign_efficiency_deterioration", "adset_efficiency_deterioration", "ad_efficiency_deterioration")

#: Impressions from which an entity's delivery says anything, and from which it says so with confidence.
SIGNAL_IMPRESSIONS, CONFIDENT_IMPRESSIONS = 100, 1000
_COMPARED = f"impressions >= {SIGNAL_IMPRESSIONS} and source_rows0 > 0 and impressions0 >= {SIGNAL_IMPRESSIONS} and "

#: Signal -> (condition, severity as an expression).  Thresholds are fixed values.
SIGNALS: dict[str, tuple[str, str]] = {
    "INSUFFICIENT_CURRENT_EVIDENCE": ("coalesce(source_rows, 0) = 0", "'WARNING'"),
    "LOW_DELIVERY_INSUFFICIENT_EVIDENCE": (f"source_rows > 0 and coalesce(impressions, 0) < {SIGNAL_IMPRESSIONS}", "'INFO'"),
    "NO_CONVERSION_SPEND": (f"impressions >= {SIGNAL_IMPRESSIONS} and spend > 0 and conversions = 0", "'WARNING'"),
    "SPEND_UP_EFFICIENCY_DOWN": (f"{_COMPARED} {rel('spend')} >= 0.15 and {rel('roas')} <= -0.15", f"if({rel('roas')} <= -0.3, 'HIGH', 'WARNING')"),
    "CPC_DETERIORATION": (f"{_COMPARED} {rel('cpc')} >= 0.2", f"if({rel('cpc')} >= 0.4, 'HIGH', 'WARNING')"),
    "CTR_DETERIORATION": (f"{_COMPARED} {rel('ctr')} <= -0.2", f"if({rel('ctr')} <= -0.4, 'HIGH', 'WARNING')"),
    "CONVERSIONS_DOWN_SPEND_UP": (f"{_COMPARED} {rel('spend')} > 0.1 and {rel('conversions')} < -0.1", "'HIGH'"),
    "STRONG_PROVIDER_EFFICIENCY": (f"{_COMPARED} least(impressions, impressions0) >= {CONFIDENT_IMPRESSIONS} and conversions >= 5 and roas >= roas0 * 1.15", "'INFO'"),
    "SUDDEN_DELIVERY_CHANGE": (f"{_COMPARED} abs({rel('spend')}) >= 0.5", "'WARNING'"),
}


def entity_signals(entities: DataFrame) -> DataFrame:
    """(entity_id, code, severity) of every signal that holds, in one pass over the entities.

    Entities have source_rows, impressions, spend, conversions, roas, cpc and ctr,
    and the comparison's under the same name with a 0.  No current facts, or few
    impressions, leave no other signal; a thin comparison leaves none that compares.
    """
    found = [F.when(F.expr(f"coalesce({when}, false)"), F.struct(F.lit(code).alias("code"), F.expr(severity).alias("severity"))) for code, (when, severity) in SIGNALS.items()]
    listed = entities.select("entity_id", F.explode(F.array_compact(F.array(*found))).alias("_s"))
    return listed.select("entity_id", "_s.code", "_s.severity")


def with_actions(drafts: DataFrame) -> DataFrame:
    """Drafts with what to do about them: REDUCE, HOLD, TEST or INVESTIGATE."""
    fixed = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    held = F.when(F.col("severity") == "HIGH", "REDUCE").otherwise("HOLD")
    return drafts.withColumn("action", F.when(F.col("rule_id").isin(*BY_SEVERITY), held).otherwise(F.coalesce(F.try_element_at(fixed, F.col("rule_id")), F.lit("INVESTIGATE"))))


def apply_rules(evidence: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, category, entity_type, entity_id, severity, impact, confidence, urgency, evidence_quality, precision) of all rules whose family is given.

    Every family is read once: its rules become an array of drafts per row.  Families need an entity_id.
    """
    drafts = []
    for family, rows in evidence.items():
        found = []
        for rule_id, r in RULES.items():
            if r.family == family:
                scores = [F.expr(e).cast("double").alias(n) for n, e in (("impact", r.impact), ("confidence", r.confidence), ("urgency", r.urgency))]
                draft = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.entity).alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), F.expr(r.severity).alias("severity"), *scores, F.expr(r.quality).alias("evidence_quality"), F.lit(r.precision).alias("precision"))
                found.append(F.when(F.expr(f"coalesce({r.when}, false)"), draft))
        if found:
            drafts.append(rows.select(F.explode(F.array_compact(F.array(*found))).alias("_d")).select("_d.*"))
    if not drafts:
        raise ValueError("no evidence is given")
    return reduce(DataFrame.unionAll, drafts)


def by_product(c: str = "") -> Column:
    """Priority of the snapshot: impact times confidence times urgency."""
    return F.col("impact") * F.col("confidence") * F.col("urgency")


def by_weights() -> Column:
    """Priority of unified decisions: a weighted sum."""
    return F.col("impact") * 0.45 + F.col("confidence") * 0.35 + F.col("urgency") * 0.2


def ranked(drafts: DataFrame, limit: int | None = None, priority: Column | None = None) -> DataFrame:
    """By priority, then rule and entity; a plan's limit keeps the first."""
    out = drafts.withColumn("priority", by_product() if priority is None else priority).orderBy(F.desc("priority"), "rule_id", "entity_id")
    return out if limit is None else out.limit(limit)


#: Severity of a unified decision made from a signal, and its scores; confidence by the entity's quality of evidence.  Fixed values.
SIGNAL_SEVERITY = {"HIGH": ("HIGH", 0.85), "WARNING": ("MEDIUM", 0.6), "INFO": ("LOW", 0.35)}
QUALITY_SCORE = {"HIGH": 0.9, "MEDIUM": 0.65, "LOW": 0.35}


def signal_drafts(signals: DataFrame, kind: str) -> DataFrame:
    """Unified decisions from an entity's signals; signals: (entity_id, code, severity, evidence_quality)."""
    severity = F.create_map(*[F.lit(x) for k, (s, _) in SIGNAL_SEVERITY.items() for x in (k, s)])[F.col("severity")]
    score = F.create_map(*[F.lit(x) for k, (_, n) in SIGNAL_SEVERITY.items() for x in (k, n)])[F.col("severity")]
    quality = F.create_map(*[F.lit(x) for pair in QUALITY_SCORE.items() for x in pair])[F.col("evidence_quality")]
    category = F.when(F.col("code").contains("DELIVERY"), "PAID_MEDIA_DELIVERY").otherwise("PAID_MEDIA_EFFICIENCY")
    return signals.select(F.concat(F.lit(f"unified_{kind.lower()}_"), F.lower("code")).alias("rule_id"), category.alias("category"), F.lit(kind).alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), severity.alias("severity"), score.alias("impact"), quality.alias("confidence"), score.alias("urgency"), "evidence_quality", F.lit("PROVIDER_REPORTED").alias("precision"))


_USABLE = "not mapping_ambiguous and (merchant_confirmed or mapping_confidence >= 0.7)"
#: Product decision -> (category, condition, severity, impact, urgency, precision).  Fixed values.
PRODUCT_DECISIONS: dict[str, tuple[str, str, str, str, str, str]] = {
    "unified_inventory_paid_spend_conflict": ("INVENTORY_SPEND_CONFLICT", f"{_USABLE} and spend > 0 and stock_state in ('SOLD_OUT', 'STOCKOUT_RISK', 'LOW_STOCK')", _high("stock_state = 'SOLD_OUT'", "CRITICAL", "HIGH"), "case when stock_state = 'SOLD_OUT' then 1.0 else 0.9 end", "case when stock_state = 'SOLD_OUT' then 1.0 else 0.9 end", "EXACT_PRODUCT"),
    "unified_inventory_overstock_weak_demand": ("INVENTORY_SPEND_CONFLICT", "commerce_known and stock_state = 'OVERSTOCK_WEAK_DEMAND'", "'MEDIUM'", "0.65", "0.5", "SHOPIFY_COMMERCE"),
    "unified_product_paid_demand_negative_contribution": ("PRODUCT_ADS_ECONOMICS", f"commerce_known and {_USABLE} and inefficient_paid_demand", "'HIGH'", "0.9", "0.8", "EXACT_PRODUCT"),
    "unified_profitable_product_low_paid_support": ("PRODUCT_ADS_ECONOMICS", f"commerce_known and {_USABLE} and spend = 0 and net_revenue > 0 and contribution_before_ads > 0 and stock_state = 'HEALTHY'", "'LOW'", "0.45", "0.3", "EXACT_PRODUCT"),
    "unified_paid_product_weak_view_to_cart": ("PRODUCT_CONVERSION", f"pixel_fresh and {_USABLE} and spend > 0 and product_views >= 20 and view_to_cart < 0.1", "'MEDIUM'", "0.65", "0.55", "FIRST_PARTY_OBSERVED"),
}


def product_drafts(products: DataFrame) -> DataFrame:
    """Unified decisions about products, from stock, mapped spend, economics and storefront views together."""
    quality = F.create_map(*[F.lit(x) for pair in QUALITY_SCORE.items() for x in pair])[F.col("evidence_quality")]
    found = [
        F.when(F.expr(f"coalesce({when}, false)"), F.struct(F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit("PRODUCT").alias("entity_type"), F.col("product_id").cast("string").alias("entity_id"), F.expr(severity).alias("severity"), F.expr(impact).cast("double").alias("impact"), quality.alias("confidence"), F.expr(urgency).cast("double").alias("urgency"), F.col("evidence_quality"), F.lit(precision).alias("precision")))
        for rule, (category, when, severity, impact, urgency, precision) in PRODUCT_DECISIONS.items()
    ]
    return products.select(F.explode(F.array_compact(F.array(*found))).alias("_d")).select("_d.*")


#: Data quality code -> (status, surface, condition over the store's state).  48 hours make a sync stale.  Fixed values.
DATA_QUALITY: dict[str, tuple[str, str, str]] = {
    "SHOPIFY_CONNECTION_BLOCKED": ("BLOCKED", "SHOPIFY_COMMERCE", "coalesce(commerce_status, '') <> 'ACTIVE'"),
    "SHOPIFY_HISTORY_LIMITED": ("WARNING", "SHOPIFY_COMMERCE", "commerce_status = 'ACTIVE' and not reads_all_orders"),
    "SHOPIFY_SYNC_STALE": ("WARNING", "SHOPIFY_COMMERCE", "commerce_status = 'ACTIVE' and commerce_age_hours > 48"),
    "META_CONNECTION_BLOCKED": ("BLOCKED", "META_ADVERTISING", "coalesce(ads_status, '') <> 'ACTIVE'"),
    "META_ACCOUNTS_NOT_SELECTED": ("BLOCKED", "META_ADVERTISING", "ads_status = 'ACTIVE' and selected_accounts = 0"),
    "META_INSIGHTS_MISSING": ("BLOCKED", "META_ADVERTISING", "ads_status = 'ACTIVE' and selected_accounts > 0 and ads_rows = 0"),
    "META_SYNC_STALE": ("WARNING", "META_ADVERTISING", "ads_status = 'ACTIVE' and ads_age_hours > 48"),
    "PIXEL_NOT_ACTIVE": ("WARNING", "STOREFRONT_BEHAVIOR", "coalesce(pixel_status, '') <> 'ACTIVE'"),
    "PIXEL_EVENTS_STALE": ("WARNING", "STOREFRONT_BEHAVIOR", "pixel_status = 'ACTIVE' and pixel_age_hours > 48"),
    "PIXEL_ROLLUP_ERROR": ("WARNING", "STOREFRONT_BEHAVIOR", "pixel_status = 'ACTIVE' and rollup_failed"),
    "PIXEL_BEHAVIOR_MISSING": ("WARNING", "STOREFRONT_BEHAVIOR", "pixel_status = 'ACTIVE' and not rollup_failed and (not rolled_up or storefront_rows = 0 or storefront_rows0 = 0)"),
    "PRODUCT_AD_MAPPING_LOW": ("WARNING", "CROSS_CHANNEL_PRODUCT_ADS", "spend > 0 and mapping_coverage < 0.6"),
    "META_CURRENCY_MISMATCH": ("WARNING", "CROSS_CHANNEL_PRODUCT_ADS", "excluded_spend > 0"),
    "PRODUCT_COST_COVERAGE_LOW": ("WARNING", "SHOPIFY_ECONOMICS", "units > 0 and cost_coverage < 0.8"),
    "INVENTORY_DATA_MISSING": ("BLOCKED", "SHOPIFY_INVENTORY", "inventory_mode = 'TRUSTED' and inventory_rows = 0"),
    "INVENTORY_DATA_UNRELIABLE": ("WARNING", "SHOPIFY_INVENTORY", "inventory_mode = 'UNRELIABLE'"),
}


def data_quality(state: DataFrame) -> DataFrame:
    """(code, status, surface) of what limits a store's evidence; CORE_DATA_HEALTHY if nothing does.  state has a row."""
    item = lambda code, status, surface: F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"), F.lit(surface).alias("surface"))
    found = F.array_compact(F.array(*[F.when(F.expr(f"coalesce({when}, false)"), item(code, status, surface)) for code, (status, surface, when) in DATA_QUALITY.items()]))
    healthy = F.array(item("CORE_DATA_HEALTHY", "HEALTHY", "CORE"))
    return state.select(F.explode(F.when(F.size(found) == 0, healthy).otherwise(found)).alias("_q")).select("_q.*")


_ALWAYS = ("META_CONNECTION_BLOCKED", "META_ACCOUNTS_NOT_SELECTED", "META_INSIGHTS_MISSING", "META_SYNC_STALE")
_COMMERCE = ("SHOPIFY_CONNECTION_BLOCKED", "SHOPIFY_HISTORY_LIMITED", "SHOPIFY_SYNC_STALE")
_MAPPED = ("PRODUCT_AD_MAPPING_LOW", "META_CURRENCY_MISMATCH")
_OBSERVED = ("PIXEL_NOT_ACTIVE", "PIXEL_BEHAVIOR_MISSING", "PIXEL_ROLLUP_ERROR", "PIXEL_EVENTS_STALE")


#: Limitations under which evidence is never of HIGH quality.
_SEVERE = ("META_ACCOUNTS_NOT_SELECTED", "META_CONNECTION_BLOCKED", "META_INSIGHTS_MISSING", "META_SYNC_STALE", "SHOPIFY_CONNECTION_BLOCKED", "PIXEL_BEHAVIOR_MISSING", "PIXEL_ROLLUP_ERROR")


def with_data_quality(drafts: DataFrame, quality: DataFrame) -> DataFrame:
    """Drafts with the limitations that apply to their kind of evidence; each takes 8 percent of the confidence.

    quality: ``data_quality``, a handful of rows, which become one array.
    """
    codes = quality.where("status <> 'HEALTHY'").agg(F.array_sort(F.collect_set("code")).alias("_codes"))
    precision = F.col("precision")
    applies = lambda c: c.isin(*_ALWAYS) | (c.isin(*_COMMERCE) & (precision != "META_PROVIDER")) | (c.isin(*_MAPPED) & (precision == "EXACT_PRODUCT")) | (c.isin(*_OBSERVED) & (precision == "FIRST_PARTY_OBSERVED"))
    out = drafts.crossJoin(F.broadcast(codes)).withColumn("limitations", F.filter("_codes", applies)).drop("_codes")
    n = F.size("limitations")
    lower = clamp01(F.col("confidence") * F.pow(F.lit(0.92), n))
    severe = F.exists("limitations", lambda c: c.isin(*_SEVERE))
    worse = F.when(~severe & (lower >= 0.82), "HIGH").when(lower >= 0.58, "MEDIUM").otherwise("LOW")
    return out.withColumn("evidence_quality", F.when(n == 0, F.col("evidence_quality")).otherwise(worse)).withColumn("confidence", F.when(n == 0, F.col("confidence")).otherwise(lower))


def with_occurrence(drafts: DataFrame, begins: str, ends: str, version: str = "2") -> DataFrame:
    """Adds occurrence_key, by which a recommendation keeps its state as long as its rule, entity and window stay the same."""
    return drafts.withColumn("occurrence_key", F.concat_ws(":", "rule_id", F.lit(version), "entity_type", F.coalesce("entity_id", "rule_id"), F.lit(begins), F.lit(ends)))


def with_lifecycle(drafts: DataFrame, states: DataFrame) -> DataFrame:
    """Drafts with the state that was set for their occurrence; NEW without one.  states: (occurrence_key, state)."""
    return drafts.join(states.select("occurrence_key", "state"), "occurrence_key", "left").fillna({"state": "NEW"})


def current_occurrences(states: DataFrame, drafts: DataFrame) -> DataFrame:
    """States whose recommendation still exists."""
    return states.join(drafts.select("occurrence_key"), "occurrence_key", "left_semi")
