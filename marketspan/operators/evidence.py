"""Evidence for rules: a row per entity with this period's values (``x``) and the comparison's (``x0``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from .advertising import entity_evidence

PAID = ["spend", "impressions", "clicks", "conversions", "conversion_value", "roas", "cpa", "ctr", "cpm", "frequency"]


def paid_evidence(facts: DataFrame, entity: str) -> DataFrame:
    """An advertising entity's metrics in both periods by currency, and its share of the currency's current spend.

    A period without facts has 0 spend and impressions, and no ratios.
    """
    by_period = entity_evidence(facts.where(F.col(entity).isNotNull()), entity)
    pick = lambda m, p: F.max(F.when(F.col("period") == p, F.col(m)))
    both = by_period.groupBy("currency", F.col(entity).alias("entity_id")).agg(*[pick(m, p).alias(m + z) for m in PAID for p, z in (("CURRENT", ""), ("COMPARISON", "0"))], pick("spend_share", "CURRENT").alias("spend_share"))
    return both.fillna(0, [m + z for m in ("spend", "impressions", "clicks") for z in ("", "0")] + ["spend_share"])


def product_evidence(product_ads: DataFrame, coverage: DataFrame, metrics: DataFrame, stock: DataFrame, *, days: int) -> DataFrame:
    """A product's sales, mapped spend and stock in the current period.

    product_ads: ``advertising.product_ads``; coverage: ``advertising.mapping_coverage``;
    stock: (product_id, available, tracked), whose numbers are trusted.  Velocity is what was sold and not restocked a day.
    """
    now = product_ads.where("period = 'CURRENT'")
    costs = metrics.where("period = 'CURRENT'").select("product_id", "sold_units", "cost_coverage", (F.col("relevant_units") / F.lit(float(days))).alias("velocity"))
    share = coverage.where("period = 'CURRENT'").select("mapping_coverage")
    out = now.join(costs, "product_id", "left").join(stock.select("product_id", F.col("available").alias("stock"), F.col("tracked").alias("inventory_trusted")), "product_id", "left").crossJoin(F.broadcast(share))  # one row
    return out.select(F.col("product_id").alias("entity_id"), F.coalesce("sold_units", F.lit(0)).alias("units"), "net_revenue", "revenue_share", F.col("exact_spend").alias("spend"), "impressions", "spend_share", "mapping_confidence", "mapping_coverage", F.coalesce("cost_coverage", F.lit(1.0)).alias("cost_coverage"), "roas", "contribution_after_ads", F.coalesce("inventory_trusted", F.lit(False)).alias("inventory_trusted"), "stock", "velocity")


def store_evidence(kpis: DataFrame, health: DataFrame) -> DataFrame:
    """A store's order health in both periods.  kpis: ``order_kpis``; health: ``commerce_health``."""
    known = (F.col("new_orders") + F.col("returning_orders")).alias("known_orders")
    by_period = kpis.select("period", "segment_coverage", "returning_share", known).join(health, "period")
    names = ["orders", "refund_rate", "discount_rate", "segment_coverage", "returning_share", "known_orders"]
    pick = lambda m, p: F.max(F.when(F.col("period") == p, F.col(m).cast("double")))
    return by_period.agg(*[pick(m, p).alias(m + z) for m in names for p, z in (("CURRENT", ""), ("COMPARISON", "0"))]).withColumn("entity_id", F.lit("store"))


def mapping_evidence(coverage: DataFrame) -> DataFrame:
    """How much of the current spend is mapped."""
    return coverage.where("period = 'CURRENT'").select(F.lit("store").alias("entity_id"), "spend", "mapping_coverage")


def attribution_evidence(provider: DataFrame, touched: DataFrame, quality: str = "READY") -> DataFrame:
    """What a provider reports beside what first-party journeys show; both are one row."""
    both = provider.crossJoin(F.broadcast(touched))
    return both.select(F.lit("store").alias("entity_id"), F.lit(quality).alias("quality"), F.coalesce(F.col("provider_purchases").cast("double"), F.lit(0.0)).alias("provider_purchases"), F.col("purchase_sessions").cast("double").alias("first_party_purchases"), F.col("touched_sessions").cast("double").alias("sessions"))


def paid_buckets(actions: DataFrame, insights: DataFrame) -> DataFrame:
    """Purchases and their value of each insight: one action type each, and spend times ROAS where no value is reported.

    actions: ``advertising.purchase_actions``, (insight_id, kind, value) of kinds ACTION, ACTION_VALUE and ROAS; insights: (insight_id, spend).
    """
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    chosen = actions.groupBy("insight_id").agg(pick("ACTION").alias("purchases"), pick("ACTION_VALUE").alias("_value"), pick("ROAS").alias("_roas"))
    out = insights.join(chosen, "insight_id", "left")
    value = F.when(F.col("_value") > 0, F.col("_value")).when(F.col("_roas") > 0, F.col("spend") * F.col("_roas"))
    return out.withColumn("purchase_value", value).drop("_value", "_roas").withColumn("cpa", safe_div(F.col("spend"), F.col("purchases")))
