"""Advertising facts: overviews, entities, daily series, mapping of spend to products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import distinct_sorted, safe_div, sum_if_complete, weighted_by


def metric_sums(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by key with fail-closed conversions, impression-weighted frequency and the ratios."""
    out = facts.groupBy(*keys).agg(F.sum("spend").cast("double").alias("spend"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), sum_if_complete(F.col("conversions")).alias("conversions"), sum_if_complete(F.col("conversion_value")).cast("double").alias("conversion_value"), weighted_by(F.col("frequency"), F.col("impressions")).alias("frequency"))
    return with_ratios(out)


def with_ratios(sums: DataFrame) -> DataFrame:
    c = F.col
    return sums.withColumn("roas", safe_div(c("conversion_value"), c("spend"))).withColumn("cpa", safe_div(c("spend"), c("conversions"))).withColumn("ctr", safe_div(c("clicks"), c("impressions"))).withColumn("cpc", safe_div(c("spend"), c("clicks"))).withColumn("cpm", safe_div(c("spend") * 1000, c("impressions")))


def overview(facts: DataFrame) -> DataFrame:
    """By period and currency, with the providers that have facts."""
    providers = facts.groupBy("period", "currency").agg(F.array_join(distinct_sorted(F.col("provider")), ",").alias("providers"))
    return metric_sums(facts, ["period", "currency"]).join(providers, ["period", "currency"])


def level_policy(facts: DataFrame) -> DataFrame:
    """Account facts for Google, ad facts for all others: levels of one hierarchy are never summed together."""
    return facts.where(F.when(F.col("provider") == "GOOGLE", F.col("level") == "ACCOUNT").otherwise(F.col("level") == "AD"))


def unified_accounts(facts: DataFrame) -> DataFrame:
    """By period, provider and account; one account without conversions hides those of its provider and currency."""
    sums = metric_sums(level_policy(facts), ["period", "provider", "currency", "account_id"]).drop("roas", "cpa", "ctr", "cpc", "cpm", "frequency")
    whole = F.min(F.col("conversions").isNotNull()).over(Window.partitionBy("period", "provider", "currency"))
    return sums.withColumn("complete", whole).withColumn("conversions", F.when(F.col("complete"), F.col("conversions"))).withColumn("conversion_value", F.when(F.col("complete"), F.col("conversion_value")))


def daily_series(facts: DataFrame) -> DataFrame:
    """By day and currency, over the level that each provider is read at; currencies are never added.

    A point's purchases and their value are null if any fact of the day lacks them.
    """
    sums = level_policy(facts).groupBy(F.col("date").alias("day"), F.coalesce("currency", F.lit("UNKNOWN")).alias("currency"))
    return sums.agg(F.sum("spend").cast("double").alias("spend"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), sum_if_complete(F.col("conversions")).alias("purchases"), sum_if_complete(F.col("conversion_value")).cast("double").alias("purchase_value"))


def monitor_summary(facts: DataFrame, provider: str = "TIKTOK", keys: list[str] | None = None) -> DataFrame:
    """The monitor's rules, over one provider's ad facts: missing conversions count 0, CTR in percent, no ROAS without value.

    By currency, or by currency and other keys.
    """
    own = facts.where((F.col("provider") == provider) & (F.col("level") == "AD"))
    weighted = F.coalesce(F.sum(F.when(F.col("impressions") > 0, F.col("frequency") * F.col("impressions"))), F.lit(0)).cast("double")
    out = own.groupBy("currency", *(keys or [])).agg(F.count("*").alias("row_count"), F.sum("spend").cast("double").alias("spend"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.coalesce(F.sum("conversions"), F.lit(0)).alias("conversions"), F.coalesce(F.sum("conversion_value").cast("double"), F.lit(0.0)).alias("conversion_value"), weighted.alias("_weighted"))
    out = out.withColumn("frequency", safe_div(F.col("_weighted"), F.col("impressions"))).drop("_weighted")
    return out.withColumn("ctr_percent", safe_div(F.col("clicks") * 100, F.col("impressions"))).withColumn("roas", F.when(F.col("conversion_value") != 0, safe_div(F.col("conversion_value"), F.col("spend"))))


def spend_shares(facts: DataFrame, entity: str) -> DataFrame:
    """Each entity's share of its currency's spend."""
    sums = facts.groupBy("currency", entity).agg(F.sum("spend").cast("double").alias("spend"))
    totals = facts.groupBy("currency").agg(F.sum("spend").cast("double").alias("_all"))
    return sums.join(totals, "currency").withColumn("spend_share", safe_div(F.col("spend"), F.col("_all"))).drop("_all")


def entity_evidence(facts: DataFrame, entity: str) -> DataFrame:
    """An entity's metrics by period and currency, with its share of that spend."""
    totals = facts.groupBy("period", "currency").agg(F.sum("spend").cast("double").alias("_all"))
    out = metric_sums(facts, ["period", "currency", entity]).join(totals, ["period", "currency"])
    return out.withColumn("spend_share", safe_div(F.col("spend"), F.col("_all"))).drop("_all")


def purchase_actions(actions: DataFrame) -> DataFrame:
    """One action type per insight and kind: pixel purchases, then omni, then ``purchase``, then any other purchase."""
    t = F.lower("action_type")
    rank = F.when(t.contains("pixel_purchase"), 0).when(t == "omni_purchase", 1).when(t == "purchase", 2).when(t.contains("purchase"), 3)
    w = Window.partitionBy("insight_id", "kind").orderBy("_rank", "action_type")
    return actions.withColumn("_rank", rank).where("_rank is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_rank", "_n")


def classify_mappings(mappings: DataFrame, shared: DataFrame) -> DataFrame:
    """Each mapped ad's class, the product it is exactly mapped to, and the confidence.

    SHARED if the ad advertises several products or a collection; EXACT if its
    confirmed mappings, or without any those with a confidence of 0.7 or more, name
    one product; else AMBIGUOUS, so an ad with weak mappings only is AMBIGUOUS too.
    """
    confirmed = F.coalesce("is_merchant_confirmed", F.lit(False))
    usable = F.col("confidence") >= 0.7
    by_ad = mappings.groupBy("ad_id").agg(
        F.bool_or(confirmed).alias("merchant_confirmed"),
        F.count_distinct(F.when(confirmed, F.col("product_id"))).alias("_nc"), F.min(F.when(confirmed, F.col("product_id"))).alias("_c"), F.max(F.when(confirmed, F.col("confidence"))).alias("_cc"),
        F.count_distinct(F.when(usable, F.col("product_id"))).alias("_nu"), F.min(F.when(usable, F.col("product_id"))).alias("_u"), F.max(F.when(usable, F.col("confidence"))).alias("_cu"), F.max("confidence").alias("_any"),
    )
    flagged = by_ad.join(shared.select("ad_id").distinct().withColumn("_shared", F.lit(True)), "ad_id", "left")
    is_shared, n = F.coalesce("_shared", F.lit(False)), F.when(F.col("merchant_confirmed"), F.col("_nc")).otherwise(F.col("_nu"))
    kind = F.when(is_shared, "SHARED").when(n == 1, "EXACT").otherwise("AMBIGUOUS")
    sure = F.when(is_shared, F.col("_any")).when(F.col("merchant_confirmed") & (F.col("_nc") == 1), 1.0).when(F.col("merchant_confirmed"), F.col("_cc")).otherwise(F.coalesce("_cu", F.lit(0.0)))
    return flagged.select("ad_id", kind.alias("mapping_class"), F.when(kind == "EXACT", F.when(F.col("merchant_confirmed"), F.col("_c")).otherwise(F.col("_u"))).alias("product_id"), sure.cast("double").alias("confidence"), "merchant_confirmed")


def mapping_accounting(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Spend by period, provider and mapping class; ads without a mapping are UNMAPPED."""
    joined = facts.groupBy("period", "provider", "ad_id").agg(F.sum("spend").alias("spend")).join(classes.select("ad_id", "mapping_class"), "ad_id", "left")
    return joined.groupBy("period", "provider", F.coalesce("mapping_class", F.lit("UNMAPPED")).alias("mapping_class")).agg(F.sum("spend").cast("double").alias("spend"), F.count("*").alias("ads"))


def mapping_summary(ads: DataFrame, mappings: DataFrame) -> DataFrame:
    """Ads by the scope of what they advertise, and how many have a confirmed mapping.  ads: (ad_id, target_scope)."""
    confirmed = mappings.where("is_merchant_confirmed").select("ad_id").distinct().withColumn("_c", F.lit(1))
    return ads.join(confirmed, "ad_id", "left").groupBy("target_scope").agg(F.count("*").alias("ads"), F.count("_c").alias("confirmed_ads"))


def overridden_mappings(mappings: DataFrame, manual: DataFrame, at) -> DataFrame:
    """Mappings after a manual choice: the ads' current ones end at a time, and the chosen products are confirmed from then on.

    mappings: (ad_id, product_id, confidence, is_merchant_confirmed, valid_from, valid_until); manual: (ad_id, product_id).
    """
    touched = manual.select("ad_id").distinct().withColumn("_t", F.lit(True))
    closed = mappings.join(touched, "ad_id", "left").withColumn("valid_until", F.when(F.col("_t") & F.col("valid_until").isNull(), at).otherwise(F.col("valid_until"))).drop("_t")
    added = manual.distinct().select("ad_id", "product_id", F.lit(1.0).alias("confidence"), F.lit(True).alias("is_merchant_confirmed"), at.alias("valid_from"), F.lit(None).cast(mappings.schema["valid_until"].dataType).alias("valid_until"))
    return closed.select(added.columns).unionAll(added)


def product_ads(metrics: DataFrame, facts: DataFrame, classes: DataFrame, currency: str) -> DataFrame:
    """Products by period with the spend of the ads mapped to exactly them.

    Only facts in the store's currency count.  Products with sales, with spend or
    with a mapped ad only are all there; without a fact there is no contribution
    after ads, as missing spend is not a spend of 0.  Confidence is weighted by spend, or the largest without any;
    it is summed without rounding and kept to 12 digits, so that a threshold doesn't hang on the order of the sum.
    """
    exact = classes.where("mapping_class = 'EXACT'").select("ad_id", "product_id", "confidence", "merchant_confirmed")
    by_ad = facts.where(F.col("currency") == currency).groupBy("period", "ad_id").agg(F.count("*").alias("source_rows"), F.sum("spend").alias("_spent"), F.sum("impressions").alias("impressions"), F.count("conversion_value").alias("_valued"), F.sum("conversion_value").alias("_value"))
    spent = by_ad.join(exact.drop("merchant_confirmed"), "ad_id", "left").select("period", "product_id", "source_rows", "_spent", "impressions", "_valued", "_value", (F.col("_spent").cast("decimal(26,4)") * F.col("confidence").cast("decimal(11,10)")).alias("_weighted"))
    mapped = exact.groupBy("product_id").agg(F.count("*").alias("mapped_ads"), F.max("confidence").alias("_most"), F.bool_or("merchant_confirmed").alias("merchant_confirmed"))
    each = mapped.select("*", F.explode(F.array(F.lit("CURRENT"), F.lit("COMPARISON"))).alias("period"))
    sold = metrics.where("product_id is not null").select("period", "product_id", "net_units", "net_revenue", "cost_coverage", "contribution_before_ads")
    # what is known of a product comes together under its key in one aggregate; spend without a product only counts in the totals
    rows = sold.unionByName(spent, allowMissingColumns=True).unionByName(each, allowMissingColumns=True)
    out = rows.groupBy("period", "product_id").agg(
        *[F.max(n).alias(n) for n in ("net_units", "net_revenue", "cost_coverage", "contribution_before_ads", "mapped_ads", "_most", "merchant_confirmed")],
        *[F.sum(n).alias(n) for n in ("source_rows", "_spent", "impressions", "_weighted")], F.when(F.sum("_valued") == F.sum("source_rows"), F.sum("_value")).cast("double").alias("conversion_value"),
    )
    totals = out.groupBy("period").agg(F.sum("_spent").cast("double").alias("_spend"), F.sum("net_revenue").alias("_revenue"))
    out = out.where("product_id is not null").withColumn("exact_spend", F.col("_spent").cast("double")).join(F.broadcast(totals), "period")  # a row per period
    out = out.fillna(0, ["source_rows", "impressions", "mapped_ads", "net_units"]).fillna(0.0, ["exact_spend", "net_revenue"]).fillna(False, ["merchant_confirmed"])
    # no sales: nothing was sold at no cost
    before = F.when(F.col("cost_coverage").isNull(), 0.0).otherwise(F.col("contribution_before_ads"))
    spend = F.col("exact_spend")
    return out.select(
        "period", "product_id", "net_units", "net_revenue", before.alias("contribution_before_ads"), "source_rows", "exact_spend", "impressions",
        F.when(F.col("source_rows") > 0, before - spend).alias("contribution_after_ads"),
        F.coalesce(safe_div(F.col("net_revenue"), F.col("_revenue")), F.lit(0.0)).alias("revenue_share"),
        F.coalesce(safe_div(spend, F.col("_spend")), F.lit(0.0)).alias("spend_share"),
        F.when(F.col("source_rows") > 0, safe_div(F.col("conversion_value"), spend)).alias("roas"),
        F.when(spend > 0, F.round(F.col("_weighted").cast("double") / spend, 12)).otherwise(F.coalesce("_most", F.lit(0.0))).alias("mapping_confidence"),
        "mapped_ads", "merchant_confirmed",
    )


def mapping_coverage(facts: DataFrame, classes: DataFrame, currency: str) -> DataFrame:
    """By period: the store currency's spend, how much of it is exactly mapped, and the spend in other currencies."""
    exact = classes.where("mapping_class = 'EXACT'").select("ad_id", F.lit(True).alias("_exact"))
    own = F.col("currency") == currency
    sums = facts.groupBy("period", "ad_id", "currency").agg(F.sum("spend").alias("spend")).join(exact, "ad_id", "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("spend"))).cast("double"), F.lit(0.0))
    out = sums.groupBy("period").agg(total(own).alias("spend"), total(own & F.col("_exact")).alias("exact_spend"), total(F.coalesce(~own, F.lit(True))).alias("excluded_spend"))
    return out.withColumn("mapping_coverage", F.when(F.col("spend") > 0, F.col("exact_spend") / F.col("spend")).otherwise(0.0))


def ad_rows(facts: DataFrame) -> DataFrame:
    """Each ad's sums by period, provider and currency: the rows that product reads fold."""
    return metric_sums(facts.where("level <> 'CAMPAIGN'"), ["period", "provider", "ad_id", "currency"])


#: The column that names an entity of a kind.
ENTITY_COLUMNS = {"ACCOUNT": "account_id", "CAMPAIGN": "campaign_id", "GROUP": "group_id", "AD": "ad_id", "CREATIVE": "creative_id"}


def entity_metrics(facts: DataFrame, kind: str) -> DataFrame:
    """One kind of entity by period and currency, with how many facts there are and the days they cover."""
    entity = ENTITY_COLUMNS[kind]
    keys = ["period", "provider", "currency", entity]
    rows = facts.where(F.col(entity).isNotNull()).groupBy(*keys).agg(F.count("*").alias("source_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return metric_sums(facts.where(F.col(entity).isNotNull()), keys).join(rows, keys).withColumnRenamed(entity, "entity_id")


def entity_confidence(source_rows, impressions, source_rows0, impressions0) -> F.Column:
    """LOW without facts or impressions enough to say anything now; HIGH if both periods have facts and 1000 impressions, else MEDIUM."""
    n = lambda c: F.coalesce(c, F.lit(0))
    low = (n(source_rows) == 0) | (n(impressions) < 100)
    high = (n(source_rows0) > 0) & (n(impressions) >= 1000) & (n(impressions0) >= 1000)
    return F.when(low, "LOW").when(high, "HIGH").otherwise("MEDIUM")


def creative_rows(facts: DataFrame) -> DataFrame:
    """Creatives' sums, where missing conversions and value count 0, unlike anywhere else."""
    filled = facts.withColumn("conversions", F.coalesce("conversions", F.lit(0))).withColumn("conversion_value", F.coalesce("conversion_value", F.lit(0)))
    return metric_sums(filled.where("creative_id is not null"), ["period", "currency", "creative_id"])


def counters(facts: DataFrame) -> DataFrame:
    """How many accounts, campaigns and ads have facts, and how many facts there are; one pass."""
    return facts.agg(F.count_distinct("account_id").alias("accounts"), F.count_distinct("campaign_id").alias("campaigns"), F.count_distinct("ad_id").alias("ads"), F.count("*").alias("facts"))


def without_unknown_currency(summary: DataFrame, accounts: DataFrame, fields: list[str]) -> DataFrame:
    """Blended fields are null as soon as any account's currency is unknown."""
    unknown = accounts.agg(F.coalesce(F.bool_or(F.col("currency").isNull()), F.lit(False)).alias("_u"))
    return summary.crossJoin(F.broadcast(unknown)).withColumns({f: F.when(~F.col("_u"), F.col(f)) for f in fields}).drop("_u")


def in_scope(accounts: DataFrame, *, provider: str | None, selected: list, entitled: list[str]) -> DataFrame:
    """The accounts that are selected, of an entitled provider, and of the one asked for; none selected gives none."""
    out = accounts.where(F.col("provider").isin(entitled) if entitled else F.lit(False)).where(F.col("account_id").isin(selected) if selected else F.lit(False))
    return out if provider is None else out.where(F.col("provider") == provider)


#: Which levels a provider reports.  Fixed values.
LEVELS = {"META": ("AD",), "TIKTOK": ("CAMPAIGN", "GROUP", "AD"), "GOOGLE": ("ACCOUNT", "CAMPAIGN", "GROUP", "ASSET_GROUP", "AD")}


def exposure_targets(mappings: DataFrame, most: int = 10) -> DataFrame:
    """Each ad's targets in order of confidence, so many at most, beside how many there are.

    The members shown are a feature of the list; ``targets`` counts all.
    """
    w = Window.partitionBy("ad_id").orderBy(F.desc("confidence"), "product_id")
    counted = mappings.groupBy("ad_id").agg(F.count("*").alias("targets"))
    return mappings.select("ad_id", "product_id", "confidence").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).join(counted, "ad_id")


def exposure_scope(classes: DataFrame, facts: DataFrame) -> DataFrame:
    """Each ad's spend by how it may be used: with one product, or shared by several and then never split."""
    spent = facts.groupBy("period", "ad_id", "currency").agg(F.sum("spend").cast("double").alias("spend"))
    scope = F.coalesce("mapping_class", F.lit("UNKNOWN"))
    return spent.join(classes.select("ad_id", "mapping_class", "product_id"), "ad_id", "left").select("period", "ad_id", "currency", scope.alias("scope"), "product_id", F.when(scope == "EXACT", F.col("spend")).alias("product_spend"), F.when(scope == "SHARED", F.col("spend")).alias("shared_spend"), "spend")
