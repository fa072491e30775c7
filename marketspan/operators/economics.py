"""Composite reads: blended economics, customers, stock cover, shared exposure, trends, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp01, percent_change, safe_div
from .commerce import with_adjustments

PERIODS = ("CURRENT", "COMPARISON")
SEGMENTS = ("TOTAL", "NEW", "RETURNING", "UNKNOWN")


def compatible_spend(facts: DataFrame, accounts: DataFrame, currency: str) -> DataFrame:
    """Both periods' spend of the store currency's accounts; null if any of them lacks facts or there are none.

    accounts: (account_id, currency).
    """
    sums = facts.where(F.col("currency") == currency).groupBy("period", "account_id").agg(F.sum("spend").alias("_spend"))
    own = accounts.where(F.col("currency") == currency).select("account_id").distinct()
    grid = own.withColumn("period", F.explode(F.array(*map(F.lit, PERIODS))))
    missing = F.count("*") - F.count("_spend")
    return grid.join(sums, ["period", "account_id"], "left").groupBy("period").agg(missing.alias("missing_accounts"), F.when(missing == 0, F.sum("_spend")).cast("double").alias("spend"))


def blended_economics(kpis: DataFrame, metrics: DataFrame, spend: DataFrame) -> DataFrame:
    """By period: spend against order value, and the contribution after it; nothing is 0 for lack of evidence.

    kpis: ``order_kpis``; metrics: ``product_metrics``; spend: ``compatible_spend``.
    """
    all_costed = F.bool_and(F.col("cogs").isNotNull())
    before = metrics.groupBy("period").agg(F.when(all_costed, F.sum("net_revenue") - F.sum("cogs")).alias("contribution_before_ads"))
    out = kpis.select("period", "orders", "order_value").join(before, "period", "left").join(spend, "period", "left")
    return (
        out.withColumn("mer", F.when(F.col("spend") > 0, safe_div(F.col("order_value"), F.col("spend"))))
        .withColumn("ad_spend_ratio", F.when(F.col("order_value") > 0, safe_div(F.col("spend"), F.col("order_value"))))
        .withColumn("contribution_after_ads", F.col("contribution_before_ads") - F.col("spend"))
    )


def period_changes(by_period: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """A row per key with each metric's current (``x``) and comparison (``x0``) value and relative change."""
    pick = lambda m, p: F.max(F.when(F.col("period") == p, F.col(m)))
    both = by_period.groupBy(*(keys or [])).agg(*[pick(m, PERIODS[0]).alias(m) for m in metrics], *[pick(m, PERIODS[1]).alias(f"{m}0") for m in metrics])
    return both.withColumns({f"{m}_change": percent_change(F.col(m), F.col(f"{m}0")) for m in metrics})


def customers(aggregates: DataFrame) -> DataFrame:
    """The total and each segment in both periods, with changes and the share of orders whose segment is known.

    aggregates: ``order_aggregates``.  A segment without orders has 0; without any order coverage is 0.
    """
    each = aggregates.withColumn("segment", F.explode(F.array(F.lit("TOTAL"), "segment")))
    pick = lambda m, p: F.sum(F.when(F.col("period") == p, F.col(m)))
    names = [("orders", "orders"), ("units", "units"), ("order_value", "order_value")]
    sums = each.groupBy("segment").agg(*[pick(m, p).alias(n + z) for m, n in names for p, z in zip(PERIODS, ("", "0"))])
    all_segments = aggregates.sparkSession.createDataFrame([(s,) for s in SEGMENTS], "segment string")
    out = all_segments.join(sums, "segment", "left").fillna(0)
    whole = Window.partitionBy()  # four rows
    part = lambda c, s: F.sum(F.when(F.col("segment").isin(*s), F.col(c))).over(whole)
    for z in ("", "0"):
        out = out.withColumn(f"coverage{z}", F.coalesce(safe_div(part(f"orders{z}", SEGMENTS[1:3]), part(f"orders{z}", SEGMENTS[:1])), F.lit(0.0)))
        out = out.withColumn(f"average_order_value{z}", safe_div(F.col(f"order_value{z}"), F.col(f"orders{z}")))
    return out.withColumns({f"{n}_change": percent_change(F.col(n), F.col(f"{n}0")) for _, n in names})


def inventory_cover(items: DataFrame, levels: DataFrame, lines: DataFrame, *, days: int, trusted: bool) -> DataFrame:
    """Every item's stock over all locations, what it sells a day, and for how many days stock lasts.

    items: (product_id, tracked); levels: (product_id, available, incoming); lines:
    those of the window.  Cover is null unless stock is trusted and tracked and the
    item sells; stock below 0 lasts 0 days.
    """
    stock = levels.groupBy("product_id").agg(F.sum("available").alias("available"), F.sum("incoming").alias("incoming"))
    sold = with_adjustments(lines).groupBy("product_id").agg(F.sum("cost_units").alias("units_sold"))
    out = items.join(stock, "product_id", "left").join(sold, "product_id", "left").fillna(0, ["available", "incoming", "units_sold"])
    a_day = F.col("units_sold") / F.lit(float(days))
    known = F.lit(trusted) & F.col("tracked") & (F.col("units_per_day") > 0)
    return out.withColumn("units_per_day", a_day).withColumn("days_cover", F.when(known, F.greatest(F.col("available"), F.lit(0)) / F.col("units_per_day")))


def with_reorder_state(cover: DataFrame, *, lead_days: float = 10, low_stock: float = 0) -> DataFrame:
    """Adds reorder_point, at_risk, critical and urgency; null without sales or with stock unknown or below 0."""
    lead, low = max(0, lead_days), max(0, low_stock)
    known = (F.col("available") >= 0) & (F.col("units_per_day") > 0)
    point = F.ceil(F.col("units_per_day") * lead + F.lit(low))
    short = F.greatest(F.col("reorder_point") - F.col("available"), F.lit(0))
    out = cover.withColumn("reorder_point", F.when(known, point))
    return (
        out.withColumn("at_risk", F.when(known, F.col("available") <= F.col("reorder_point")))
        .withColumn("critical", F.when(known, (F.col("available") <= low) | (F.col("available") <= F.col("units_per_day") * max(1.0, lead / 2))))
        .withColumn("urgency", F.when(known, clamp01(0.55 + short / F.greatest(F.lit(1), F.col("reorder_point")) * 0.45)))
    )


def shared_exposure_conflicts(sums: DataFrame, targets: DataFrame, stock: DataFrame) -> DataFrame:
    """Ads of several products that spend while some of these are at their reorder point; spend is never split.

    sums: (ad_id, spend, impressions); targets: (ad_id, product_id, confidence,
    is_merchant_confirmed); stock: trusted items ``with_reorder_state``.
    """
    scope = targets.groupBy("ad_id").agg(F.count_distinct("product_id").alias("products"), F.max("confidence").alias("confidence"), F.bool_or("is_merchant_confirmed").alias("confirmed"))
    active = sums.where("spend > 0 and impressions >= 1000").join(scope.where("products > 1 and (confirmed or confidence >= 0.7)"), "ad_id")
    risky = targets.select("ad_id", "product_id").distinct().join(stock.where("at_risk"), "product_id").groupBy("ad_id").agg(F.count("*").alias("affected_products"), F.bool_or("critical").alias("_critical"), F.max("urgency").alias("urgency"), F.min("days_cover").alias("minimum_days_cover"))
    out = active.join(risky, "ad_id").withColumn("severity", F.when(F.col("_critical"), "CRITICAL").otherwise("HIGH"))
    return out.select("ad_id", "products", "affected_products", "spend", "impressions", "severity", "urgency", "minimum_days_cover")


def daily_trend(orders: DataFrame, facts: DataFrame, days: DataFrame, currency: str) -> DataFrame:
    """Every day of the spine: orders by local day beside the store currency's spend by report day, and their ratio."""
    sold = orders.groupBy(F.to_date("demand_at").alias("day")).agg(F.count("*").alias("orders"), F.sum("value").cast("double").alias("order_value"))
    spent = facts.where(F.col("currency") == currency).groupBy(F.col("date").alias("day")).agg(F.sum("spend").cast("double").alias("spend"))
    out = days.join(sold, "day", "left").join(spent, "day", "left").fillna({"orders": 0, "order_value": 0.0, "spend": 0.0})
    return out.withColumn("mer", F.when(F.col("spend") > 0, safe_div(F.col("order_value"), F.col("spend"))))


def net_revenue_totals(lines: DataFrame) -> DataFrame:
    """Net revenue by period: refunds clamped by line, a product's sum at least 0."""
    left = F.greatest(F.sum(F.col("revenue").cast("double") - F.col("adjusted_value")), F.lit(0.0))
    return with_adjustments(lines).groupBy("period", "product_id").agg(left.alias("_net")).groupBy("period").agg(F.sum("_net").alias("net_revenue"))


def ranked_candidates(metrics: DataFrame, spend: DataFrame, explicit: DataFrame, *, offset: int, limit: int) -> DataFrame:
    """A page of all products with sales, mapped spend or an explicit wish, by spend, net revenue and id.

    metrics: (product_id, net_revenue); spend: (product_id, spend); explicit: (product_id).
    """
    ids = metrics.select("product_id").union(spend.select("product_id")).union(explicit.select("product_id")).distinct()
    out = ids.join(spend, "product_id", "left").join(metrics, "product_id", "left")
    return out.orderBy(F.desc_nulls_last("spend"), F.desc_nulls_last("net_revenue"), "product_id").offset(offset).limit(limit)
