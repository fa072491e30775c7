"""Orders, product economics, collections and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent_change, safe_div
from . import textindex
from .joins import top1_by

#: Share of cost-relevant units that must have a cost before a COGS is reported.
MIN_COST_COVERAGE = 0.8


def with_adjustments(lines: DataFrame) -> DataFrame:
    """Refunded units and value, at most those of the line; a removed quantity counts as refunded."""
    removed = F.col("quantity") - F.col("current_quantity")
    units = F.least("quantity", F.greatest(F.col("refunded_units"), removed, F.lit(0)))
    by_removal = F.try_divide(F.col("revenue").cast("double") * removed, F.col("quantity"))
    value = F.least(F.col("revenue").cast("double"), F.greatest(F.col("refund_value").cast("double"), by_removal, F.lit(0.0)))
    return lines.withColumn("adjusted_units", units).withColumn("adjusted_value", value).withColumn("cost_units", F.greatest(F.col("quantity") - F.col("restocked_units"), F.lit(0)))


def product_economics(lines: DataFrame) -> DataFrame:
    """Per period and product, from lines that carry unit_cost (null: no cost is known at the order's time)."""
    has_cost = F.col("unit_cost").isNotNull()
    # one row per order and product first, so that orders are counted as rows beside the sums
    by_order = with_adjustments(lines).groupBy("period", "product_id", "order_id").agg(
        F.sum("quantity").alias("q"), F.sum("adjusted_units").alias("a"), F.sum("revenue").alias("r"), F.sum(F.round(F.col("adjusted_value") * 10000).cast("long")).alias("v"),
        F.sum(F.when(has_cost, F.col("unit_cost") * F.col("cost_units"))).alias("c"), F.sum(F.when(has_cost, F.col("cost_units"))).alias("n"), F.sum("cost_units").alias("u"),
    )
    base = by_order.groupBy("period", "product_id").agg(
        F.count("*").alias("orders"), F.sum("q").alias("sold_units"), F.sum("a").alias("refunded_units"), F.sum("r").cast("double").alias("revenue"), F.sum("v").alias("_refund"),
        F.sum("c").cast("double").alias("raw_cogs"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered_units"), F.sum("u").alias("relevant_units"),
    )
    return base.withColumn("refund_value", F.col("_refund") / 10000.0).drop("_refund")


def product_metrics(economics: DataFrame) -> DataFrame:
    """Net revenue of at least 0; COGS and contribution only from a cost coverage of 0.8 on."""
    coverage = F.when(F.col("relevant_units") == 0, 1.0).otherwise(safe_div(F.col("covered_units"), F.col("relevant_units")))
    net = F.greatest(F.col("revenue") - F.col("refund_value"), F.lit(0.0))
    out = economics.withColumn("cost_coverage", coverage).withColumn("net_revenue", net).withColumn("net_units", F.col("sold_units") - F.col("refunded_units"))
    out = out.withColumn("cogs", F.when(F.col("cost_coverage") >= MIN_COST_COVERAGE, F.coalesce("raw_cogs", F.lit(0.0))))
    return out.withColumn("contribution_before_ads", F.col("net_revenue") - F.col("cogs"))


def total_product_metrics(metrics: DataFrame) -> DataFrame:
    """Sums over products; orders are summed per product, and one missing COGS leaves the total without one."""
    all_costed = F.bool_and(F.col("cogs").isNotNull())
    return metrics.groupBy("period").agg(F.sum("orders").alias("order_count"), F.sum("net_units").alias("net_units"), F.sum("net_revenue").alias("net_revenue"), F.when(all_costed, F.sum("cogs")).alias("cogs"), safe_div(F.sum(F.col("cost_coverage") * F.col("net_revenue")), F.sum("net_revenue")).alias("cost_coverage"))


def order_aggregates(orders: DataFrame) -> DataFrame:
    """Orders by period and customer segment; totals are net of returns already."""
    return orders.groupBy("period", "segment").agg(F.count("*").alias("orders"), F.sum("units").alias("units"), F.sum("value").cast("double").alias("order_value"), F.sum("refunds").cast("double").alias("refunds"))


def order_kpis(aggregates: DataFrame) -> DataFrame:
    """One row per period: order value, average, and the segments' counts."""
    n = lambda s: F.sum(F.when(F.col("segment") == s, F.col("orders")).otherwise(0))
    out = aggregates.groupBy("period").agg(F.sum("orders").alias("orders"), F.sum("order_value").alias("order_value"), F.sum("refunds").alias("refunds"), n("NEW").alias("new_orders"), n("RETURNING").alias("returning_orders"), n("UNKNOWN").alias("unknown_orders"))
    known = F.col("new_orders") + F.col("returning_orders")
    return out.withColumn("average_order_value", safe_div(F.col("order_value"), F.col("orders"))).withColumn("returning_share", safe_div(F.col("returning_orders"), known)).withColumn("segment_coverage", safe_div(known, F.col("orders")))


def commerce_health(orders: DataFrame) -> DataFrame:
    """Refund and discount rates by period."""
    return orders.groupBy("period").agg(F.count("*").alias("orders"), safe_div(F.count_if(F.col("refunds") > 0), F.count("*")).alias("refund_order_rate"), safe_div(F.sum("refunds"), F.sum("value")).alias("refund_rate"), safe_div(F.sum("discounts"), F.sum("discounts") + F.sum("value")).alias("discount_rate"))


def variant_depletion(lines: DataFrame) -> DataFrame:
    """Units that left stock: sold and not restocked."""
    return lines.groupBy("product_id").agg(F.sum(F.greatest(F.col("quantity") - F.col("restocked_units"), F.lit(0))).alias("depleted_units"))


def raw_refund_evidence(lines: DataFrame) -> DataFrame:
    """Product evidence with uncapped refunds and no account of removed quantities."""
    return lines.groupBy("period", "product_id").agg(F.sum("quantity").alias("units"), F.sum("revenue").cast("double").alias("revenue"), F.coalesce(F.sum("refunded_units"), F.lit(0)).alias("refunded_units"), F.coalesce(F.sum("refund_value").cast("double"), F.lit(0.0)).alias("refund_value"))


def collection_performance(lines: DataFrame, members: DataFrame, periods: DataFrame, collections: DataFrame) -> DataFrame:
    """Every collection in every period; a line counts once in each of its product's collections.

    An order's lines come together once; it names each of its collections once and each line's sums, so no
    aggregate holds a row for every order and collection.
    """
    of_product = members.distinct().groupBy("product_id").agg(F.collect_list("collection_id").alias("_in"))
    # lines without an order count as none, and are dealt by their products
    dealt = lines.join(of_product, "product_id").withColumn("_deal", F.when(F.col("order_id").isNull(), F.col("product_id")))
    by_order = dealt.groupBy("period", "order_id", "_deal").agg(F.collect_list(F.struct("_in", "quantity", "revenue")).alias("_lines"))
    row = lambda k, n, q, r: F.struct(k.alias("collection_id"), n.alias("n"), q.alias("q"), r.alias("r"))
    none = lambda name: F.lit(None).cast(lines.schema[name].dataType)
    counted = F.transform(F.array_distinct(F.flatten("_lines._in")), lambda k: row(k, F.col("order_id").isNotNull().cast("long"), none("quantity"), none("revenue")))
    summed = F.flatten(F.transform("_lines", lambda x: F.transform(x["_in"], lambda k: row(k, F.lit(0).cast("long"), x["quantity"], x["revenue"]))))
    sums = by_order.select("period", F.inline(F.concat(counted, summed))).groupBy("period", "collection_id").agg(F.sum("n").alias("orders"), F.sum("q").alias("units"), F.sum("r").cast("double").alias("revenue"))
    grid = collections.crossJoin(F.broadcast(periods))  # periods are two rows
    zero = {"orders": 0, "units": 0, "revenue": 0.0}
    return grid.join(sums, ["period", "collection_id"], "left").fillna(zero)


def daily_sales(lines: DataFrame) -> DataFrame:
    """Sales by UTC day."""
    return lines.groupBy(F.to_date("demand_at").alias("day")).agg(F.count_distinct("order_id").alias("orders"), F.sum("quantity").alias("units"), F.sum("revenue").cast("double").alias("gross"), F.sum("refund_value").cast("double").alias("refunds"))


def variant_sales(lines: DataFrame) -> DataFrame:
    """Sales by product: orders, ordered, current and refunded units, gross, refunds and what is left of both."""
    by_order = lines.groupBy("product_id", "order_id").agg(F.sum("quantity").alias("q"), F.sum("current_quantity").alias("c"), F.sum("refunded_units").alias("r"), F.sum("revenue").alias("g"), F.sum("refund_value").alias("f"))
    out = by_order.groupBy("product_id").agg(F.count("*").alias("orders"), F.sum("q").alias("units"), F.sum("c").alias("current_units"), F.sum("r").alias("refunded_units"), F.sum("g").cast("double").alias("gross"), F.sum("f").cast("double").alias("refunds"))
    return out.withColumn("net", F.col("gross") - F.col("refunds"))


def search_index(products: DataFrame, variants: DataFrame) -> DataFrame:
    """(size, gram, product_id): the grams of products' titles and vendors and of their variants' SKUs, in lower case; to be written once and searched often."""
    field = lambda c: F.lower(F.col(c)).alias("_t")
    texts = products.select("product_id", field("title")).unionAll(products.select("product_id", field("vendor"))).unionAll(variants.select("product_id", field("sku")))
    return textindex.gram_index(texts.where("_t is not null"), "product_id", F.col("_t"))


def search(products: DataFrame, variants: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """Products whose title or vendor, or any of whose variants' SKU, holds a text, whatever its case.

    Only products that have the rarest gram of the text (``search_index``) are compared.
    """
    q = text.lower()
    holds = lambda c: F.lower(c).contains(q)
    candidates = textindex.candidates(index, "product_id", q)
    own = products if candidates is None else products.join(candidates, "product_id", "left_semi")
    skus = variants if candidates is None else variants.join(candidates, "product_id", "left_semi")
    by_sku = skus.where(holds("sku")).select("product_id").distinct().withColumn("_sku", F.lit(True))
    return own.join(by_sku, "product_id", "left").where(holds("title") | holds("vendor") | F.col("_sku")).drop("_sku")


def stock_state(available, trusted, units_per_day, *, lead_days: float, low_stock: float):
    """What a stock level means: UNAVAILABLE, SOLD_OUT, STOCKOUT_RISK, LOW_STOCK, OVERSTOCK_WEAK_DEMAND or HEALTHY."""
    cover = F.when(units_per_day > 0, F.greatest(available, F.lit(0)) / units_per_day)
    return (
        F.when(~trusted | available.isNull(), "UNAVAILABLE")
        .when(available <= 0, "SOLD_OUT")
        .when(cover <= lead_days, "STOCKOUT_RISK")
        .when(available <= low_stock, "LOW_STOCK")
        .when((units_per_day == 0) & (available > low_stock * 3), "OVERSTOCK_WEAK_DEMAND")
        .otherwise("HEALTHY")
    )


def leaderboard(metrics: DataFrame, size: int) -> DataFrame:
    """The first products of either period by current net revenue, net units, orders and id, with changes; only the result is in one partition."""
    names = ["net_revenue", "net_units", "orders"]
    pick = lambda m, p: F.coalesce(F.max(F.when(F.col("period") == p, F.col(m))), F.lit(0))
    both = metrics.groupBy("product_id").agg(*[pick(m, p).alias(m + z) for m in names for p, z in (("CURRENT", ""), ("COMPARISON", "0"))])
    order = [F.desc("net_revenue"), F.desc("net_units"), F.desc("orders"), F.asc("product_id")]
    best = both.orderBy(*order).limit(size)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumns({f"{m}_change": percent_change(F.col(m), F.col(f"{m}0")) for m in names})


def latest_levels(snapshots: DataFrame, until) -> DataFrame:
    """The last snapshot of each item and location up to a time."""
    return top1_by(snapshots.where(F.col("observed_at") <= until), ["item_id", "location_id"], [F.desc("observed_at")])


def inventory_history(snapshots: DataFrame, days: DataFrame) -> DataFrame:
    """Stock at each day's end: each item's last known level carried forward, summed over items."""
    last = snapshots.groupBy("item_id", "location_id", F.to_date("observed_at").alias("day")).agg(F.max_by("available", "observed_at").alias("available"))
    days = days.select("day").distinct()
    first = F.broadcast(days.agg(F.min("day").alias("first_day")))
    before = last.crossJoin(first).where("day < first_day").groupBy("item_id", "location_id", F.col("first_day").alias("day")).agg(F.max_by("available", "day").alias("available")).withColumn("_own", F.lit(0))
    # only changes are kept: a level counts from its day on, less the one that it replaces
    known = before.unionByName(last.join(F.broadcast(days), "day", "left_semi").withColumn("_own", F.lit(1))).where("available is not null")
    level_before = F.lag("available").over(Window.partitionBy("item_id", "location_id").orderBy("day", "_own"))
    changes = known.select("day", (F.col("available") - F.coalesce(level_before, F.lit(0))).alias("_change")).groupBy("day").agg(F.sum("_change").alias("_change"))
    some = F.broadcast(last.limit(1).select(F.lit(True).alias("_some")))  # without any item there are no days
    return days.crossJoin(some).join(changes, "day", "left").select("day", F.sum("_change").over(Window.orderBy("day")).alias("available"))  # a window's days: 365 at most
