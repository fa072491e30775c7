"""What a caller asks for: pages and workspaces from the operators' frames, each as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import percent_change
from .advertising import entity_confidence, entity_metrics
from .economics import period_changes
from .rules import entity_signals


def page(rows: DataFrame, order: list[Column], *, page: int, limit: int) -> DataFrame:
    """A page of rows in order with ``total``, the number of all; the total is one row that is joined to the page."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be 1 or more, limit from 1 to 100")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit).crossJoin(F.broadcast(total))


def store_summary(products: DataFrame, orders: DataFrame) -> DataFrame:
    """Counts of products by size of stock, stock sums, and the window's sales; one row from two aggregates.

    The tables' only stock is a product's size less 10: sold out at 0 or less, low up to 5.
    """
    level = F.col("p_size") - 10
    catalog = products.agg(F.count("*").alias("products"), F.sum(level).alias("available"), F.count_if((level > 0) & (level <= 5)).alias("low_stock"), F.count_if(level <= 0).alias("out_of_stock"))
    sales = orders.agg(F.count("*").alias("orders"), F.sum("units").alias("units"), F.round(F.sum("value").cast("double"), 2).alias("total_sales"), F.round(F.sum("discounts").cast("double"), 2).alias("discounts"), F.count_if(F.col("refunds") > 0).alias("refunded_orders"), F.round(F.sum("refunds").cast("double"), 2).alias("refunded"))
    return catalog.crossJoin(F.broadcast(sales))


def recent_orders(orders: DataFrame, lines: DataFrame, limit: int) -> DataFrame:
    """The newest orders, cancelled ones too, with their units; only the page's lines are read into the join."""
    newest = orders.orderBy(F.desc("demand_at"), F.desc("order_id")).limit(limit).select("order_id", "demand_at", F.col("value").cast("double").alias("value"), "is_cancelled")
    units = lines.join(F.broadcast(newest.select("order_id")), "order_id").groupBy("order_id").agg(F.sum("quantity").alias("units"), F.count("*").alias("lines"))
    return newest.join(units, "order_id", "left")


def dashboard(blended: DataFrame, stock: DataFrame) -> DataFrame:
    """The overview of both periods with how many products are at risk; a section without rows leaves nulls, not an error."""
    risk = stock.agg(F.count_if("at_risk").alias("products_at_risk"), F.count_if("critical").alias("products_critical"))
    return blended.select("period", "orders", "order_value", "spend", "mer").crossJoin(F.broadcast(risk))


def _both(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    return period_changes(rows, names, [key])


def product_page(metrics: DataFrame, *, page: int, limit: int) -> DataFrame:
    """Products of either period by net revenue, with changes and the number of all."""
    both = _both(metrics, "product_id", ["net_revenue", "net_units", "orders"])
    names = ["net_revenue", "net_units", "orders"]
    filled = both.fillna(0, [n + z for n in names for z in ("", "0")]).withColumns({f"{n}_change": percent_change(F.col(n), F.col(f"{n}0")) for n in names})
    return _page(filled, [F.desc("net_revenue"), F.desc("net_units"), F.desc("orders"), F.asc("product_id")], page, limit)


_page = lambda rows, order, number, limit: page(rows, order, page=number, limit=limit)


def collection_page(performance: DataFrame, *, page: int, limit: int) -> DataFrame:
    """Collections by revenue, with changes."""
    return _page(_both(performance, "collection_id", ["revenue", "orders", "units"]), [F.desc("revenue"), F.asc("collection_id")], page, limit)


def entity_page(facts: DataFrame, kind: str, *, page: int, limit: int) -> DataFrame:
    """Entities of a kind by current spend, with changes."""
    rows = entity_metrics(facts, kind)
    return _page(_both(rows, "entity_id", ["spend", "impressions", "clicks", "roas"]), [F.desc_nulls_last("spend"), F.asc("entity_id")], page, limit)


def signal_page(entities: DataFrame, *, page: int, limit: int) -> DataFrame:
    """Entities by spend with the codes of their signals and how sure their evidence is."""
    both = _both(entities, "entity_id", ["source_rows", "impressions", "spend", "conversions", "roas", "cpc", "ctr"])
    codes = entity_signals(both).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("signals"))
    out = both.select("entity_id", "spend", "impressions", entity_confidence(*[F.col(n) for n in ("source_rows", "impressions", "source_rows0", "impressions0")]).alias("confidence")).join(codes, "entity_id", "left").fillna({"signals": ""})
    return _page(out, [F.desc_nulls_last("spend"), F.asc("entity_id")], page, limit)


def behavior_list(read: DataFrame, *, page: int, limit: int) -> DataFrame:
    """A dimension's keys by current sessions, with changes of their sessions."""
    return _page(_both(read, "key", ["sessions", "view_sessions", "conversion_rate"]), [F.desc_nulls_last("sessions"), F.asc("key")], page, limit)


def attribution_list(rows: DataFrame, dimension: str, periods: Column) -> DataFrame:
    """A dimension's credits summed by period."""
    names = ["touched_sessions", "purchases", "first_touch", "last_touch", "assisted", "single_touch", "cross_session", "delay_ms", "delays"]
    own = rows.where(F.col("dimension") == dimension).withColumn("period", periods).where("period is not null")
    out = own.groupBy("period", "key").agg(*[F.sum(n).alias(n) for n in names])
    return out.withColumn("average_delay_ms", F.floor(F.col("delay_ms") / F.when(F.col("delays") > 0, F.col("delays")))).drop("delay_ms")


def unified_page(products: DataFrame, *, page: int, limit: int) -> DataFrame:
    """Products by mapped spend, then net revenue, with stock and economics."""
    out = products.select("product_id", "net_revenue", "exact_spend", "contribution_after_ads", "stock_state", "mapped_ads", "evidence_quality")
    return _page(out, [F.desc("exact_spend"), F.desc("net_revenue"), F.asc("product_id")], page, limit)


def mapping_totals(accounting: DataFrame, spend: DataFrame) -> DataFrame:
    """By period: the store's paid spend, and how much of it is mapped to exactly one product, shared, ambiguous or unmapped.

    Unmapped is what exact and shared mappings leave of the whole; it is unknown, like the coverage, while an account's
    facts are missing.  by_provider lists the exactly mapped spend of each provider.
    accounting: ``advertising.mapping_accounting`` of facts in the store's currency; spend: ``economics.compatible_spend``.
    """
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("mapping_class") == kind, F.col("spend"))), F.lit(0.0))
    exact = F.array_compact(F.array_sort(F.collect_list(F.when(F.col("mapping_class") == "EXACT", F.concat_ws(":", "provider", F.round("spend", 2).cast("decimal(20,2)"))))))
    sums = accounting.groupBy("period").agg(of("EXACT").alias("exact_spend"), of("SHARED").alias("shared_spend"), of("AMBIGUOUS").alias("ambiguous_spend"), F.array_join(exact, ",").alias("by_provider"))
    out = spend.join(sums, "period", "left").fillna(0.0, ["exact_spend", "shared_spend", "ambiguous_spend"]).fillna("", ["by_provider"])
    unmapped = F.when(F.col("spend").isNotNull(), F.greatest(F.lit(0.0), F.col("spend") - F.col("exact_spend") - F.col("shared_spend")))
    return out.withColumn("unmapped_spend", unmapped).withColumn("mapping_coverage", F.when(F.col("spend") > 0, F.col("exact_spend") / F.col("spend")))


def report(blended: DataFrame, drafts: DataFrame) -> DataFrame:
    """The overview, which must be there, beside how many recommendations of each severity there are, which may be none."""
    n = lambda v: F.count_if(F.col("severity") == v).alias(f"{v.lower()}_recommendations")
    counts = drafts.agg(n("CRITICAL"), n("HIGH"), n("MEDIUM"))
    return blended.select("period", "orders", "order_value", "spend", "mer").crossJoin(F.broadcast(counts))
