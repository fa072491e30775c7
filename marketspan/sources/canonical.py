"""The canonical views of commerce, advertising and storefront facts over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import customer_segment, period_label

CURRENT, COMPARISON = ("1997-01-01", "1998-01-01"), ("1996-01-01", "1997-01-01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their place in the customer's history; status P stands for a cancelled order."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    out = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("demand_at"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"), (F.col("o_orderstatus") == "P").alias("is_cancelled"), F.row_number().over(w).alias("customer_order_index"))
    return out.withColumn("segment", customer_segment(F.col("customer_order_index"), F.col("order_id") % 7 != 0))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines; R is a full refund, A a half that was restocked."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    revenue = (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(20,4)")
    half, flag = F.floor(q / 2).cast("int"), F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("ad_id"), q.alias("quantity"), revenue.alias("revenue"),
        F.when(flag == "R", q).when(flag == "A", half).otherwise(0).alias("refunded_units"),
        F.when(flag == "A", half).otherwise(0).alias("restocked_units"),
        F.when(flag == "R", 0).otherwise(q).alias("current_quantity"),
        F.when(flag == "R", revenue).when(flag == "A", revenue * F.lit("0.5").cast("decimal(2,1)")).otherwise(0).cast("decimal(22,5)").alias("refund_value"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(20,4)").alias("discount"),
    )


def period_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of valid orders of both periods."""
    o = orders(spark, sf_dir).where("not is_cancelled").select("order_id", "demand_at").withColumn("period", period_label(F.to_date("demand_at"), CURRENT, COMPARISON)).where("period is not null")
    return lines(spark, sf_dir).join(o, "order_id")


def period_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid orders of both periods with units, refunds and discounts, which are summed before the join."""
    sums = lines(spark, sf_dir).groupBy("order_id").agg(F.sum("quantity").alias("units"), F.sum("refund_value").alias("refunds"), F.sum("discount").alias("discounts"))
    o = orders(spark, sf_dir).where("not is_cancelled").withColumn("period", period_label(F.to_date("demand_at"), CURRENT, COMPARISON)).where("period is not null")
    return o.join(sums, "order_id", "left").fillna({"units": 0}).withColumn("refunds", F.coalesce("refunds", F.lit(0))).withColumn("discounts", F.coalesce("discounts", F.lit(0)))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two validity ranges per product; from October 1997 on no cost is known for every third product."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    versions = F.array(
        F.struct(F.lit("1990-01-01").cast("timestamp_ntz").alias("effective_from"), F.lit("1996-07-01").cast("timestamp_ntz").alias("effective_until"), F.lit("0.4").cast("decimal(2,1)").alias("factor")),
        F.struct(F.lit("1996-07-01").cast("timestamp_ntz").alias("effective_from"), F.when(F.col("product_id") % 3 == 0, F.lit("1997-10-01").cast("timestamp_ntz")).alias("effective_until"), F.lit("0.5").cast("decimal(2,1)").alias("factor")),
    )
    return p.select("product_id", "price", F.inline(versions)).select("product_id", "effective_from", "effective_until", (F.col("price") * F.col("factor")).cast("decimal(20,3)").alias("unit_cost"))


def ad_daily(spark: SparkSession, sf_dir: str, current: tuple[str, str] = CURRENT, comparison: tuple[str, str] = COMPARISON) -> DataFrame:
    """A fact per ad and ship date; conversions are unknown where a line was returned with restock.

    The tables have no groups and creatives: a group stands for an ad's campaign and
    account balance sign, a creative for every third ad of a campaign.
    """
    li = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ad_id"), F.col("s_nationkey").alias("campaign_id"), (F.col("s_nationkey") * 2 + (F.col("s_acctbal") < 0).cast("int")).alias("group_id"), (F.col("s_nationkey") * 3 + F.col("s_suppkey") % 3).cast("long").alias("creative_id"))
    date = F.to_date("l_shipdate")
    facts = li.withColumn("period", period_label(date, current, comparison)).where("period is not null").groupBy(F.col("l_suppkey").alias("ad_id"), date.alias("date"), "period").agg(
        F.sum((F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(20,4)")).cast("decimal(24,4)").alias("spend"),
        F.sum(F.col("l_quantity").cast("long") * 100).alias("impressions"),
        F.count("*").alias("clicks"),
        F.when(F.max(F.col("l_returnflag") == "A") == F.lit(False), F.count("*")).alias("conversions"),
        F.when(F.max(F.col("l_returnflag") == "A") == F.lit(False), F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("decimal(24,2)").alias("conversion_value"),
        F.max(F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))).cast("long").alias("frequency"),
    )
    provider = F.when(F.col("campaign_id") % 3 == 0, "META").when(F.col("campaign_id") % 3 == 1, "GOOGLE").otherwise("TIKTOK")
    return facts.join(n, "ad_id").withColumn("provider", provider).withColumn("currency", F.when(F.col("campaign_id") % 2 == 0, "EUR").otherwise("USD")).withColumn("account_id", F.col("campaign_id") % 5).withColumn("level", F.when(F.col("provider") == "GOOGLE", "ACCOUNT").otherwise("AD"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads' products with a confidence; the products of every 97th number are confirmed.

    Only a part of an ad's products are its mappings, so that ads of all classes occur.
    """
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ad_id"), F.col("l_partkey").alias("product_id")).distinct()
    out = pairs.withColumn("confidence", ((F.col("product_id") * 7 + F.col("ad_id")) % 100) / 100.0).withColumn("is_merchant_confirmed", F.col("product_id") % 97 == 0)
    return out.where((F.col("product_id") + F.col("ad_id")) % F.when(F.col("ad_id") % 3 == 0, 7).otherwise(53) == 0)


#: Windows of storefront reads.
EVENTS_CURRENT, EVENTS_COMPARISON = ("2024-01-16", "2024-01-31"), ("2024-01-01", "2024-01-16")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storefront events; pages, products, collections, ads and orders are derived from the numbers in the table."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, kind, lit = F.col("k"), F.col("event_type"), F.lit
    name = F.when((kind == "view") & (k % 5 == 1), "COLLECTION_VIEW").when(kind == "view", "PRODUCT_VIEW").when((kind == "click") & (k % 3 == 0), "CART_VIEW").when(kind == "click", "ADD_TO_CART").when(kind == "signup", "BEGIN_CHECKOUT").when(kind == "purchase", "CHECKOUT_COMPLETED").otherwise("PAGE_VIEW")
    source = F.when(k % 4 == 0, "META").when(k % 4 == 1, "GOOGLE").when(k % 4 == 2, "DIRECT").otherwise("UNKNOWN")
    page = F.when(k % 5 == 0, "https://shop.example/").when(k % 5 == 1, F.concat(lit("https://shop.example/collections/c"), k % 3)).when(k % 5 == 2, F.concat(lit("https://shop.example/products/p"), k % 20)).when(k % 5 == 3, "https://shop.example/pages/about?x=1").otherwise(F.concat(lit("https://shop.example/account/"), k))
    return e.select(
        "event_id", F.col("ts").alias("event_at"), (F.col("ts") + F.make_dt_interval(lit(0), lit(0), (F.col("event_id") % 10).cast("int"))).alias("received_at"), F.col("user_id").alias("visitor_id"), name.alias("event_name"), source.alias("source"),
        F.when(name.isin("PRODUCT_VIEW", "ADD_TO_CART"), k % 20).alias("product_id"), page.alias("page_url"), F.when(name == "COLLECTION_VIEW", k % 3).alias("collection_id"), F.when(k % 8 == 0, k).alias("ad_id"), ((name == "CHECKOUT_COMPLETED") & (F.col("event_id") % 4 != 0)).alias("order_linked"), k.alias("k"),
    )


def storefront_order_lines(events: DataFrame) -> DataFrame:
    """(session_id, product_id) of the order that a session's last linked checkout made; the tables have no lines of these orders, so two products are derived."""
    at = F.struct("event_at", "event_id")
    last = events.where("order_linked").groupBy("session_id").agg(F.max_by("k", at).alias("k"))
    return last.select("session_id", F.explode(F.array_distinct(F.array(F.col("k") % 20, (F.col("k") + 7) % 20))).alias("product_id"))


def landing_signals(events: DataFrame) -> DataFrame:
    """Events as they would be with click ids, utm values and ids in their links, derived from the numbers in the table."""
    k, lit, none = F.col("k"), F.lit, F.lit(None).cast("string")
    named = lambda mark, n: F.when(k % n == 0, F.concat(lit(mark), k))
    of = lambda n, *x: F.get(F.array(*map(lit, x)), (k % n).cast("int"))
    return events.withColumns({
        "meta_click": named("m", 11), "tiktok_click": named("t", 13), "google_click": named("g", 17), "utm_source": of(6, "facebook", "google", "tiktok", "klaviyo"), "utm_medium": of(5, "cpc", "paid_social", "organic", "email"),
        "utm_campaign": F.concat(lit("c"), k % 3), "utm_content": none, "meta_campaign": none, "meta_group": none, "meta_ad": named("a", 8), "tiktok_campaign": none, "tiktok_group": none, "tiktok_ad": named("b", 19),
    })
