"""Which products a provider's catalog items and ads stand for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import safe_div
from ..functions.web import normalized_text
from . import textindex


def compatible_form(c: Column) -> Column:
    """Unicode's compatibility form; no built-in function gives it, so texts pass through Python in batches."""

    @F.pandas_udf(T.StringType())
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return form(c)


def product_handle(url: Column) -> Column:
    """The handle of a product page; null for other pages."""
    found = F.regexp_extract(url, r"^[^:]+://[^/?#]*(?:/[^?#]*)?/products/([^/?#]+)", 1)
    return F.when(found != "", found)


def _counted(items: DataFrame, candidates: DataFrame, on: Column, name: str) -> DataFrame:
    """By item: its candidates among variants, those that agree with the item's hints, and one of them."""
    i, v = items.alias("i"), candidates.alias("v")
    hint = lambda c: F.col(f"i.{c}").isNull() | (F.lower(f"i.{c}") == F.lower(f"v.{c}"))
    fits = F.coalesce(hint("color") & hint("size"), F.lit(False))
    met = i.join(v, on).groupBy("i.item_id").agg(F.count_distinct("v.variant_id").alias(f"{name}_all"), F.count_distinct(F.when(fits, F.col("v.variant_id"))).alias(f"{name}_fit"), F.min("v.variant_id").alias(f"{name}_any"), F.min(F.when(fits, F.col("v.variant_id"))).alias(f"{name}_one"))
    return met


def resolve_catalog_items(items: DataFrame, variants: DataFrame) -> DataFrame:
    """(item_id, state, source, confidence, variant_id): the surest evidence decides.

    A retailer id names a variant (1.0), else the url's variant (1.0), its
    product's only variant or the one that the item's options leave (.99, .95 for
    several), else the product group (.95, .9).  What names several variants and
    can't be narrowed is AMBIGUOUS.  Each step is one equi-join that counts candidates.

    items: (item_id, retailer_id, url, group_id, color, size); variants: (variant_id, sku, product_id, handle, color, size).
    """
    rows = items.withColumn("_handle", product_handle(F.col("url"))).withColumn("_token", F.regexp_extract("url", r"[?&]variant=([^&#]*)", 1))
    tokens = variants.select("variant_id", F.explode(F.array_distinct(F.array("sku", F.col("variant_id").cast("string")))).alias("_t"))
    by_id = rows.join(tokens, F.col("retailer_id") == F.col("_t")).groupBy("item_id").agg(F.count_distinct("variant_id").alias("id_all"), F.min("variant_id").alias("id_any"))
    exact = rows.where("_token <> ''").alias("i").join(variants.alias("v"), (F.col("i._handle") == F.col("v.handle")) & ((F.col("i._token") == F.col("v.variant_id").cast("string")) | (F.col("i._token") == F.col("v.sku")))).groupBy("i.item_id").agg(F.count_distinct("v.variant_id").alias("url_exact"), F.min("v.variant_id").alias("url_variant"))
    by_url = _counted(rows, variants, F.col("i._handle") == F.col("v.handle"), "url")
    by_group = _counted(rows, variants, F.col("i.group_id") == F.col("v.product_id").cast("string"), "group")
    out = rows.join(by_id, "item_id", "left").join(exact, "item_id", "left").join(by_url, "item_id", "left").join(by_group, "item_id", "left")
    c, hinted = F.col, F.col("color").isNotNull() | F.col("size").isNotNull()

    def found(state: str, source: str | None, confidence: float, variant: Column | None = None) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(source).cast("string").alias("source"), F.lit(confidence).alias("confidence"), (F.lit(None) if variant is None else variant).cast("long").alias("variant_id"))

    ambiguous = found("AMBIGUOUS", None, 0.0)
    best = (
        F.when(c("id_all") == 1, found("MAPPED", "RETAILER_ID_SKU", 1.0, c("id_any")))
        .when(c("id_all") > 1, ambiguous)
        .when(c("url_exact") == 1, found("MAPPED", "URL", 1.0, c("url_variant")))
        .when(c("url_exact") > 1, ambiguous)
        .when(c("url_fit") == 1, found("MAPPED", "URL", 0.99, c("url_one")))
        .when((c("url_fit") > 1) & hinted, found("MAPPED", "URL", 0.95))
        .when(c("url_all") == 1, found("MAPPED", "URL", 0.95, c("url_any")))
        .when(c("group_fit") == 1, found("MAPPED", "PRODUCT_GROUP", 0.95, c("group_one")))
        .when((c("group_fit") > 1) & hinted, found("MAPPED", "PRODUCT_GROUP", 0.9))
        .when(c("group_all") == 1, found("MAPPED", "PRODUCT_GROUP", 0.9, c("group_any")))
        .when(c("group_all") > 1, ambiguous)
        .otherwise(found("UNMAPPED", None, 0.0))
    )
    return out.select("item_id", best.alias("_b")).select("item_id", "_b.*")


#: How an ad's target is known -> the confidence, the surest first.  Fixed values.
TARGET_SOURCES = {"STRUCTURED_ID": 1.0, "URL_VARIANT": 1.0, "URL_PRODUCT": 0.98, "TAG_VARIANT": 0.99, "TAG_PRODUCT": 0.95, "PRODUCT_SET": 0.95, "COLLECTION": 0.95, "STORE": 0.9}


def resolve_ads(ads: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each ad's target by the first kind of evidence that it has; several targets of that kind are a target of several products.

    evidence: (ad_id, source, target_id), source one of TARGET_SOURCES; ads without any are UNKNOWN.
    """
    order = F.create_map(*[F.lit(x) for k, s in enumerate(TARGET_SOURCES) for x in (s, k)])
    sure = F.create_map(*[F.lit(x) for pair in TARGET_SOURCES.items() for x in pair])
    ranked = evidence.withColumn("_k", order[F.col("source")])
    first = ranked.groupBy("ad_id").agg(F.min("_k").alias("_k"))
    targets = ranked.join(first, ["ad_id", "_k"]).groupBy("ad_id", "source").agg(F.count_distinct("target_id").alias("targets"), F.min("target_id").alias("_one"))
    scope = F.when(F.col("source").isNull(), "UNKNOWN").when(F.col("source").isin("COLLECTION", "STORE"), F.col("source")).when(F.col("targets") > 1, "MULTI_PRODUCT").otherwise("PRODUCT")
    out = ads.select("ad_id").join(targets, "ad_id", "left")
    return out.select("ad_id", scope.alias("target_scope"), "source", F.coalesce(sure[F.col("source")], F.lit(0.0)).alias("confidence"), F.when(F.col("targets") == 1, F.col("_one")).alias("target_id"), F.coalesce("targets", F.lit(0)).alias("targets"))


def text_suggestions(ads: DataFrame, titles: DataFrame, most: int = 5) -> DataFrame:
    """Titles that one of an ad's texts is (.75) or contains (.65), the surest ``most``, titles of 4 characters and more.

    Containment is looked up by a title's rarest run of three characters (``textindex``) and
    then compared, so no title meets all texts.  ads: (ad_id, text), a row per text; titles: (title).
    """
    text = ads.select("ad_id", normalized_text(F.col("text")).alias("text")).where("text <> ''").distinct()
    named = titles.select("title", normalized_text(F.col("title")).alias("name")).where("length(name) >= 4").distinct()
    met = textindex.contained(named.select("name").distinct(), text.select("text").distinct(), needle="name", text="text")
    scored = met.join(named, "name").join(text, "text").groupBy("ad_id", "title").agg(F.max(F.when(F.col("text") == F.col("name"), 0.75).otherwise(0.65)).alias("confidence"))
    w = Window.partitionBy("ad_id").orderBy(F.desc("confidence"), "title")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def pixel_mappings(evidence: DataFrame, mappings: DataFrame) -> DataFrame:
    """Products that an ad's sessions deal with, as suggestions of a confidence that never reaches an automatic mapping's.

    From 5 sessions on of which 60 percent view the product.  What a mapping says
    already is only supported; a confirmed mapping to another product is a conflict;
    several such products are a possible shared scope.  evidence: ``storefront.target_evidence``.
    """
    sums = evidence.groupBy("ad_id", "product_id").agg(F.sum("interacted_sessions").alias("sessions"), F.sum("viewed_sessions").alias("viewed_sessions"), F.sum("purchase_sessions").alias("purchase_sessions"))
    out = sums.withColumn("view_rate", safe_div(F.col("viewed_sessions"), F.col("sessions")))
    eligible = (F.col("sessions") >= 5) & (F.col("view_rate") >= 0.6)
    rivals = out.where(eligible).groupBy("ad_id").agg(F.count("*").alias("_eligible"))
    own = mappings.select("ad_id", "product_id").distinct().withColumn("_same", F.lit(True))
    confirmed = mappings.where("is_merchant_confirmed").select("ad_id").distinct().withColumn("_confirmed", F.lit(True))
    out = out.join(rivals, "ad_id", "left").join(own, ["ad_id", "product_id"], "left").join(confirmed, "ad_id", "left")
    confidence = F.least(F.lit(0.69), F.lit(0.45) + F.least(F.col("sessions") / 20.0, F.lit(1.0)) * 0.12 + F.col("view_rate") * 0.08 + F.least(F.col("purchase_sessions") / F.col("sessions") * 2, F.lit(1.0)) * 0.04)
    status = F.when(F.col("_same"), "SUPPORTS_EXISTING").when(F.col("_confirmed"), "CONFLICTS_WITH_MERCHANT_MAPPING").when(eligible & (F.col("_eligible") > 1), "POSSIBLE_SHARED_SCOPE").when(eligible, "REVIEW_SUGGESTION").otherwise("INSUFFICIENT_EVIDENCE")
    return out.select("ad_id", "product_id", "sessions", "viewed_sessions", "view_rate", status.alias("status"), F.when(eligible, confidence).alias("confidence"))


def options_current(mappings: DataFrame, variants: DataFrame) -> DataFrame:
    """Mappings by options that are still valid: any variant of the product has all of them.

    mappings: (mapping_id, product_id, options map); variants: (product_id, options map).
    """
    m, v = mappings.alias("m"), variants.alias("v")
    fits = F.forall(F.map_entries("m.options"), lambda e: F.coalesce(F.try_element_at(F.col("v.options"), e["key"]) == e["value"], F.lit(False)))
    valid = m.join(v, F.col("m.product_id") == F.col("v.product_id")).where(fits).select("m.mapping_id").distinct().withColumn("_ok", F.lit(True))
    return mappings.join(valid, "mapping_id", "left").withColumn("is_current", F.coalesce("_ok", F.lit(False))).drop("_ok")


#: Keys under which providers name products and variants.  Fixed values.
PROVIDER_ID_KEYS = ("item_id", "item_ids", "product_id", "product_ids", "retailer_id", "sku", "sku_id")


def provider_ids(rows: DataFrame, column: str, keys: tuple[str, ...] = PROVIDER_ID_KEYS, depth: int = 24) -> DataFrame:
    """Rows with ``ids``: the texts and numbers under one of the keys, or in a list under it, at any depth of a JSON column.

    The parsed value is walked level by level as an array of the row's own, each level made of the
    one above, so text inside a value is never taken for a key, and no rows are gathered by text:
    a task holds one row's values at a time.  Keys are
    compared without case.  Null for a null or malformed text, empty without any id; a
    value nested deeper than ``depth`` stops the job instead of losing ids.
    """
    none, element = F.lit(None).cast("string"), "struct<v:variant,key:string,listed:boolean>"
    row = lambda v, key, listed: F.struct(v.alias("v"), key.alias("key"), listed.alias("listed"))

    def below(x):
        # what stands in a list under a key is under that key; a list in a list is under none
        items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v: row(v, F.when(~x["listed"], x["key"]), F.lit(True)))
        fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: row(e["value"], F.lower(e["key"]), F.lit(False)))
        inside = F.coalesce(items, fields)
        return F.when(F.size(inside) > 0, inside).otherwise(F.array(x)).cast(f"array<{element}>")

    def own(x):
        text, kind = F.trim(F.try_variant_get(x["v"], "$", "string")), F.schema_of_variant(x["v"])
        filled = kind.rlike("^(ARRAY|OBJECT)") & ~text.isin("[]", "{}")
        named = F.when(x["key"].isin(*keys) & kind.rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)") & (text != ""), text)
        return F.when(filled, F.raise_error(F.lit(f"JSON deeper than {depth} levels")).cast("string")).otherwise(named)

    level = F.array(row(F.col("_parsed"), none, F.lit(False))).cast(f"array<{element}>")
    for _ in range(depth):
        level = F.flatten(F.transform(level, below))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(level, own))))
    # a small file is read by one task, but a walk is worth several
    dealt = rows.withColumn("_deal", F.monotonically_increasing_id()).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "_deal")
    return dealt.withColumn("_parsed", F.try_parse_json(column)).select(*rows.columns, F.when(F.col("_parsed").isNotNull(), ids).alias("ids"))
