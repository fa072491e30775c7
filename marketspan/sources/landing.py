"""Files that providers' exports land in, as typed frames.

Fetching them over HTTP is left to whatever fills the folder; retries, paging and limits are not a query's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bulk_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children of a bulk export, one object a line; a malformed line is an error.  The schema needs ``__parentId``."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.where("__parentId is null").drop("__parentId"), rows.where("__parentId is not null")


def recordset(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of a JSON array column as a typed relation; payloads that aren't arrays give none."""
    return payloads.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def since(rows: DataFrame, updated_at: str, watermark: Column, overlap_hours: int = 24) -> DataFrame:
    """Rows changed since a watermark, with an overlap in which changes may have been missed; an upsert takes them again."""
    return rows.where(F.col(updated_at) >= watermark - F.make_dt_interval(F.lit(0), F.lit(overlap_hours)))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Parents with an array of their children in order; empty without any."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in children.columns if c not in (key, order)]))).alias(name))
    return parents.join(rows, key, "left")


def micros(c: Column) -> Column:
    """Millionths as a decimal amount."""
    return (c.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)")


def metric_value(c: Column) -> Column:
    """The number in a JSON scalar, in an object's ``value``, or summed over an array of either; null without any."""
    listed = F.from_json(F.when(c.startswith("["), c), "array<string>")
    one = lambda x: F.coalesce(F.get_json_object(x, "$.value"), x).try_cast("double")
    total = F.aggregate(F.filter(F.transform(listed, one), lambda x: x.isNotNull()), F.lit(None).cast("double"), lambda a, x: F.coalesce(a, F.lit(0.0)) + x)
    return F.when(c.startswith("["), total).otherwise(one(F.trim(c, F.lit('"'))))


def insight_key(*columns: Column) -> Column:
    """A stable key of what identifies an insight."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def canonical_projection(native: DataFrame, names: dict[str, str], extras: list[str]) -> DataFrame:
    """Native rows under canonical names; other columns go into ``provider_metrics`` as JSON without nulls."""
    return native.select(*[F.col(a).alias(b) for a, b in names.items()], F.to_json(F.struct(*extras)).alias("provider_metrics"))
