"""Keyed writes over Parquet tables: the table's new state as a frame, or a table in buckets of which a write touches only some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import top1_by


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key; of equal versions the change wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return top1_by(both, keys, [F.desc_nulls_last(version), F.desc("_new")]).drop("_new")


def delete_missing(current: DataFrame, returned: DataFrame, keys: list[str], scope) -> DataFrame:
    """Drops the rows in scope whose key did not come back; rows out of scope stay."""
    gone = current.where(scope).join(returned.select(*keys).distinct(), keys, "left_anti").select(*keys)
    return current.join(gone.withColumn("_gone", F.lit(True)), keys, "left").where(F.col("_gone").isNull() | ~F.coalesce(scope, F.lit(False))).drop("_gone")


def soft_delete_missing(current: DataFrame, returned: DataFrame, keys: list[str], now) -> DataFrame:
    """Marks rows absent from a full sync as deleted; rows that came back are live again."""
    seen = returned.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return current.join(seen, keys, "left").withColumn("deleted_at", F.when(F.col("_seen").isNull(), F.coalesce("deleted_at", now))).drop("_seen")


def replace_days(rows: DataFrame, path: str, day: str) -> None:
    """Writes whole days; days without rows here keep what they have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def with_snapshots(current: DataFrame, history: DataFrame, levels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stock levels as they came: the current ones replaced by newer, and all of them added to the history once.

    levels: keys and observed_at with the numbers.
    """
    seen = history.select(*keys, "observed_at")
    return upsert(current, levels, keys, "observed_at"), history.unionByName(levels.join(seen, [*keys, "observed_at"], "left_anti"))


def replaced_mappings(current: DataFrame, projected: DataFrame, ads: DataFrame) -> DataFrame:
    """Mappings of some ads replaced by new ones, all of which may be gone; other ads keep theirs."""
    return current.join(ads.select("ad_id").distinct(), "ad_id", "left_anti").unionByName(projected)


def dual_write(batch: DataFrame, native_path: str, canonical_path: str, hierarchy: DataFrame) -> None:
    """For foreachBatch: one batch as native rows and as canonical rows joined to the hierarchy, read once."""
    batch.persist()
    try:
        replace_days(batch, native_path, "date")
        replace_days(batch.join(hierarchy, "external_id").drop("external_id"), canonical_path, "date")
    finally:
        batch.unpersist()


class KeyedTable:
    """A table of rows under keys, in as many folders as ``buckets``; a row's folder follows from its key.

    A write reads and replaces only the folders that its keys fall into; the others keep their files.
    Folders are replaced as the job commits, so a lost executor or a repeated batch
    leaves the state before or after the write: of equal versions the change wins, and it is the same change.
    Give as many buckets as make folders of some hundred MB.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path, keys, version, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path).drop("_bucket")

    def _replace(self, rows: DataFrame) -> None:
        rows.repartition("_bucket").sortWithinPartitions("_bucket", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def _touched(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the buckets of the changes' keys by what ``change`` makes of their rows; emptied ones keep no rows but one empty file."""
        marked = changes.withColumn("_bucket", self._bucket()).persist()
        try:
            touched = [r[0] for r in marked.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            if not self.exists():
                now = marked.limit(0)
            else:
                now = self.spark.read.parquet(self.path).where(F.col("_bucket").isin(touched))
            left = change(now.drop("_bucket"), marked.drop("_bucket")).withColumn("_bucket", self._bucket()).persist()
            try:
                kept = {r[0] for r in left.select("_bucket").distinct().collect()}
                self._replace(left)
                for gone in set(touched) - kept:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bucket={gone}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            finally:
                left.unpersist()
        finally:
            marked.unpersist()

    def upsert(self, changes: DataFrame) -> None:
        """The latest version of each key, in the buckets of the changes."""
        self._touched(changes, lambda now, new: upsert(now, new, self.keys, self.version))

    def delete(self, keys: DataFrame) -> None:
        """Drops the rows of these keys."""
        self._touched(keys.select(*self.keys).distinct(), lambda now, gone: now.join(gone, self.keys, "left_anti"))

    def batches(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch's rows as changes; a batch that comes again changes nothing."""
        return lambda batch, _: self.upsert(batch)


def dual_upsert(native: KeyedTable, canonical: KeyedTable, project: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's rows into the native table, and what ``project`` makes of them into the canonical one.

    Both writes are repeated as one if either fails, and neither counts a row twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            native.upsert(batch)
            canonical.upsert(project(batch))
        finally:
            batch.unpersist()

    return write
