"""A training corpus from raw documents, in four stages.

Quality rules drop documents; of each group of near duplicates the row with the
smallest doc_id stays; documents that hold benchmark passages go; the rest is
packed into sequences.  Each stage is written before the next reads it.

A row is a document, with or without a doc_id: several texts of one doc_id are
judged one by one, and of identical rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspan.llm import decontamination, near_duplicates, packing, quality
from marketspan.llm.common import discard, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = stored(near_duplicates.near_duplicate_groups(docs, shingle=5, similarity=0.8))
    keys = ["doc_id", "text_hash"]
    gone = stored(groups.where("not is_first").select(*keys).distinct().withColumn("gone", F.lit(True)))
    repeated = stored(groups.where("is_first").groupBy(*keys).count().where("count > 1").select(*keys, F.lit(False).alias("gone")))
    discard(groups)
    # rows that surely are of neither kind stay where they are, so their texts aren't moved
    doubtful = stored(gone.unionAll(repeated))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), near_duplicates.text_hash().alias("text_hash"))
    rows = rows.withColumn("maybe", near_duplicates.KeyFilter(doubtful).column(F.col("doc_id"), F.col("text_hash")))
    known = doubtful.select(F.struct(*keys).alias("other"), "gone")
    met = rows.where("maybe").join(known, F.struct(*keys).eqNullSafe(F.col("other")), "left")
    kept = met.where("gone is null").select("row").unionAll(met.where("not gone").dropDuplicates(keys).select("row"))
    return rows.where("not maybe").select("row").unionAll(kept).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text holds a benchmark passage; rows are told apart by 64 bits of doc_id and text."""
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"), F.col("text").alias("text"))
    found = decontamination.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key", window=10)
    hit = stored(found.where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct())
    return keyed.join(hit, "key", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer="word_bpe_49k.json", end_id=1, length=2048)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL can't express suffix arrays, fingerprints or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
