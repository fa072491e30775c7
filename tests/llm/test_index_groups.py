"""Round 4's finding on op8: an index is written and read a few segments at a time, however many a task makes."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marketspan.llm import common, decontamination


def test_a_task_holds_few_segments(spark, tmp_path, monkeypatch):
    """all segments of a task were one row group (160 MB of 40 segments), which the reader held at once."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}/index")
    monkeypatch.setattr(decontamination, "SEGMENT_CHARS", 200_000)
    monkeypatch.setattr(decontamination, "GROUP_BYTES", 400_000, raising=False)
    text = " ".join(f"w{x}" for x in np.random.default_rng(4).integers(0, 50_000, 35_000).tolist())
    docs = spark.range(8).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("first of "), F.col("id").cast("string"), F.lit(f" {text} last words")).alias("text"))
    items = spark.createDataFrame([("a", "last words"), ("b", "first of 3"), ("c", "of 9")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontamination.contamination(docs, items).collect()}
    assert got == {i: (35_005, 5 if i == 3 else 2, ["a", "b"] if i == 3 else ["a"]) for i in range(8)}
    files = [m for f in tmp_path.rglob("*.parquet") if (m := pq.read_metadata(f)).num_rows]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(files) == 1 and sum(groups) == 8 and max(groups) <= 4, groups
