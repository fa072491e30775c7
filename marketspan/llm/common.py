"""What several operators share: word rules, the shared folder, Arrow loops, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task holds at once, in characters.
BLOCK_CHARS = 8_000_000
#: Every byte but lower-cased letters, digits and those of other alphabets becomes a space.
WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in bytes(range(256)).lower())

_BETWEEN = re.compile("[\x20\x09-\x0d]")


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def pieces_of(text: str, chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of about so many characters that cut a text only where an ASCII character stands that is in no word."""
    begin = 0
    while begin < len(text):
        cut = _BETWEEN.search(text, begin + chars)
        end = cut.end() if cut else len(text)
        yield begin, end
        begin = end


def alnum_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of ``alnum_words`` in lists of bounded size."""
    for begin, end in pieces_of(text) if text else ():
        yield alnum_words(text[begin:end])


def spaced_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return text.encode().split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    Only where driver and executors are one machine may the setting be missing; it is then set to a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *, group_bytes: int | None = None) -> DataFrame:
    """The rows as a table written to the shared folder: no later step depends on executors that made them.

    ``group_bytes`` is for rows of megabytes: a reader holds a file's row group at a time, and Parquet's
    writer else looks at a group's size from its hundredth row on, so a group is all that a task wrote.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and that no plan reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_rows(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def by_batch(f: Callable[[list, list], dict], schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text): f gets ids and texts of bounded size and gives the columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            made = f(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) for x in arrow], schema=arrow)

    return run


def blocks(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) lists of about so many characters, at least one row each; null texts stay None."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 0
            if size >= chars or len(ids) >= 20_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable, for each node of an edge.

    Large-star and small-star rounds turn the edges into stars around each
    component's smallest node.  A round is joins and map-side minima only; no
    adjacency list and no component is gathered anywhere, and each round's
    edges are a written table.  Self-links and repeats don't matter; edges with a null are dropped.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = stored(now.distinct())
    now = nodes.where("u <> v")
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, now = now, stored(small.select("e.*").where("u <> v").distinct())
        if seen is not None:  # the first round reads the nodes' table, which is still needed
            discard(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = nodes.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).union(alone)
    return found.groupBy("node").agg(F.min("root").alias("root"))
