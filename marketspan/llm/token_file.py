"""Token ids in directly addressable codes.

A shard holds the ids of consecutive documents.  Each id is split into chunks
of 8 bits; level k has chunk k of the ids that have more than k chunks, and a
bitmap that says which of them go on, with a rank directory over it.  Token i
is read by following the bitmaps' ranks through the levels, so any token is reached
without decoding its neighbours.  Shards lie in Parquet files, in ascending
doc_id order, so they can be kept in any store that Spark reads.

Nulls: a null text is empty and has only the end id.  A null doc_id sorts
first.  Repeated doc_ids are documents of their own, in order of their texts' hashes.
Texts are encoded whole; a task holds the ids of a shard, ``SHARD_TOKENS`` and one text more at most, and of a block of texts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from .common import blocks, shared_folder, stored, text_rows
from .tokenization import ENCODED_CHARS, cached_encoder, cut_of, tokenizer_path

#: Ids of a shard at least, but for the last of a task; bounds what a task holds.
SHARD_TOKENS = 2_000_000
_RANK_BITS = 512
_SHARD = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("shard", T.IntegerType()), ("n_tokens", T.LongType()), ("doc_ids", T.ArrayType(T.LongType())), ("doc_tokens", T.ArrayType(T.LongType())), ("codes", T.BinaryType()))])


def write_codes(ids: np.ndarray) -> bytes:
    """Levels of chunks: count, chunks, bitmap of those that go on, ranks before each 512 bits."""
    out, rest = [], ids.astype("<u4")
    while True:
        more = rest >= 256
        bitmap = np.packbits(more, bitorder="little").tobytes()
        bitmap += bytes(-len(bitmap) % (_RANK_BITS // 8))
        counts = np.bitwise_count(np.frombuffer(bitmap, "<u8")).reshape(-1, _RANK_BITS // 64).sum(1)
        ranks = (np.cumsum(counts) - counts).astype("<u4").tobytes()
        out += [struct.pack("<III", len(rest), len(bitmap), len(ranks)), (rest & 255).astype(np.uint8).tobytes(), bitmap, ranks]
        rest = rest[more] >> 8
        if not len(rest):
            return b"".join(out)


class Codes:
    """Reads one shard's codes in place."""

    def __init__(self, raw: bytes):
        self.levels, at = [], 0
        while at < len(raw):
            n, nb, nr = struct.unpack_from("<III", raw, at)
            at += 12
            self.levels.append((np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, nb, at + n), np.frombuffer(raw, "<u4", nr // 4, at + n + nb)))
            at += n + nb + nr

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _RANK_BITS
            before = bitmap[block * _RANK_BITS // 8 : (i >> 3) + 1].copy()
            before[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(before).sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        value = self.levels[0][0].astype("<u4")
        where = np.arange(len(value))
        for k in range(len(self.levels) - 1):
            n = len(self.levels[k][0])
            where = where[np.unpackbits(self.levels[k][1], bitorder="little")[:n].astype(bool)]
            value[where] |= self.levels[k + 1][0].astype("<u4") << (8 * (k + 1))
        return value


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Writes the shards of all documents, each with the end id, in ascending doc_id order."""
    file = tokenizer_path(tokenizer)
    arrow = to_arrow_schema(_SHARD)

    def run(batches):
        encoder, part, shard = cached_encoder(file, cut_of(file)), TaskContext.get().partitionId(), 0
        ids, sizes, held, n = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, shard, n, ids, sizes, write_codes(np.frombuffer(b"".join(held), "<u4"))), arrow)], schema=arrow)

        for names, texts in blocks(batches, ENCODED_CHARS):
            for name, raw in zip(names, encoder.encode([t or "" for t in texts])):
                ids.append(name)
                sizes.append(len(raw) // 4 + 1)
                held += [raw, end]
                n += sizes[-1]
                if n >= SHARD_TOKENS:
                    yield row()
                    ids, sizes, held, n, shard = [], [], [], 0, shard + 1
        encoder.forget()
        if ids:
            yield row()

    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    # rows of one doc_id are split by their texts' hashes: the sample from which ranges are made holds numbers, not texts
    digest = F.xxhash64("text")
    rows.repartitionByRange("doc_id", digest).sortWithinPartitions("doc_id", digest, "text").mapInArrow(run, _SHARD).write.parquet(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, n_tokens, base) of each shard, base being the ids in all shards before: prefix sums of the parts' totals, then within a part."""
    sizes = spark.read.schema(_SHARD).parquet(path).select("part", "shard", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("part_base"))  # a row per task that wrote
    inside = sizes.select("part", "shard", "n_tokens", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("inside"))
    return inside.join(parts, "part").select("part", "shard", "n_tokens", (F.col("part_base") + F.col("inside")).alias("base"))


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``base``."""
    # a written table: its size is known when the join is planned, so the shards aren't moved to meet a few numbers
    return spark.read.schema(_SHARD).parquet(path).join(stored(places(spark, path).drop("n_tokens")), ["part", "shard"])


_DOC = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    arrow = to_arrow_schema(_DOC)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = Codes(row["codes"]).all().tobytes()
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row["doc_ids"], row["base"] + ends - sizes, sizes, crc)], schema=arrow)

    return shards(spark, path).select("doc_ids", "doc_tokens", "codes", "base").mapInArrow(run, _DOC)


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at a global position: the small columns say which shard has it, only that one's codes are read, and one token in it."""
    at = places(spark, path).where((F.col("base") <= position) & (F.col("base") + F.col("n_tokens") > position)).first()
    if at is None:
        return None
    row = spark.read.schema(_SHARD).parquet(path).where((F.col("part") == at["part"]) & (F.col("shard") == at["shard"])).select("codes").first()
    return Codes(bytes(row["codes"]))[position - at["base"]]


def written_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes the files to the shared folder and reads every document back."""
    path = shared_folder(docs.sparkSession)
    write_token_files(docs, path, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id)
    return read_documents(docs.sparkSession, path)
