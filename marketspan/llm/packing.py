"""Concatenate and cut: documents' ids in one stream, cut into sequences.

First pass: each task encodes its documents, notes each document's start within
its partition, and the rows are written.  Second pass: prefix sums over the
partitions' totals give every document its global start; fixed windows of
``length`` ids then cut it into pieces.  A piece is a boundary record: which
ids of which document lie where in which sequence.  Only the last sequence can
have fewer ids; it is padded to ``length`` unless its size is a power of two.

Nulls: a null text is empty and has only the end id; a null doc_id and repeated
rows are documents like others.  Texts are encoded whole; a task holds the ids of about
four million characters at a time, or of one text if it is longer.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from .common import blocks, stored, text_rows
from .tokenization import ENCODED_CHARS, cached_encoder, cut_of, tokenizer_path

_ENCODED = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("doc_id", T.LongType()), ("inside", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()))])
_PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def encoded(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """First pass: a row per document with its ids (16-bit if the vocabulary allows) and its start within its partition."""
    file = tokenizer_path(tokenizer)
    arrow = to_arrow_schema(_ENCODED)

    def run(batches):
        encoder, part, inside = cached_encoder(file, cut_of(file)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        kind = id_type(encoder.library.get_vocab_size())
        for names, texts in blocks(batches, ENCODED_CHARS):
            ids = [np.append(np.frombuffer(raw, "<u4"), end) for raw in encoder.encode([t or "" for t in texts])]
            sizes = np.array([*map(len, ids)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(names, pa.int64()), pa.array(inside + np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], schema=arrow)
            inside += int(sizes.sum())
        encoder.forget()

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(run, _ENCODED)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 65536 else "<u4"


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, length: int = 2048) -> DataFrame:
    """The boundary records, with ``sequence_tokens`` and ``padded_tokens`` of the piece's sequence."""
    rows = stored(encoded(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    # a written table: its size is known when the join is planned, so the documents aren't moved to meet a few numbers
    bases = stored(totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base")))
    file = tokenizer_path(tokenizer)
    arrow = to_arrow_schema(_PIECES)

    def run(batches):
        from .tokenization import load_tokenizer

        size = np.dtype(id_type(load_tokenizer(file).get_vocab_size())).itemsize
        for batch in batches:
            columns: list[list] = [[] for _ in arrow]
            for doc, at, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n_tokens", "ids"))):
                wide = np.frombuffer(raw, f"<u{size}").astype("<u4").tobytes()
                begin = 0
                while begin < n:
                    offset = (at + begin) % length
                    end = min(n, begin + length - offset)
                    for column, x in zip(columns, (doc, begin, end - begin, zlib.crc32(wide[4 * begin : 4 * end]), n, (at + begin) // length, offset)):
                        column.append(x)
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    pieces = rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("inside")).alias("at"), "n_tokens", "ids").mapInArrow(run, _PIECES)
    total = totals.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("tokens")).first()["tokens"]
    full, rest = divmod(total, length)
    filled = F.when(F.col("sequence_id") < full, length).otherwise(rest)
    padded = rest if rest & (rest - 1) == 0 else length
    return pieces.withColumn("sequence_tokens", filled.cast("long")).withColumn("padded_tokens", F.when(F.col("sequence_id") < full, length).otherwise(padded).cast("long"))
