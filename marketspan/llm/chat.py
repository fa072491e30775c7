"""Chat formatting at token level.

A turn is ``### role: text</turn>`` and a line break.  Role and text are encoded
as separate segments; the marks between them are reserved ids above the
tokenizer's own, so no text can produce them.  Control strings inside role and
text (the marks, and the backslash that escapes) get a backslash before them;
dropping the backslash before any character reads the original back.  The loss
mask is a prefix sum of +1 where an assistant's text begins and -1 after it.

Rows of a conversation are ordered by turn, then role, then text (nulls
first); a null role or text is empty, repeated rows are repeated turns, a null
conv_id is a conversation of its own.  Each turn is one row of the output, with its
place in its conversation, so a conversation of any length is no large row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored
from .tokenization import cached_encoder, load_tokenizer, tokenizer_path

#: How the reserved marks are written in text, in the order of their ids after the vocabulary.
MARKS = ("### ", ": ", "</turn>\n")
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"\\|###|:|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

_TURNS = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("rank", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("loss_mask", T.BinaryType()))])


def escape(text: str) -> str:
    """Control strings with a backslash before them."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(roles: list[str], texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns' ids in a row, their loss mask, and where each turn ends."""
    encoder = cached_encoder(path, "space", True)
    first = load_tokenizer(path).get_vocab_size()
    marks = [np.array([first + k], "<u4") for k in range(len(MARKS))]
    heads = [np.frombuffer(x, "<u4") for x in encoder.encode([escape(r) for r in roles])]
    bodies = [np.frombuffer(x, "<u4") for x in encoder.encode([escape(t) for t in texts])]
    ids = np.concatenate([x for h, b in zip(heads, bodies) for x in (marks[0], h, marks[1], b, marks[2])] or [np.zeros(0, "<u4")])
    head_n, body_n = np.array([*map(len, heads)], int), np.array([*map(len, bodies)], int)
    ends = np.cumsum(head_n + body_n + 3)
    step = np.zeros(len(ids) + 1, np.int64)
    learned = np.array([r == LOSS_ROLE for r in roles], bool)
    np.add.at(step, (ends - 1 - body_n)[learned], 1)
    np.add.at(step, (ends - 1)[learned], -1)
    return ids, np.cumsum(step)[:-1].astype(np.uint8), ends


def format_conversations(turns: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, rank, n_tokens, ids, loss_mask): a row per turn, ids as little-endian unsigned 32-bit integers, a mask byte per id."""
    path = tokenizer_path(tokenizer)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    arrow = to_arrow_schema(_TURNS)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, mask, ends = assemble(part.column("role").to_pylist(), part.column("text").to_pylist(), path)
                begins = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), part.column("rank"), pa.array(ends - begins, pa.int64()), pa.array([ids[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary()), pa.array([mask[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())], schema=arrow)

    return ranked.mapInArrow(run, _TURNS)


class Reader:
    """Reads turns back from ids: the vocabulary's bytes, and the marks as they are written."""

    def __init__(self, path: str):
        chars = {chr(c): c for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        # byte-level vocabularies write the other bytes as the letters from U+0100
        chars |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in chars)}
        library = load_tokenizer(path)
        self.first = library.get_vocab_size()
        self.bytes = [b""] * self.first
        for token, i in library.get_vocab().items():
            self.bytes[i] = bytes(chars[c] for c in token)

    def text(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes[i] if i < self.first else MARKS[i - self.first].encode() for i in ids.tolist()]).decode()

    def turn(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of one turn's ids."""
        middle = int(np.flatnonzero(ids == self.first + 1)[0])
        return unescape(self.text(ids[1:middle])), unescape(self.text(ids[middle + 1 : -1]))


_DIGESTS = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("n_tokens", T.LongType()))])


def conversation_digests(formatted: DataFrame, *, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """What each conversation's output says, read back turn by turn in order; one conversation's state is a few hashes."""
    path = tokenizer_path(tokenizer)
    arrow = to_arrow_schema(_DIGESTS)
    none = object()

    def run(batches):
        reader, now, state, out = Reader(path), none, None, []

        def close():
            if state:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_mask"))):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8).astype(bool)
                role, text = reader.turn(ids)
                lost = unescape(reader.text(ids[mask]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(lost)
                state[3].update(lost.encode())
                state[4] += len(reader.text(ids))
                state[5] += len(ids)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), arrow)], schema=arrow)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), arrow)], schema=arrow)

    ordered = formatted.select("conv_id", "rank", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "rank")
    return ordered.mapInArrow(run, _DIGESTS)


def digests_of(turns: DataFrame, *, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Formats, writes the output to the shared folder, and reads it back."""
    return conversation_digests(stored(format_conversations(turns, tokenizer=tokenizer)), tokenizer=tokenizer)
