"""Language-model scores from a hidden Markov model.

Baum-Welch trains latent states in rounds.  In all rounds but the last, states
emit word classes: a word's class is its hash into ``classes`` classes, so what is
sent to every task has a fixed size.  The last round sums the expected counts by
word, across partitions, into a table that grows with the corpus and is joined
to each block's own words, never collected: P(word | state) is the word's smoothed
share of all tokens, times how much more the state emits it than its share of
all tokens lets expect.  A word that no training text has keeps one
smoothed share in every state.  The states' sums are made 1 over all words.
The parts of a word's tokens that fall to each state travel as fractions of 60
bits in all, to move little; sums and probabilities are those of these fractions.

Texts are written once as blocks: a block has its own vocabulary and its
documents as positions in it.  Each task runs the scaled forward-backward
recursion over its blocks' training texts, whole: a group of sequences is gone
through in stretches of ``HELD_TOKENS``, the forward values at their ends are kept, and
the stretches are redone backwards with the backward values carried along.  Scores come
from the scaled forward recursion over whole texts.

Nulls: a null text is empty and has only the end token.  A null doc_id counts as
the text "null" in the choice of training texts; repeated rows are texts of their own.
Texts are read whole, long ones piece by piece; a task holds a block's tokens as
32-bit numbers, of ``BLOCK_CHARS`` characters or of one text if it is longer.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.taskcontext import TaskContext

from .common import blocks, pieces_of, stored, text_rows
from .simhash import _LOWER

#: The end token in vocabularies; no word is empty.
END = b""
BLOCK_CHARS = 16_000_000
#: Tokens whose forward and backward values a task holds at a time.
HELD_TOKENS = 1_000_000

_BLOCK = T.StructType([T.StructField(n, t) for n, t in (("block", T.LongType()), ("doc_ids", T.ArrayType(T.LongType())), ("held_out", T.ArrayType(T.BooleanType())), ("doc_tokens", T.ArrayType(T.LongType())), ("tokens", T.BinaryType()), ("classes", T.BinaryType()), ("words", T.ArrayType(T.BinaryType())), ("counts", T.ArrayType(T.LongType())))])


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def word_class(word: bytes, classes: int) -> int:
    return xxhash.xxh64_intdigest(word, 7) % classes


def encode_blocks(docs: DataFrame, *, id_col: str, text_col: str, classes: int) -> DataFrame:
    """Blocks of documents with their own vocabulary, its classes, and its counts in training texts."""
    arrow = to_arrow_schema(_BLOCK)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(1).compress
        for ids, texts in blocks(batches, BLOCK_CHARS):
            known: dict[bytes, int] = defaultdict(count().__next__)
            known[END]
            held = [held_out(i) for i in ids]
            tokens, sizes = [], []
            for t in texts:
                n = 1
                for begin, end in pieces_of(t) if t else ():
                    words = t[begin:end].translate(_LOWER).encode().split()
                    tokens.append(np.fromiter(map(known.__getitem__, words), "<u4", len(words)))
                    n += len(words)
                tokens.append(np.zeros(1, "<u4"))
                sizes.append(n)
            sizes = np.array(sizes, np.int64)
            flat = np.concatenate(tokens)
            counts = np.bincount(flat[~np.repeat(held, sizes)], minlength=len(known))
            of = np.fromiter((word_class(w, classes) for w in known), "<u4", len(known))
            row = (block, ids, held, sizes, pack(flat.tobytes()), of.tobytes(), list(known), counts)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)
            block += 1

    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(run, _BLOCK)


class Model:
    """Initial, transition and emission probabilities; emit has a row per symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, totals: np.ndarray, states: int) -> "Model":
        """The classes' shares, tilted for each state by a fixed rule; states tend to stay."""
        classes = np.arange(len(totals))[:, None]
        tilt = 1 + 0.5 * np.sin((classes + 1) * (np.arange(states)[None, :] + 1) * 12.9898)
        emit = (totals[:, None] + 1e-3) * tilt
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def of_words(self, of: np.ndarray) -> "Model":
        """The model over a block's words: each is emitted as its class is."""
        return Model(self.start, self.move, self.emit[of])

    def steps(self, seqs: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Sequences side by side, longest first: their order, all symbols step by step, how many run at each step, and where its symbols begin."""
        order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
        sizes = np.array([len(seqs[k]) for k in order])
        flat = np.concatenate([seqs[k] for k in order])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        running = np.bincount(step)
        return order, flat[np.argsort(step, kind="stable")], running, np.concatenate(([0], np.cumsum(running)))

    def log10_probabilities(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion over whole sequences of symbols."""
        order, symbols, running, begins = self.steps(seqs)
        emitted = self.emit[symbols]
        total, alpha = np.zeros(len(seqs)), None
        for n, i in zip(running.tolist(), begins.tolist()):
            alpha = (self.start if alpha is None else alpha[:n] @ self.move) * emitted[i : i + n]
            scale = alpha.sum(1)
            total[:n] += np.log10(scale)
            alpha /= scale[:, None]
        out = np.zeros(len(seqs))
        out[order] = total
        return out

    def expected(self, seqs: list[np.ndarray], emit: np.ndarray, move: np.ndarray, start: np.ndarray, held: int = HELD_TOKENS) -> float:
        """Adds the expected counts of whole sequences, by forward and backward recursion; gives their log10 probability.

        Forward values are held for stretches of about ``held`` tokens; of all others only those at a stretch's end.
        """
        _, symbols, running, begins = self.steps(seqs)
        cuts = [0]
        for t in range(len(running)):
            if begins[t + 1] - begins[cuts[-1]] >= held or t + 1 == len(running):
                cuts.append(t + 1)

        def forward(first: int, end: int, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Emissions, scaled forward values and scales of a stretch's tokens, step by step."""
            lo = begins[first]
            emitted = self.emit[symbols[lo : begins[end]]]
            alphas, scales = np.empty_like(emitted), np.empty(len(emitted))
            for n, i in zip(running[first:end].tolist(), (begins[first:end] - lo).tolist()):
                x = (self.start if alpha is None else alpha[:n] @ self.move) * emitted[i : i + n]
                scale = x.sum(1)
                scales[i : i + n] = scale
                alpha = alphas[i : i + n]
                np.divide(x, scale[:, None], out=alpha)
            return emitted, alphas, scales

        before: list[np.ndarray | None] = [None]
        for first, end in zip(cuts[:-2], cuts[1:-1]):
            before.append(forward(first, end, before[-1])[1][-running[end - 1] :].copy())
        total, beta = 0.0, np.ones((0, len(self.start)))
        for first, end, entry in reversed([*zip(cuts[:-1], cuts[1:], before)]):
            emitted, alphas, scales = forward(first, end, entry)
            total += float(np.log10(scales).sum())
            weight = emitted / scales[:, None]
            betas, backs = np.empty_like(alphas), np.empty_like(alphas)
            lo, turned = begins[first], np.ascontiguousarray(self.move.T)
            for n, i in zip(running[first:end][::-1].tolist(), (begins[first:end] - lo)[::-1].tolist()):
                if len(beta) < n:
                    beta = np.concatenate((beta, np.ones((n - len(beta), len(self.start)))))
                betas[i : i + n] = beta
                back = backs[i : i + n]
                np.multiply(weight[i : i + n], beta, out=back)
                beta = back @ turned
            gamma = alphas * betas
            gamma /= gamma.sum(1, keepdims=True)
            n = int(running[first])
            if entry is None:
                start += gamma[:n].sum(0)
            else:
                move += self.move * (entry[:n].T @ backs[:n])
            # each later token's place in the step before it
            previous = np.arange(n, len(alphas)) - np.repeat(running[first : end - 1], running[first + 1 : end])
            move += self.move * (alphas[previous].T @ backs[n:])
            at = symbols[lo : begins[end]]
            for k in range(emit.shape[1]):
                emit[:, k] += np.bincount(at, gamma[:, k], len(emit))
        return total


def _groups(seqs: list[np.ndarray], held: int = HELD_TOKENS):
    """Runs of sequences of like length, of bounded tokens."""
    part, n = [], 0
    for k in sorted(range(len(seqs)), key=lambda k: -len(seqs[k])):
        part.append(k)
        n += len(seqs[k])
        if n >= held:
            yield part
            part, n = [], 0
    if part:
        yield part


def _documents(row: dict) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), "<u4")
    return np.split(flat, np.cumsum(row["doc_tokens"])[:-1])


def word_counts(row: dict, model: Model, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Expected counts by word and state of a block's training texts; adds those of transitions and starts."""
    local = model.of_words(np.frombuffer(row["classes"], "<u4"))
    by_word = np.zeros(local.emit.shape)
    seqs = [d for d, h in zip(_documents(row), row["held_out"]) if not h]
    for part in _groups(seqs):
        local.expected([seqs[k] for k in part], by_word, move, start)
    return by_word


def _renewed(move: np.ndarray, start: np.ndarray, emit: np.ndarray) -> Model:
    return Model((start + 0.5) / (start + 0.5).sum(), (move + 0.5) / (move + 0.5).sum(1, keepdims=True), emit)


def _split(number: np.ndarray, table: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and starts, which travel as numbers below 0."""
    move, start = np.zeros((states, states)), np.zeros(states)
    for n, x in zip(number, table):
        if n >= -states:
            move[-1 - n] = x
        else:
            start = x
    return move, start


def train(rows: DataFrame, totals: np.ndarray, *, states: int, rounds: int, smoothing: float) -> Model:
    """Baum-Welch rounds over classes; a round's counts are summed by class across all tasks."""
    model = Model.first(totals, states)
    spark, classes = rows.sparkSession, len(totals)
    schema = ", ".join(["class int", *(f"s{k} double" for k in range(states))])
    trained = rows.select("held_out", "doc_tokens", "tokens", "classes")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def counted(batches, sent=sent):
            emit, move, start = np.zeros((classes, states)), np.zeros((states, states)), np.zeros(states)
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    by_word = word_counts(row, sent.value, move, start)
                    of = np.frombuffer(row["classes"], "<u4")
                    for s in range(states):
                        emit[:, s] += np.bincount(of, by_word[:, s], classes)
            used = np.flatnonzero(emit.sum(1))
            table = np.concatenate((emit[used], move, start[None, :]))
            number = np.concatenate((used, -1 - np.arange(states), [-1 - states])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(number), *(pa.array(table[:, k].copy()) for k in range(states))], names=["class", *(f"s{k}" for k in range(states))])

        summed = trained.mapInArrow(counted, schema).groupBy("class").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).toPandas()  # at most classes + states + 1 rows
        number, table = summed["class"].to_numpy(), summed.drop(columns="class").to_numpy()
        emit = np.zeros((classes, states))
        emit[number[number >= 0]] = table[number >= 0]
        # a class seen rarely, or never, is shared out as the states are
        share = emit.sum(0) + 1e-9
        emit += smoothing * share / share.sum()
        model = _renewed(*_split(number[number < 0], table[number < 0], states), emit / emit.sum(0))
        sent.unpersist()
    return model


def _bits(states: int) -> int:
    """Bits of a fraction, so that one per state fits in a long."""
    return 60 // states


def packed(fractions: np.ndarray) -> np.ndarray:
    """A row of fractions as one long."""
    n, bits = fractions.shape[1], _bits(fractions.shape[1])
    whole = np.rint(fractions * ((1 << bits) - 1)).astype(np.int64)
    return (whole << (bits * np.arange(n))).sum(1)


def unpacked(values: np.ndarray, states: int) -> np.ndarray:
    bits = _bits(states)
    return (values[:, None] >> (bits * np.arange(states)) & ((1 << bits) - 1)) / ((1 << bits) - 1)


def _fraction(column: str, k: int, states: int) -> Column:
    bits = _bits(states)
    return F.shiftright(F.col(column), bits * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("double") / F.lit(float((1 << bits) - 1))


def word_table(rows: DataFrame, model: Model, *, states: int) -> DataFrame:
    """(word, c, s0, s1, ...): each training word's count and its expected count by state, summed over all blocks."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType()), T.StructField("parts", T.LongType())])
    arrow = to_arrow_schema(schema)

    def counts_of(batches):
        move, start = np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).select(["held_out", "doc_tokens", "tokens", "classes"]).to_pylist()[0]
                by_word = word_counts(row, sent.value, move, start)
                counts = batch.column("counts").slice(k, 1).flatten().to_numpy()
                used = np.flatnonzero(counts)
                parts = packed(by_word[used] / np.maximum(by_word[used].sum(1, keepdims=True), 1e-300))
                yield pa.RecordBatch.from_arrays([batch.column("words").slice(k, 1).flatten().take(pa.array(used)), pa.array(counts[used]), pa.array(parts)], schema=arrow)

    counted = rows.select("held_out", "doc_tokens", "tokens", "classes", "words", "counts").mapInArrow(counts_of, schema)
    # a word has a row per block, so the rows are few per word and moved as they are, without sums per task
    return counted.repartition("word").groupBy("word").agg(F.sum("c").alias("c"), *[F.sum(F.col("c") * _fraction("parts", k, states)).cast("float").alias(f"s{k}") for k in range(states)])


_SCORES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])


def language_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = 5, classes: int = 1 << 16, rounds: int = 4, smoothing: float = 1.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = stored(encode_blocks(docs, id_col=id_col, text_col=text_col, classes=classes))

    def by_class(batches):
        totals = np.zeros(classes, np.int64)
        for batch in batches:
            for of, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(totals, np.frombuffer(of, "<u4"), np.array(counts, np.int64))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["class", "tokens"])

    found = rows.select("classes", "counts").mapInArrow(by_class, "class int, tokens long").groupBy("class").agg(F.sum("tokens").alias("tokens")).toPandas()  # at most `classes` rows
    totals = np.zeros(classes)
    totals[found["class"]] = found["tokens"]
    model = train(rows, totals, states=states, rounds=max(0, rounds - 1), smoothing=smoothing)
    counted = stored(word_table(rows, model, states=states))
    names = [f"s{k}" for k in range(states)]
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), *[F.coalesce(F.sum(F.col(n).cast("double")), F.lit(0.0)).alias(n) for n in names]).first()
    n_all, v_all = sums["n"], sums["v"]
    whole = n_all + 0.5 * (v_all + 1)
    share = (np.array([sums[n] for n in names]) + 1e-9) / (sum(sums[n] for n in names) + 1e-9 * states)
    # the smoothed part of a word's tokens in each state, at least one unit
    units = float((1 << _bits(states)) - 1)
    part = [F.greatest(F.lit(1.0), F.round((F.col(n).cast("double") + smoothing * float(share[k])) / (F.col("c") + smoothing) * units)).cast("long") for k, n in enumerate(names)]
    joined = part[0]
    for k in range(1, states):
        joined = joined.bitwiseOR(F.shiftleft(part[k], _bits(states) * k))
    vocabulary = counted.select("word", "c", joined.alias("parts"))
    # P(word | state) before the states' sums are made 1: see ``emissions``
    made = [F.sum((F.col("c") + 0.5) / F.lit(whole) * _fraction("parts", k, states) / float(share[k])) for k in range(states)]
    sums = vocabulary.agg(*[F.coalesce(x, F.lit(0.0)).alias(n) for x, n in zip(made, names)]).first()
    scale = np.array([sums[n] for n in names]) + 0.5 / whole

    # each block gets the counts of its own words
    listed = rows.select("block", F.posexplode("words").alias("at", "word"))
    known = listed.join(vocabulary, "word").groupBy("block").agg(F.collect_list(F.struct("at", "c", "parts")).alias("known"))
    sent = docs.sparkSession.sparkContext.broadcast((Model(model.start, model.move, np.zeros((0, states))), share, scale))
    arrow = to_arrow_schema(_SCORES)

    def run(batches):
        model, share, scale = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                known = one.column("known").flatten()
                row = one.select([n for n in one.schema.names if n != "known"]).to_pylist()[0]
                c, parts = np.zeros(row["n_words"]), np.zeros(row["n_words"], np.int64)
                at = known.field("at").to_numpy(zero_copy_only=False)
                c[at] = known.field("c").to_numpy(zero_copy_only=False)
                parts[at] = known.field("parts").to_numpy(zero_copy_only=False)
                local = Model(model.start, model.move, emissions(c, unpacked(parts, states), share, scale, whole))
                base = np.log10((c + 0.5) / whole)
                seqs = _documents(row)
                score = np.zeros(len(seqs))
                for part in _groups(seqs):
                    score[part] = local.log10_probabilities([seqs[k] for k in part])
                out = (row["doc_ids"], row["held_out"], row["doc_tokens"], [int((c[s] > 0).sum()) for s in seqs], [math.fsum(base[s].tolist()) for s in seqs], score)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)

    scored = rows.join(known, "block", "left").select("doc_ids", "held_out", "doc_tokens", "tokens", F.size("words").alias("n_words"), "known").mapInArrow(run, _SCORES)
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))


def emissions(c: np.ndarray, parts: np.ndarray, share: np.ndarray, scale: np.ndarray, whole: float) -> np.ndarray:
    """P(word | state): the smoothed share of all tokens, times the state's preference for the word.

    The preference is the state's part of the word's tokens over its part of all
    tokens, 1 for words without a count; scale makes each state's sum 1.
    """
    preference = np.where(c[:, None] > 0, parts / share, 1.0)
    return ((c + 0.5) / whole)[:, None] * preference / scale
