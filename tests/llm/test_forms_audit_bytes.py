"""Fill-in-the-middle, filter audit and byte encoding against brute force and the public library."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspan.llm import byte_encoding, fill_in_middle, filter_audit, queries
from marketspan.llm.byte_encoding import EncodedText, RankEncoder
from marketspan.llm.tokenization import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, form string, part string, digest int"
ODD = [None, "", " ", "  \n", "one", " lead", "trail \t ", "a<P>b c", "a < b <S c", "<M> <", "the same", "the same", "日本 x é", "It's we'll 'tis", "w" * 20_000, " ".join(f"v{i}" for i in range(3000)), "A# b" * 40, "x y " * 60]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts under extra columns with clashing names; a null id, a repeated row, an id with two texts."""
    rows = [(i, t, [None, "", "de", "en"][i % 4], 1, "f", "p", 2) for i, t in enumerate(ODD)]
    rows += [(None, "the same", "de", 1, "f", "p", 2), (4, "one", "en", 1, "f", "p", 2), (4, "one", "en", 1, "f", "p", 2), (5, "one", None, 1, "f", "p", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def middle_form(doc_id, text, percent=50):
    """The rule, step by step over lists of units."""
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (len(units), "plain", None, None, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return (len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("percent", [50, 100])
def test_middle_forms(docs, percent):
    found = sorted(map(tuple, fill_in_middle.fill_in_middle(docs, percent=percent).collect()), key=str)
    assert found == sorted([(r.doc_id, *middle_form(r.doc_id, r.text, percent)) for r in docs.collect()], key=str)


def test_middle_digests(docs):
    found = fill_in_middle.fill_in_middle(docs, percent=100)
    out = found.select("doc_id", "output", fill_in_middle.digests(F.col("output"), F.col("form")).alias("x")).select("doc_id", "output", "x.*").collect()
    assert all(r.output_sha256 == sha(r.output) for r in out)
    assert sorted(r.restored_sha256 for r in out) == sorted(sha(r.text or "") for r in docs.collect())
    assert fill_in_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_middle_sentinels(docs):
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("<<", "b", "c"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(docs, sentinels=marks)
    found = fill_in_middle.fill_in_middle(docs, percent=100, sentinels=("\x01P", "\x01S", "\x01M")).collect()
    assert sorted(fill_in_middle.rebuilt(r.output, r.form, ("\x01P", "\x01S", "\x01M")) for r in found) == sorted(r.text or "" for r in docs.collect())


def audit_rows(docs, labels):
    """Every document through every order, one by one."""
    marks = {}
    for d, q, t in labels:
        have = marks.get(d, (None, None))
        marks[d] = tuple(max((x for x in xs if x is not None), default=None) for xs in zip(have, (q, t)))
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    counts, sums = {}, {}
    for d, t, part in docs:
        t, part = t or "", part or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d}
        quality, toxic = (None, None) if d is None else marks.get(d, (None, None))
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = counts.setdefault((part, "".join(order), step, f), [0] * 6)
                removed = not gone and fails[f]
                row[0] += not gone and not fails[f]
                row[1] += removed
                row[2] += gone and fails[f]
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += removed and quality == 1
                row[5] += removed and toxic == 1
                sums[part, f] = sums.get((part, f), 0) + removed
                gone |= fails[f]
    return sorted((*k, *v, sums[k[0], k[3]]) for k, v in counts.items())


LABELS = [(0, 1, 0), (4, 1, 1), (4, None, 0), (10, 0, 1), (11, 1, 1), (16, None, None), (99, 1, 1), (None, 1, 1)]


def test_audit(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("xx"))
    found = sorted(map(tuple, filter_audit.audit(docs, labels).collect()))
    assert found == audit_rows([(r.doc_id, r.text, r.lang) for r in docs.collect()], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert len(filter_audit.audit(docs, labels.limit(0)).collect()) == 3 * 600


def test_audit_counts_copies(spark):
    """Copies across parts and labels, repeated ids, and a text that most rows share."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(30)]), rng.choice(["hot"] * 6 + ["x $", "A"]), rng.choice(["de", "en", None])) for _ in range(200)]
    labels = [(k, k % 2, k % 3 // 2) for k in range(0, 30, 2)]
    found = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, found.collect())) == audit_rows(rows, labels)


def test_audit_other_filters(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels, failures={"short": F.length("text") < 5, "null": F.lit(None).cast("boolean")}, copies=None)
    rows = found.where("part = 'en' and filter_order = 'null,short'").orderBy("step").collect()
    assert [r.removed for r in rows] == [0, sum(1 for r in docs.collect() if r.lang == "en" and len(r.text or "") < 5)]
    with pytest.raises(ValueError):
        filter_audit.replayed(found, list("abcdefg"))


@pytest.fixture(scope="module")
def public():
    import tiktoken
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_encoding.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return RankEncoder(tokenizer_path("byte_bpe_50k.tiktoken"))


def strange_texts():
    rng = random.Random(3)
    kinds = ["ab ", "aeio nt's \n", " \t\n x", "日本語的一是不了人我", "กขคงสวัสดี ", "abc'ABC12!?  \n é\U0001f600֘\U000323b0 \x85\x1c", "'sltdrvem "]
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 150))) for k in kinds for _ in range(60)]
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return texts + ["".join(map(chr, rng.sample(every, 200))) for _ in range(40)]


def test_bytes_equal_the_library(spark, docs, encoder, public):
    for text in strange_texts():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == public.encode_ordinary(text), ascii(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()
    found = byte_encoding.encode_documents(docs).withColumn("raw", byte_encoding.decoded(F.col("ids"))).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.raw)) for r in found) == sorted((str(r.doc_id), public.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert byte_encoding.encode_documents(docs.limit(0)).collect() == []
    assert spark.range(1).select(byte_encoding.decoded(F.lit(None).cast("binary")).alias("x")).first().x is None


def test_bytes_of_other_ranks():
    import tiktoken
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_encoding.read_ranks(path), special_tokens={})
    ours = RankEncoder(path)
    assert all(np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode_ordinary(t) for t in strange_texts())


def test_appends_and_edits(encoder, public):
    rng = random.Random(8)
    texts = strange_texts()
    for text in texts[::3]:
        state = EncodedText(encoder, text)
        assert EncodedText.stored(encoder, text, state.last).ids == state.ids
        for _ in range(5):
            begin = rng.randint(0, len(state.text))
            new = rng.choice(texts)[: rng.choice([0, 1, 5, 30])]
            state.append(new) if rng.random() < 0.3 else state.replace(begin, begin + rng.choice([0, 1, 3, 40]), new)
            assert np.frombuffer(state.ids, "<u4").tolist() == public.encode_ordinary(state.text)
            assert state.last == EncodedText(encoder, state.text).last


def test_edits_stay_near(encoder):
    state = EncodedText(encoder, "some words of a text " * 20_000)
    state.replace(200_000, 200_003, "other")
    assert state.redone < 10
    state.append("!")
    assert state.redone < 5
    long = EncodedText(encoder, "ab" * 5000)
    known = {k: v for k, v in encoder.table.step.items()}
    reads = []
    real, encoder.table.extend = encoder.table.extend, lambda raw, last: (reads.append(len(raw) + 1 - len(last)), real(raw, last))[1]
    try:
        long.append("ba")
    finally:
        encoder.table.extend = real
    assert reads == [2] and known == encoder.table.step  # two bytes, two entries


def test_query_of_bytes(spark, public):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda t: sha(np.array(public.encode_ordinary(t), "<u4").tobytes())
    for r in queries.op13_byte_encoding(spark, SF).collect():
        text = texts.pop(r.doc_id)
        half = len(text) // 2
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(public.encode_ordinary(text)), digest(text), sha(text))
        assert (r.appended_sha256, r.edited_sha256) == (digest(text + queries.APPENDED), digest(text[:half] + queries.EDITED + text[half + 1 :]))
    assert not texts


def test_documents_are_decoded_by_the_worker_that_encodes(spark):
    docs = spark.createDataFrame([(1, "a bé \U0001f600"), (2, None), (3, "")], "doc_id long, text string")
    rows = byte_encoding.encode_documents(docs, decode=True)
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in rows.collect()) == [(1, "a bé \U0001f600"), (2, ""), (3, "")]
    both = queries.op13_byte_encoding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in both and "ArrowEvalPython" not in both  # a second worker a task would hold the ranks again
