"""Groups of near copies against all pairs, and the sizes of what one task gets."""

import re

import numpy as np
import pytest

import corpus_pipeline
from marketspan.llm import near_duplicates as near
from marketspan.llm import simhash

SF = "/root/testdata/sf0.01"
M = (1 << 64) - 1
LINE = "one two three four five six seven eight nine "


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(texts, similarity=0.8):
    """Groups by comparison of all pairs that share a shingle."""
    sets, of = [shingles(t) for t in texts], {}
    for i, s in enumerate(sets):
        for x in s:
            of.setdefault(x, []).append(i)
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in of[x] if j < i} or ({j for j in range(i) if not sets[j]} if not s else ()):
            if len(s & sets[j]) >= similarity * len(s | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def groups(spark, texts):
    df = near.near_duplicate_groups(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    return [g for _, g in sorted((r.doc_id, r.group_id) for r in df.collect())]


def test_repeats_in_a_text_don_t_count(spark):
    """A line repeated 200 times in texts whose rest differs; texts without words are one group."""
    texts = [LINE * 200 + " ".join(f"{c}{i}" for i in range(100)) for c in "ab"]
    texts += [texts[0], LINE * 300 + " ".join(f"a{i}" for i in range(100)), "", None, "  "]
    assert groups(spark, texts) == [0, 1, 0, 0, 4, 4, 4]


def drifting(families, copies, words=120, edits=5):
    r = np.random.default_rng(3)
    texts = []
    for family in range(families):
        base = [f"f{family}w{k}" for k in range(words)]
        for _ in range(copies):
            copy = list(base)
            for k in r.choice(words, r.integers(1, edits), replace=False):
                copy[k] = f"x{r.integers(1 << 30)}"
            texts.append(" ".join(copy))
            if r.random() < 0.15:
                base = copy
    return texts


@pytest.mark.parametrize(("crowded", "rows"), [(256, 512), (8, 16)])
def test_groups_against_all_pairs(spark, monkeypatch, crowded, rows):
    """Families of drifting copies; small limits send them through pivots, finer values and both rounds of blocks."""
    monkeypatch.setattr(near, "CROWDED", crowded)
    monkeypatch.setattr(near, "PIVOTS", 4)
    monkeypatch.setattr(near, "SET_ROWS", rows)
    texts = drifting(6, 40)
    want = roots(texts)
    assert len(set(want)) > 12
    assert groups(spark, texts) == want


def test_common_passages_join_no_texts(spark, monkeypatch):
    """Half of each text is the same passage: values are crowded, but nothing is similar enough."""
    monkeypatch.setattr(near, "CROWDED", 8)
    monkeypatch.setattr(near, "PIVOTS", 4)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + " ".join(f"t{i}w{k}" for k in range(60)) for i in range(80)] + [passage, passage + " end"]
    assert groups(spark, texts) == [*range(80), 80, 80]


def test_recall_on_documents(spark):
    """Every link that all pairs give, on a whole table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = roots([r.text for r in rows])
    got = {r.doc_id: r.group_id for r in near.near_duplicate_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    first = [rows[k].doc_id for k in want]
    joined = [got[r.doc_id] == got[f] for r, f in zip(rows, first) if r.doc_id != f]
    assert len(joined) > 50 and sum(joined) >= 0.99 * len(joined)
    assert sum(got[r.doc_id] != f for r, f in zip(rows, first)) <= 0.01 * len(rows)


def test_rows_of_one_id_are_told_apart(spark):
    """Several texts under one id, null ids, repeated rows and clashing columns: one row of each group stays."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    data = [(1, a, "x", 1, 1), (1, b, "y", 2, 2), (2, a + " more", "z", 3, 3), (None, b, "u", 4, 4), (None, "alone " + b[:40], "v", 5, 5), (3, "same", "w", 6, 6), (3, "same", "w", 6, 6), (4, None, "n", 7, 7), (5, "", "e", 8, 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, key string, text_hash long, v long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.v) for r in kept.collect()) == [(0, 5), (1, 1), (1, 2), (3, 6), (4, 7)]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0


def test_probes_of_an_absent_value_are_bounded(spark, monkeypatch):
    """Many fingerprints share a partition's value, and none is listed under its neighbours."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    fps = [i << 32 for i in range(300)]
    nodes = spark.createDataFrame([(f, f, f) for f in fps], "node long, fp long, check long")
    groups, thresholds = [list(range(32)), list(range(32, 64))], [1, 0]
    sizes = simhash.dealt_rows(nodes, groups, thresholds).groupBy("k", "key", "at").count()
    assert sizes.agg({"count": "max"}).first()[0] < 6 * 16
    got = [tuple(e) for e in simhash.links(nodes, 2, groups, thresholds).collect()]
    assert all(a != b for a, b in got), [e for e in got if e[0] == e[1]][:5]
    root = dict(zip(fps, fps))
    for a, b in got:
        assert (a ^ b).bit_count() <= 2
        root = {f: root[a] if r == root[b] else r for f, r in root.items()}
    assert len(set(root.values())) == 1


def test_probes_find_all_pairs(spark):
    """Thresholds above 0: pairs that differ in every partition are found by probes only."""
    r = np.random.default_rng(5)
    fps = [int(x) for x in r.integers(-(1 << 62), 1 << 62, 60)]
    fps += [f ^ 1 << int(a) ^ 1 << int(b) ^ 1 << int(c) for f in fps for a, b, c in [(r.integers(0, 32), r.integers(32, 62), r.integers(32, 62))]]
    nodes = spark.createDataFrame([(f, f, f) for f in fps], "node long, fp long, check long")
    got = {tuple(sorted(e)) for e in simhash.links(nodes, 3, [list(range(32)), list(range(32, 64))], [1, 1]).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & M).bit_count() <= 3}


def test_members_of_a_crowded_value_meet_without_pivots(spark, monkeypatch):
    """Pairs share one crowded value and no other, and few of them are close to a pivot."""
    monkeypatch.setattr(near, "CROWDED", 8)
    monkeypatch.setattr(near, "PIVOTS", 2)
    r = np.random.default_rng(3)
    parts = [list(range(4 * k, 4 * k + 4)) for k in range(16)]
    rows = []
    for pair in range(40):
        a = r.integers(0, 1 << 16, 64).astype("<u2")
        a[:4] = 7
        b = a.copy()
        b[7::4] ^= 1
        rows += [(2 * pair, a.tobytes()), (2 * pair + 1, b.tobytes())]
    for limit in (1024, 16):
        monkeypatch.setattr(near, "MEMBER_ROWS", limit, raising=False)
        got = near.candidate_links(spark.createDataFrame([(v, bytearray(x)) for v, x in rows], "v long, sketch binary"), parts, agree=38)
        assert {tuple(sorted(e)) for e in got.collect()} == {(2 * k, 2 * k + 1) for k in range(40)}
