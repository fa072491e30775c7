"""The training-data operators against brute force, on small tables with nulls, ties and empty texts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marketspan.llm import chat, decontamination, hmm, licenses, near_duplicates, packing, quality, queries, simhash, token_counts, token_file, url_filters
from marketspan.llm.common import connected_components, stored
from marketspan.llm.tokenization import CachedEncoder, cut_of, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp long, block string, part int"
WORD = "[^\x20\x09-\x0d]+"
ODD = [None, "", " ", "one", "a b c d " * 40, "x\n\n y 'tis \t z", "日本 x é", "<|endoftext|> hi", "the same", "the same", "SPDX-License-Identifier: MIT OR (Apache-2.0 AND isc)\nMIT License", "w" * 5000, " ".join(f"v{i}" for i in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts under clashing extra columns, with a null id and a repeated row."""
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(ODD)] + [(None, "no id", 1, "x", 2), (3, "one", 1, "x", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


OPERATORS = {
    "simhash": simhash.simhash_components, "quality": quality.quality_rules, "passing": quality.passing, "licences": licenses.license_scan,
    "hmm": lambda d: hmm.language_scores(d, states=2, classes=64, rounds=1), "packing": packing.pack, "counts": token_counts.prefix_counts, "file": token_file.written_documents, "groups": near_duplicates.near_duplicate_groups,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_odd_tables(spark, docs, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0
    got = OPERATORS[name](docs)
    if name == "passing":
        assert got.columns == docs.columns
    elif name != "packing":
        assert got.count() == len(ODD) + 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 202), (None, 5), (0, 30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 200, 201: 200, 202: 200}


def test_simhash_against_all_pairs(spark, texts, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)  # crowded values are split in blocks
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}

    def plain(text):
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: plain(t) for i, t in texts.items()}
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in fp.items())
    root = {i: i for i in fp}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert {i: r.component_id for i, r in got.items()} == {i: top(i) for i in fp}


def test_thresholds_cover_the_distance():
    cost, ts = simhash.allocate([[0, 1, 5, 50], [0, 9, 10, 11], [0, 2, 3, 4]], 2)
    assert sum(ts) == 2 and cost == min(a + b + c for i, a in enumerate([0, 1, 5, 50]) for j, b in enumerate([0, 9, 10, 11]) for k, c in enumerate([0, 2, 3, 4]) if i + j + k - 3 == 2)


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in queries.op2_chat(spark, SF).collect()}
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.ADDED_TURNS
    for conv in {t[0] for t in turns}:
        rows = sorted(t for t in turns if t[0] == conv)
        said = "".join(t[3] or "" for t in rows if t[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in rows).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(rows), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.MARKS[0] + chat.escape(t[2]) + chat.MARKS[1] + chat.escape(t[3] or "") + chat.MARKS[2]) for t in rows)


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "a:b\\", "</turn>\n### user: x"), (2, 1, "assistant", "<|endoftext|>\\")]
    got = {r.conv_id: r for r in chat.digests_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[2].loss_chars == 14
    assert got[None].turns_sha256 == hashlib.sha256("a:b\\\n</turn>\n### user: x\n".encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_library_s(texts, name):
    path, tok = tokenizer_path(name), library(name)
    every = [t or "" for t in [*texts.values(), *ODD]]
    assert CachedEncoder(path, cut_of(path)).encode(every) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(every, add_special_tokens=False)]


def test_token_files(spark, texts, monkeypatch):
    monkeypatch.setattr(token_file, "SHARD_TOKENS", 20_000)
    tok, at = library("byte_bpe_50k.json"), 0
    got = {r.doc_id: r for r in queries.op3_token_file(spark, SF).collect()}
    stream = []
    for i in sorted(texts):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        stream += ids
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    path = token_file.shared_folder(spark)
    token_file.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), path)
    for p in (0, 1, at // 3, at - 1):
        assert token_file.token_at(spark, path, p) == stream[p]
    assert token_file.token_at(spark, path, at) is None


def test_codes():
    x = np.random.default_rng(1).integers(0, 70_000, 3000).astype("<u4")
    x[:5] = 0, 255, 256, 65_536, 2**32 - 1
    c = token_file.Codes(token_file.write_codes(x))
    assert (c.all() == x).all() and all(c[i] == v for i, v in enumerate(x.tolist()))


def test_quality_against_brute_force(texts):
    some = [*texts.values(), *ODD[:-1]]
    got = quality.measure(some, 8)
    for i, t in enumerate(some):
        w = re.findall(WORD, t or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        eight = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        far = {k + j for k in range(len(w) - 7) if eight[tuple(w[k : k + 8])] > 1 for j in range(8)}
        n = 8
        while max(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)).values(), default=0) > 1:
            n += 1
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        assert (got["n_words"][i], got["word_chars"][i], got["n_repeat_words"][i], got["covered_words"][i], got["longest_repeat"][i], got["n_dup_lines"][i]) == (len(w), sum(map(len, w)), len(hit), len(far), n - 1 if n > 8 else 0, len(lines) - len(set(lines)))
        assert sum(b - a for a, b in quality.repeated_spans(t)) == len(far)


def test_urls(spark):
    rows = [
        (1, "https://a.example.org/es/1", None), (2, "https://A.Example.org:8080/x?y", ""), (3, None, None), (4, "no scheme", "<link rel=canonical href=/x>"),
        (5, "http://x.net/old", '<META http-equiv="refresh" content="0; url=https://shop.com/de/1">'), (6, "http://x.net/older", '<link href="/old#top" rel="canonical">'),
        (7, "http://y.net/1", "<link rel='canonical' href='https://shop.com/de/2'>"), (8, "http://y.net/2", "<link rel=canonical href=//y.net/1><link rel=canonical href=https://shop.com/fr/1>"), (9, "http://comb.com", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("a.example.org:8080", "/x", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("x.net", "/old", None, "block"), 6: ("x.net", "/older", None, "block"), 7: ("y.net", "/1", None, "allow"), 8: ("y.net", "/2", None, "allow"), 9: ("comb.com", "", None, "allow"),
    }


def test_licences():
    got = licenses.scan("Under the MIT  license (cc-by). SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception OR GPL-2.0 */")
    assert got["base_labels"] == "cc-by,mit" and got["labels"] == "apache-2.0 with llvm-exception,cc-by,gpl-2.0,mit" and (got["n_base"], got["first_word"], got["last_word"], got["score"]) == (2, 2, 4, 1.0)
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert [licenses.postfix(x) for x in ("a b", "(a", "a and", ")", "", "or a")] == [None] * 6
    assert licenses.satisfied("a or b and c", {"b", "c"}) and not licenses.satisfied("(a or b) and c", {"a", "b"})


def test_licences_against_brute_force(spark, texts):
    every = licenses.NOTICE_PHRASES | licenses.BASE_PHRASES
    for r in queries.op6_licenses(spark, SF).collect():
        w = alnum(texts[r.doc_id])
        places = {p: [i for i in range(len(w)) if w[i : i + p.count(" ") + 1] == p.split()] for p in every}
        base = sorted(i for p in licenses.BASE_PHRASES for i in places[p])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), min(base, default=None), max(base, default=None))
        assert r.base_labels == ",".join(sorted({x for p, x in licenses.BASE_PHRASES.items() if places[p]}))
        assert {x for p, x in every.items() if places[p]} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_long_texts_take_linear_time():
    """A few MB of phrases, of one repeated word, and of words without an end."""
    got = licenses.scan("cc by " * 300_000)
    assert (got["n_base"], got["first_word"], got["last_word"]) == (300_000, 0, 599_998)
    m = quality.measure(["same " * 200_000, "w" * 1_000_000, " ".join(f"v{i % 70_000}" for i in range(140_000))], 8)
    assert m["longest_repeat"].tolist() == [199_999, 0, 70_000] and m["covered_words"].tolist() == [200_000, 0, 140_000]
    sizes, terms, counts, _ = decontamination.segment_of(["ab " * 700_000, None, "x" * 3_000_000])
    assert sizes.tolist() == [700_000, 0, 1] and terms[0] == b"ab" and counts.tolist() == [700_000, 1]


def test_query_columns_of_quality(spark, texts):
    for r in queries.op4_quality(spark, SF).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(WORD, t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        assert (r.n_words, r.n_repeat_words, r.n_symbols, r.base_failed) == (len(w), repeated, len(re.findall("[#*$%&|<>]", t)), failed)
        assert r.kept == (not failed and r.covered_words <= 0.3 * len(w) and r.longest_repeat <= 200)


def test_links_are_resolved(spark):
    rows = [("http://a.com/x/y", "../z?p=1"), ("http://a.com/x/y", "./z"), ("http://a.com/x/y?q=1", "?r=2"), ("http://a.com", "z"), ("http://a.com/x", "//b.com"), ("http://a.com/x", "#top"), ("http://a.com/x/", "/a/./b/../../c/.."), ("http://a.com/x", "HTTPS://B.com/Q#f")]
    u = spark.createDataFrame(rows, "url string, target string")
    got = [r[0] for r in u.select(url_filters.node_of(url_filters.absolute(F.col("target"), F.col("url")))).collect()]
    assert got == ["http://a.com/z?p=1", "http://a.com/x/z", "http://a.com/x/y?r=2", "http://a.com/z", "http://b.com/", "http://a.com/x", "http://a.com/", "https://b.com/Q"]
    html = "<!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script><link rel='canonical' href='/a?x=1&amp;y=2'>"
    assert spark.createDataFrame([(html,)], "html string").select(url_filters.link_targets(F.col("html"))).first()[0] == ["/a?x=1&y=2"]


def test_other_tokenizers_are_refused_or_encoded_whole(tmp_path):
    import json

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)
    found["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(found), encoding="utf-8")
    assert cut_of(str(path)) == "whole" and [cut_of(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")] == ["space", "white"]
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(str(path))


def test_hmm_is_exact_and_learns(spark):
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.3], [0.2, 0.6]]))
    seqs = [np.array([0, 2, 1, 1]), np.array([1]), np.array([2, 2, 0])]
    want = [sum(m.start[p[0]] * m.emit[s[0], p[0]] * np.prod([m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], s[1:])]) for p in np.ndindex(*[2] * len(s))) for s in seqs]
    assert np.allclose(m.log10_probabilities(seqs), np.log10(want))
    emit, move, start = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
    for s, total in zip(seqs, want):  # every path, weighted by its share of the sequence's probability
        for p in np.ndindex(*[2] * len(s)):
            share = m.start[p[0]] * m.emit[s[0], p[0]] * np.prod([m.move[a, b] * m.emit[x, b] for a, b, x in zip(p, p[1:], s[1:])]) / total
            start[p[0]] += share
            for x, k in zip(s, p):
                emit[x, k] += share
            for a, b in zip(p, p[1:]):
                move[a, b] += share
    for held in (1, 3, 100):  # sequences cut in stretches give the same counts
        got = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
        assert np.isclose(m.expected(seqs, *got, held), np.log10(want).sum())
        assert all(np.allclose(g, w) for g, w in zip(got, (emit, move, start)))
    likely = []
    for _ in range(6):
        got = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
        likely.append(m.expected(seqs, *got))
        m = hmm.Model(got[2] / got[2].sum(), got[1] / got[1].sum(1, keepdims=True), got[0] / got[0].sum(0))
    assert all(b >= a - 1e-9 for a, b in zip(likely, likely[1:])) and likely[-1] > likely[0]
    rows = queries.op7_hmm(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)


def test_hmm_words_sum_to_one():
    """Over all words and one unseen word each state's probabilities sum to 1."""
    r = np.random.default_rng(2)
    c = r.integers(1, 9, 50).astype(float)
    parts = hmm.unpacked(hmm.packed(r.dirichlet(np.ones(3), 50)), 3)
    assert np.allclose(parts.sum(1), 1, atol=1e-5)
    share, whole = (parts * c[:, None]).sum(0) / c.sum(), c.sum() + 0.5 * 51
    c, parts = np.append(c, 0), np.vstack((parts, np.zeros(3)))
    raw = hmm.emissions(c, parts, share, np.ones(3), whole)
    assert np.allclose(hmm.emissions(c, parts, share, raw.sum(0), whole).sum(0), 1)


def test_hmm_base_score(spark, texts):
    toks = {i: [*re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""] for i, t in texts.items()}
    c = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n = sum(c.values())
    for r in hmm.language_scores(spark.read.parquet(f"{SF}/documents.parquet"), states=2, rounds=1).collect():
        want = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in toks[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks[r.doc_id]), sum(c[w] > 0 for w in toks[r.doc_id]), n) and abs(r.base_score - want) < 1e-6


ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def alnum(text):
    return re.findall(ALNUM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(words, items, window, slop=0):
    """Hit words, items with an exact window, and items with a window whose words all stand within slop of their places."""
    hit, exact, near = set(), set(), set()
    for item, w in items:
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for s in range(-slop, len(words)):
                at = [[p for p in range(max(0, s + o - slop), min(len(words), s + o + slop + 1)) if words[p] == x] for o, x in enumerate(part)]
                if all(at):
                    near.add(item)
            for s in range(len(words) - len(part) + 1):
                if words[s : s + len(part)] == part:
                    exact.add(item)
                    hit |= set(range(s, s + len(part)))
    return hit, exact, near


@pytest.mark.parametrize("slice_words", [500_000, 300])
def test_decontamination(spark, texts, monkeypatch, slice_words):
    monkeypatch.setattr(decontamination, "SLICE_WORDS", slice_words)
    of = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            of.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    for r in queries.op8_decontamination(spark, SF).collect():
        w, hit, items = alnum(texts[r.doc_id]), set(), set()
        for n in {len(x) for x in of}:
            for k in range(len(w) - n + 1):
                if found := of.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        assert r.n_near_items >= r.n_items


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha beta x gamma"), (2, "alpha beta gamma"), (3, "gamma alpha"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma"), (None, "alpha"), (2, "")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.items, r.near_items) for r in decontamination.contamination(d, b, slop=1).collect()}
    assert got == {1: (0, [], ["1"]), 2: (3, ["1"], ["1"]), 3: (0, [], []), 4: (0, [], [])}


@pytest.mark.parametrize(("slice_words", "segment_chars"), [(500_000, 8_000_000), (7, 40)])
def test_phrases_and_proximity_against_brute_force(spark, monkeypatch, slice_words, segment_chars):
    """Several partitions, segments and slices at once, over few words so that much repeats."""
    monkeypatch.setattr(decontamination, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(decontamination, "SEGMENT_CHARS", segment_chars)
    r = np.random.default_rng(7)
    docs = [(i, " ".join(r.choice(list("abcdef"), r.integers(0, 25)))) for i in range(40)]
    items = [(str(k), [str(x) for x in r.choice(list("abcdef"), r.integers(1, 7))]) for k in range(8)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id string, text string")
    got = {x.doc_id: x for x in decontamination.contamination(d, b, window=4, slop=2).collect()}
    for i, t in docs:
        hit, exact, near = plain_hits(t.split(), items, 4, 2)
        assert (got[i].n_hit, got[i].items, got[i].near_items) == (len(hit), sorted(exact), sorted(near)), (t, items)


def test_one_index_serves_several_benchmarks(spark):
    """The index holds every posting; segments of partitions beyond any 32-bit bound keep their documents apart."""
    d = spark.createDataFrame([(1, "one two three"), (2, "four five")], "doc_id long, text string, segment int, place int".replace(", segment int, place int", ""))
    index = stored(decontamination.index(d.coalesce(1)))
    far = index.withColumn("segment", F.lit((1 << 20) << 32)).unionAll(index.withColumn("segment", F.lit(((1 << 20) + 1) << 32)))
    for text, want in (("two three", [1, 1]), ("five", [2, 2]), ("six", [])):
        b = spark.createDataFrame([("b", text)], "item_id string, text string")
        assert sorted(r.doc_id for r in decontamination.matched(far, b).where("n_hit > 0").collect()) == want
    assert decontamination.matched(far, spark.createDataFrame([], "item_id string, text string")).where("n_hit > 0").count() == 0


def test_tables_with_clashing_columns(spark, docs):
    """Empty tables and clashing extra columns for the operators whose input isn't (doc_id, text) alone."""
    items = docs.select(F.col("doc_id").alias("item_id"), "text", "fp", "part")
    assert decontamination.contamination(docs, items).count() == len(ODD) + 2
    assert decontamination.contamination(docs.limit(0), items).count() == 0 == decontamination.contamination(docs, items.limit(0)).where("n_hit > 0").count()
    pages = spark.createDataFrame([(1, "http://a.com/x", "<link rel=canonical href=y>", "n", "r")], "page_id long, url string, html string, node string, root string")
    assert url_filters.url_verdicts(pages, queries.URL_RULES).count() == 1 and url_filters.url_verdicts(pages.limit(0), queries.URL_RULES).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "a", 3, "i")], "conv_id long, turn long, role string, text string, rank int, ids string")
    assert chat.digests_of(turns).count() == 1 and chat.digests_of(turns.limit(0)).count() == 0


def test_last_stages_with_odd_tables(spark, docs):
    b = spark.read.parquet(f"{SF}/benchmark.parquet").limit(1)
    passage = F.concat(F.lit("before "), "text", F.lit(" after")).alias("text")
    rest = [F.lit(1).cast("long").alias("fp"), F.lit("x").alias("block"), F.lit(2).alias("part")]
    # a leak without a doc_id, and two under the doc_id of a clean row
    leaked = docs.unionByName(b.select(F.explode(F.array(*[F.lit(i).cast("long") for i in (99, None, 3, 3)])).alias("doc_id"), passage, *rest))
    kept = corpus_pipeline.decontamination_stage(spark, leaked, SF)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.decontamination_stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs, SF).select("doc_id").distinct().count() == len(ODD) + 1


def test_run_packs_what_the_stages_keep(spark, texts):
    tok = library("word_bpe_49k.json")
    rows = corpus_pipeline.run(spark, SF).collect()
    sizes = Counter()
    for r in rows:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        sizes[r.doc_id] += r.length
    assert 0 < len(sizes) < len(texts) and all(n == len(tok.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i, n in sizes.items())


def test_packing(spark, texts):
    tok = library("word_bpe_49k.json")
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    rows = queries.op9_packing(spark, SF).collect()
    cover, filled = Counter(), {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        cover[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    assert cover == {i: len(x) for i, x in ids.items()}
    for k, parts in filled.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] and (at == 2048 or k == max(filled))


def prefix_totals(tok, text):
    return [len(tok.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def test_prefix_counts_of_strange_texts():
    """White space of every kind before words, contractions, unspaced scripts, and characters that engines class differently."""
    import random

    rng, tok = random.Random(6), library("byte_bpe_50k.json")
    counter = token_counts.PrefixCounter(tokenizer_path("byte_bpe_50k.json"))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    kinds = [["a", "b'", " ", "\n", "\t", "\r", "'", "s", "re", "1", "!"], ["é", "日", "\xa0", "\x1c", "\x85", "\u2003", " ", "\n", "'ll", "x", "9"], ["日", "本", "กข", "สวัส", " "], rng.sample(every, 300) + [" ", "\n", "a"] * 40]
    for kind in kinds:
        for _ in range(80):
            text = "".join(rng.choice(kind) for _ in range(rng.randint(1, 30)))
            assert np.cumsum(counter.differences(text)).tolist() == prefix_totals(tok, text), ascii(text)
    for text in ("a\n\nb", "a\n\n\nb's", "\n\n", "日本語" * 60, "\u0558" * 3 + "a"):
        assert np.cumsum(counter.differences(text)).tolist() == prefix_totals(tok, text), ascii(text)
    long = "".join(rng.choice("一二三四五六七八九十") for _ in range(20_000))
    assert int(counter.differences(long).sum(dtype=np.int64)) == len(tok.encode(long, add_special_tokens=False).ids)


def test_query_of_prefix_counts(spark, texts):
    tok = library("byte_bpe_50k.json")
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for r in queries.op10_token_counts(spark, SF).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_tokens, r.over_limit, r.tokens_of_1000_chars) == (count(t), count(t) > 1024, count(t[:1000]))
        within = r.chars_within_limit
        assert within == len(t) if not r.over_limit else count(t[:within]) <= 1024 < count(t[: within + 1])


def test_prefix_counts(texts):
    counter, tok = token_counts.prefix_counter(tokenizer_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for t in ["It's we'll they've you're  x\n\n y 'tis \t z\r\n 's 're", "a  b   c \n d", *[x for x in ODD if x and len(x) < 400], *[t[:200] for t in [*texts.values()][:20]]]:
        steps = counter.differences(t).astype("<i2").tobytes()
        want = [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]
        assert [token_counts.tokens_at(steps, k) for k in range(1, len(t) + 1)] == want
        assert token_counts.longest_within(steps, 3) == max([k for k, n in enumerate(want, 1) if n <= 3], default=0)


def test_token_counts(spark, texts):
    tok = library("byte_bpe_50k.json")
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op10_token_counts(spark, SF).collect()} == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts.items()}


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stored(stage(spark, docs, SF))
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        docs = out
    m = quality.measure([*texts.values()], 8)
    good = {i for k, i in enumerate(texts) if m["n_words"][k] >= 50 and 100 * m["n_repeat_words"][k] <= 50 * m["n_words"][k] and m["covered_words"][k] <= 0.3 * m["n_words"][k] and m["longest_repeat"][k] <= 200}
    assert kept[0] == good
    sets = {i: set(near_duplicates.Shingler(5)(texts[i]).tolist()) for i in good}
    assert len({frozenset(sets[i]) for i in kept[1]}) == len(kept[1])
    for i in good - kept[1]:  # what went is near something that was there
        assert any(i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in good)
    hit = {r.doc_id for r in queries.op8_decontamination(spark, SF).where("contaminated").collect()}
    assert kept[2] == kept[1] - hit
