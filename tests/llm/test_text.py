"""Suffix deduplication, SimHash, language, BPE and license scans against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import bpe, language, licenses, simhash, suffixes
from rankloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, chunk int, kind int, fp long, body string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "", 1, 1, 1, 1, "") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    base = prose(120)
    out = [prose(rng.randrange(1, 80)) for _ in range(60)]
    out += [prose(10) + " " + rng.choice(shared) + " " + prose(10) for _ in range(40)]
    out += [base.replace(" ", "  ", k) for k in range(5)] + [base, base, "a" * 300, "a" * 120 + "b" * 60, "é" * 70, "xé" + "é" * 60, "", None, "short"]
    return list(enumerate(out)) + [(7, out[7]), (None, base)]


def removed(rows):
    """What the definition says, string by string."""
    found = []
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        found.append((i, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("hot", [3, 1024])
def test_suffix_digests(spark, texts, hot):
    got = sorted((tuple(r) for r in suffixes.digests(frame(spark, texts), hot).collect()), key=str)
    assert got == removed(texts)


def test_suffix_stage_keeps_columns(spark, texts):
    df = frame(spark, texts)
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert suffixes.without_repeats(df.limit(0)).count() == 0
    assert all(r["text"].encode() for r in out.where("text <> ''").collect())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=50, max_size=76), min_size=1, max_size=12))
def test_suffix_sort_orders_suffixes(rows):
    data = [r.encode() for r in rows]
    matrix = np.zeros((len(data), suffixes.REACH), np.uint8)
    for i, b in enumerate(data):
        matrix[i, : len(b)] = np.frombuffer(b, np.uint8)
    s = suffixes.Suffixes(matrix)
    place = [(i, o) for i, b in enumerate(data) for o in range(len(b) - 49)]
    suffix = np.array([i * s.width + o for i, o in place])
    order = s.sort(suffix, np.zeros(len(suffix), np.int64))
    strings = [data[i][o : o + 50] for i, o in place]
    assert [strings[k] for k in order] == sorted(strings)
    order, head = s.runs(suffix, np.zeros(len(suffix), np.int64))
    exact_order, exact_head = s.exact_runs(suffix, np.zeros(len(suffix), np.int64))
    assert [strings[k] for k in order] == [strings[k] for k in exact_order] and head.tolist() == exact_head.tolist()


def brute_simhash(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_digests(spark, texts):
    rows = [(i, t) for i, t in texts if i is not None]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.digests(frame(spark, rows)).collect()}
    fps = {i: brute_simhash(t) for i, t in rows}
    want = brute_components(sorted(fps), fps, 4)
    assert got == {i: (format(fps[i], "016x"), want[i]) for i in fps}
    assert simhash.digests(frame(spark, rows).limit(0)).count() == 0


def test_long_runs_lose_no_component(spark):
    rng = random.Random(5)
    fps, x = {}, 0
    for i in range(150):  # a chain of steps of 4 bits, and a dense ball: both in a few runs
        for b in rng.sample(range(30, 64), 4):
            x ^= 1 << b
        fps[i] = x
    for i in range(150, 400):
        fps[i] = (1 << 62) - 1 ^ sum(1 << b for b in rng.sample(range(64), 3))
    want = brute_components(sorted(fps), fps, 4)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "node long, fp long")
    from pyspark.sql import functions as F

    rows = df.select(F.explode(simhash.variants(F.col("fp"), 4)).alias("key"), "node", "fp")
    linked = simhash.links(rows, [(1, 4)], 3)
    got = {r["node"]: r["component"] for r in components(linked).collect()}
    assert {i: got.get(i, i) for i in fps} == want
    assert linked.count() < 5 * len(fps)


def test_one_of_each_keeps_clean_documents(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    docs = [[rng.choice(words) for _ in range(rng.randrange(60, 200))] for _ in range(120)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    for i in range(40):  # one word changed: a similarity of 0.85 and more
        d = list(docs[i])
        d[len(d) // 2] = "changed"
        rows.append((1000 + i, " ".join(d)))
    rows += [(2000 + i, docs[50 + i] and " ".join(docs[50 + i])) for i in range(10)]
    kept = {r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()}
    assert set(range(120)) <= kept and len(kept & set(range(1000, 1040))) <= 2 and not kept & set(range(2000, 2010))


def shingles_of(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("block", [simhash.BLOCK, 150])
def test_one_of_each_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # of 150 shingles: most components are dealt into blocks
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(150):
        d = [word() for _ in range(rng.randrange(80, 300))]
        rows.append((i, " ".join(d)))
        for share in (0.11, 0.2, 0.24, 0.3, 0.4)[: rng.randrange(1, 6)]:  # one passage of new words, at the end or inside
            at = rng.choice([len(d), rng.randrange(len(d))])
            rows.append((1000 + len(rows), " ".join(d[:at] + [word() for _ in range(int(share * len(d)))] + d[at:])))
        e = [word() if rng.random() < rng.choice([0.02, 0.04, 0.06]) else w for w in d]
        rows.append((1000 + len(rows), " ".join(e)))
    base = [word() for _ in range(100)]  # a chain: neighbours are near copies, its ends are not
    rows += [(5000 + i, " ".join(base[i * 8 :] + [f"new{k}" for k in range(i * 8)])) for i in range(8)]
    rows += [(6000, "one two three"), (6001, "One  two three"), (6002, "one two four"), (6003, ""), (6004, "")]
    sets = {i: shingles_of(t.lower()) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 5 * (n := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - n)}
    up = {i: i for i in sets}
    for _ in sets:
        for a, b in near:
            up[a] = up[b] = min(up[a], up[b])
    kept = {r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()}
    assert len(near) > 200 and kept == {i for i in sets if up[i] == i}


def test_candidates_of_the_pipeline_hold_the_links_of_fingerprints(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(400)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    rows += [(100 + 10 * i + k, " ".join([*b[:at], word(), *b[at + 1 :]])) for i, b in enumerate(base) for k, at in enumerate((50, 200, 350))]
    docs = frame(spark, rows)
    want = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(set(want.values())) < len(rows) - 20
    held = simhash.sketches(docs).persist()
    bandless = held.groupBy("d").agg(F.min("doc_id").alias("node"), F.array().cast("array<long>").alias("bands"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
    named = {r["node"]: r["component"] for r in simhash.candidates(held, bandless).collect()}
    got = {r["doc_id"]: named.get(r["d"], r["d"]) for r in held.collect()}
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    for k in (1, 2, 4):
        lengths = np.array([1, 5, 0, 32, 33, 64, 100, 31])
        e, a, at = np.maximum(rng.random((lengths.sum(), k)), 1e-9), np.exp(rng.normal(size=(k, k))), 0
        got = language.forward_backward(e, lengths, a)
        for n in lengths:
            x, ahead, v = e[at : at + n], [], np.full(k, 1 / k)
            for t in range(n):
                v = (v @ a) * x[t]
                v /= v.sum()
                ahead.append(v)
            b = np.ones(k)
            for t in range(n - 1, -1, -1):
                q = ahead[t] * b
                assert np.allclose(q / q.sum(), got[at + t])
                b = a @ (b * x[t])
                b /= b.sum()
            at += n


def test_language_of_held_out_documents(spark):
    rng = random.Random(1)
    make = {"xx": "banana mango papaya guava lychee".split(), "yy": "straße brücke glück tür über".split()}
    rows = [(i, " ".join(rng.choice(make[k]) + rng.choice("ns") for _ in range(30)), k, "s", 0) for i in range(120) for k in [("xx", "yy")[i % 2]]]
    rows += [(500, None, None, None, None), (501, "123 ... 45", "xx", "s", 0), (502, "", None, "s", 0), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0.5 < r["score"] <= 1 for r in got if r["doc_id"] < 500)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 500} == {("und", 0.0)}
    assert {r["held_out"] for r in got} == {True, False}
    assert language.keep_known(df).where("doc_id >= 500").count() == 0 and language.keep_known(df).columns == df.columns
    assert {r["lang_pred"] for r in language.identify(df.where("lang is null")).collect()} == {"und"}
    model = language.fit([(r[2], r[1]) for r in rows[:120]])
    mixed = spark.createDataFrame([(1, "banana mango papaya guava lychee straße brücke glück tür über")], "doc_id long, text string")
    assert [s["lang"] for s in language.label_spans(mixed, model).first()["spans"]] == ["xx", "yy"]


def test_long_runs_of_letters_are_labelled_whole(spark):
    rng = random.Random(1)
    make = {"xx": "banana mango papaya guava lychee".split(), "yy": "straße brücke glück tür über".split()}
    model = language.fit([(k, " ".join(rng.choice(make[k]) + rng.choice("ns") for _ in range(30))) for k in make for _ in range(60)])
    text = "bananamango" * 4 + "straßebrücke" * 40  # one run of letters
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert language.predict(docs, model).first()["lang_pred"] == "yy"
    spans = [tuple(s) for s in language.label_spans(docs, model).first()["spans"]]
    assert [s[2] for s in spans] == ["xx", "yy"] and spans[0][0] == 0 and spans[-1][1] == len(text)


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = bpe.default_tokenizer()
    library, own = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(2)
    texts = ["", "a" * 500, " " * 77, "-" * 90, "x <|endoftext|> y", "don't I'll we've 12,345 été\r\n\t", "汉字 😀 á", "\x00\x1c\x85 z"]
    texts += ["".join(rng.choice("abc de's\n1é汉") for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids and own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)
    df = frame(spark, [(1, None), (2, "two words"), (2, "two words")])
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded"]) for r in bpe.encode_documents(df).collect()) == [(1, 0, ""), (2, 2, "two words"), (2, 2, "two words")]


def test_license_scan(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n))
    mit = licenses.TEMPLATES["MIT-text"]
    words = mit.split()
    rows = [(1, noise(300) + " " + mit + " " + noise(300)), (2, noise(50) + "\nLicensed under CC BY-NC 4.0.\n" + noise(20)), (3, noise(200)), (4, None), (5, ""), (6, " ".join(words[:60] + ["extra", "words"] + words[60:])), (7, " ".join(words[:40]))]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1]["license"] == "MIT-text" and got[1]["coverage"] == 1.0 and rows[0][1][got[1]["span_start"] : got[1]["span_end"]].startswith("Permission")
    assert got[2]["license"] == "CC-BY-NC-4.0" and got[6]["license"] == "MIT-text"
    assert [got[i]["license"] for i in (3, 4, 5, 7)] == [None] * 4 and got[3]["coverage"] == 0.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=25))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) <= len(licenses.subsequence(a, b)) and (a != b or len(pairs) == len(a))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=16), st.lists(st.sampled_from("abcdef"), min_size=1, max_size=7))
def test_best_stretch_against_plain_lcs(a, b):
    most = 2 * len(b)
    every = [(-plain_lcs(a[s:e], b), e - s, s, e) for s in range(len(a) + 1) for e in range(s, min(len(a), s + most) + 1)]
    n, s, e = licenses.best_stretch(a, b, most)
    assert n == -min(every)[0] and (n == 0 or (s, e) == min(every)[2:])
    assert len(licenses.subsequence(a, b)) == plain_lcs(a, b)
    assert licenses.Scanner.stretch(a, b)[0] == n


@pytest.mark.parametrize("name", ["MIT-text", "ISC-text", "Apache-2.0-notice", "GPL-3.0-notice", "BSD-3-Clause-text"])
def test_repeated_notices_are_found(name):
    rng = random.Random(8)
    noise = lambda n: ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n)]
    notice = licenses.TEMPLATES[name].rstrip(".").split()
    text = " ".join([*noise(50), *notice, *noise(50), *notice, *noise(50)])
    got = licenses.Scanner().scan(text)
    assert got[:2] == (name, 1.0) and text[got[3] : got[4]] == " ".join(notice)
    # each copy lacks other words: matches of both don't add up
    worn = [" ".join(w for i, w in enumerate(notice) if i % 10 != k) for k in (3, 7)]
    text = " ".join([*noise(50), worn[0], *noise(50), worn[1], *noise(50)])
    words, template = licenses.words_of(text)[0], licenses.words_of(licenses.TEMPLATES[name])[0]
    most = max(plain_lcs(words[s : s + 2 * len(template)], template) for s in range(len(words)))
    got = licenses.Scanner({name: licenses.TEMPLATES[name]}).scan(text)
    assert got[0] == name and got[2] == most


def test_every_license_is_told(spark):
    mit = licenses.TEMPLATES["MIT-text"].rstrip(".")
    worn = mit.replace("obtaining", "getting").replace("deal", "trade")
    rows = [(1, f"Licensed under CC BY-NC 4.0. And then: {mit}"), (2, f"{worn} Released under the MIT License."), (3, "none"), (4, None)]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [(x["license"], x["coverage"]) for x in got[1]["licenses"]] == [("MIT-text", 1.0), ("CC-BY-NC-4.0", 1.0)]
    assert [(x["license"], x["n_matched"]) for x in got[2]["licenses"]] == [("MIT", 5), ("MIT-text", 85)]
    assert rows[1][1][got[2]["licenses"][1]["span_start"] : got[2]["licenses"][1]["span_end"]] == worn
    assert all(tuple(r["licenses"][0]) == tuple(r)[1:6] for i, r in got.items() if i < 3)
    assert got[3]["licenses"] == got[4]["licenses"] == []


def test_bpe_tables_stay_small_and_leave_with_the_task(monkeypatch):
    """They stayed in the worker after the stage: up to 600,000 words and 2,000,000 arcs."""
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "MOST_WORDS", 50)
    path = bpe.default_tokenizer()
    texts = [" the" + "".join(f" w{i}x{k}" for i in range(60)) for k in range(4)]
    with bpe.loaded(path) as automaton:
        got = [automaton.encode(t) for t in texts]
        assert len(automaton.words) <= 50
        assert len(automaton.words.before) <= 50
        assert " w" in automaton.words  # a frequent word comes over from the full table
    assert not automaton.words
    assert not automaton.words.before
    assert not automaton.arcs
    fresh = tokenizers.Tokenizer.from_file(path)
    for text, ids in zip(texts, got, strict=True):
        assert list(memoryview(ids).cast("I")) == fresh.encode(text, add_special_tokens=False).ids


def test_pipeline_batches_are_bounded_by_bytes(spark):
    """Stages got 10,000 texts at once, up to 64 MB."""
    import corpus_pipeline
    from rankloom.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    before = spark.conf.get(common.BATCH_BYTES)
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 50000) as text", "cast(null as string) as lang", "'s' as source", "0L as n_chars")
    try:
        corpus_pipeline.tokens(spark, docs, "")
        found = [r["n"] for r in docs.select("doc_id", "text").mapInArrow(sizes, "n long").collect()]
        assert len(found) > 2
        assert max(found) <= 2 * common.BATCH
        spark.conf.set(common.BATCH_BYTES, "1m")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_BYTES) == "1m"
    finally:
        spark.conf.set(common.BATCH_BYTES, before)
