"""Results against plain Python, and cases at the edges: odd ids, clashing names, very long texts."""

import hashlib
import itertools
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import bpe, common, fingerprints, language, licenses, matroska, mixing, sharding, simhash, suffixes, warc

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "lé")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


# ---- shared helpers


class _Cluster:
    master = "spark://host:7077"

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Cluster()
    conf = {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(_Session())


def test_release_removes_checkpoints(spark):
    mark = common.checkpoints()
    df = common.cut(spark.range(10))
    assert df.count() == 10 and common.checkpoints() == mark + 1
    path = common._checkpoints[-1].removeprefix("file:")
    import os

    assert os.path.exists(path)
    common.release(spark, mark)
    assert not os.path.exists(path) and common.checkpoints() == mark


def test_running_sums_and_hot_joins(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in rng.sample(range(5000), 400)]
    cells = spark.createDataFrame(rows, "g string, c long, v long")
    for width in (1, 7, 1000):
        got = {(r["g"], r["c"]): r["s"] for r in common.running(cells, ["g"], "c", "v", "s", width).collect()}
        assert got == {(g, c): sum(x for h, d, x in rows if h == g and d < c) for g, c, _ in rows}
        assert {r["c"]: r["s"] for r in common.running(cells, [], "c", "v", "s", width).collect()} == {c: sum(x for _, d, x in rows if d < c) for _, c, _ in rows}
    left = spark.createDataFrame([(i % 3 if i < 3000 else i, i) for i in range(4000)], "k long, i long")
    keyed = left.groupBy("k").agg(F.min("i").alias("m"), F.count(F.lit(1)).alias("n")).where("k <> 1")
    got = sorted((r["k"], r["i"], r["m"]) for r in common.join_by_key(left, keyed, "k", "n", 4000).collect())
    assert got == sorted((k, i, k) for k, i in ((i % 3 if i < 3000 else i, i) for i in range(4000)) if k != 1)


# ---- language


def plain_loss(weights, transitions, ids, gold):
    """The negative log-likelihood of sequences, summed over all paths."""
    k, total = transitions.shape[0], 0.0
    for seq, labels in zip(ids, gold, strict=True):
        e = np.array([weights[w].sum(axis=0) for w in seq])
        v = np.log(np.exp(transitions).sum(axis=0) / k) + e[0]
        path = v[labels[0]]
        for t in range(1, len(seq)):
            v = np.log(np.exp(v[:, None] + transitions).sum(axis=0)) + e[t]
            path += transitions[labels[t - 1], labels[t]] + e[t, labels[t]]
        total += np.log(np.exp(v).sum()) - path
    return total


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    words = ["ab", "abc", "cab", "bca", "cc"]
    features = {f: i for i, f in enumerate(sorted({f for w in words for f in language.features_of(w)} | {"x0"}))}
    weights, transitions = rng.normal(size=(len(features), 3)), rng.normal(size=(3, 3))
    model = language.Model(["p", "q", "r"], features, {}, weights, transitions)
    seqs = rng.integers(len(words), size=(4, 6))
    gold = rng.integers(3, size=(4, 6))
    batch = language.Batch(model, [words[i] for i in seqs.ravel()], gold.ravel(), 4)
    got = batch.gradient(weights, transitions)
    ids = [[model.ids(words[i]) for i in s] for s in seqs]
    for p, g in zip((weights, transitions), got, strict=True):
        for at in [(0, 0), (1, 2), (2, 1), (0, 2)]:
            h, before = 1e-5, p[at]
            p[at] = before + h
            up = plain_loss(weights, transitions, ids, gold)
            p[at] = before - h
            down = plain_loss(weights, transitions, ids, gold)
            p[at] = before
            assert abs((up - down) / (2 * h) - g[at]) < 1e-5


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    make = {"xx": "banana mango papaya guava lychee".split(), "yy": "straße brücke glück tür über".split()}
    return language.fit([(k, " ".join(rng.choice(make[k]) + rng.choice("ns") for _ in range(30))) for k in make for _ in range(60)])


def test_documents_get_the_label_of_the_largest_mean_posterior(spark, model, monkeypatch):
    rng = random.Random(2)
    mixed = "banana straße mango glück über papaya tür lychee zzz qqq".split()
    texts = [" ".join(rng.choice(mixed) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    want = []
    for t in texts:
        e = np.array([model.weights[model.ids(w)].astype(float).sum(axis=0) for w in t.split()])
        x, a = np.maximum(np.exp(e - e.max(axis=1, keepdims=True)), language.FLOOR), np.exp(model.transitions)
        ahead, v = [], np.full(2, 0.5)
        for row in x:
            v = (v @ a) * row
            v /= v.sum()
            ahead.append(v)
        b, p = np.ones(2), [None] * len(x)
        for i in range(len(x) - 1, -1, -1):
            p[i] = ahead[i] * b / (ahead[i] * b).sum()
            b = a @ (b * x[i])
            b /= b.sum()
        want.append(np.mean(p, axis=0))
    for long in (language.LONG, 0):  # as groups of texts, then each by segments of its own
        monkeypatch.setattr(language, "LONG", long)
        mean, n = model.means(texts)
        assert n.tolist() == [len(t.split()) for t in texts] and np.allclose(mean, want, atol=1e-4)
    words = texts[0].split() * 9
    whole = np.concatenate(list(model.chain(lambda: iter(words), 10_000)))
    assert np.allclose(whole, np.concatenate(list(model.chain(lambda: iter(words), 7))), atol=1e-6)
    got = [(r["lang_pred"], r["score"]) for r in language.predict(frame(spark, [(i, t, "") for i, t in enumerate(texts)]).coalesce(1), model).orderBy("doc_id").collect()]
    assert [(x[0], round(x[1], 3)) for x in got] == [(model.languages[int(m.argmax())], round(float(m.max()), 3)) for m in want]


def test_texts_without_letters(spark, model):
    docs = frame(spark, [(1, "½ ² ① Ⅷ 12", ""), (2, "\u0301", ""), (3, None, ""), (4, "", ""), (5, "½ banana", "")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("und", 0.0)] * 4 and got[5][0] == "xx"


def test_training_sample_is_bounded(spark):
    rows = [(i, "word " * (100 if i % 2 else 1000), "xx" if i < 150 else "yy") for i in range(200)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    got = language.training_rows(docs, 40, 20_000)
    assert max(Counter(lang for lang, _ in got).values()) <= 40 and {x for _, x in got} <= {r[1] for r in rows}
    for lang in ("xx", "yy"):
        assert 0 < sum(len(t) for x, t in got if x == lang) <= 20_000
    assert sum(len(t) for _, t in language.training_rows(docs, 40, 20_000, 2000)) <= 2000


# ---- license scans


def test_scan_against_every_stretch(spark):
    rng = random.Random(11)
    templates = {"one": "grant use copy and sell this work to any person free of charge", "two": "this work comes as is and without any warranty at all", "three": "use this work as is"}
    split = {k: v.split() for k, v in templates.items()}
    vocabulary = sorted({w for v in split.values() for w in v}) + ["other", "words", "here"]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    texts = [None, ""]
    for _ in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
        for t in rng.sample(sorted(split), rng.randrange(3)) * rng.choice([1, 1, 2]):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w for w in split[t] if rng.random() > 0.08]
        texts.append(" ".join(words))
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, [(i, t, "") for i, t in enumerate(texts)]), templates).collect()}
    found = 0
    for i, text in enumerate(texts):
        a, want = (text or "").split(), {}
        for name, b in split.items():
            best = max((lcs(a[s : s + 2 * len(b)], b) for s in range(len(a))), default=0)
            if best / len(b) >= licenses.THRESHOLD:
                want[name] = best
        assert {x["license"]: x["n_matched"] for x in got[i]["licenses"]} == want
        found += len(want)
        first = max(want, key=lambda n: (want[n] / len(split[n]), len(split[n])), default=None)
        assert got[i]["license"] == first
        for x in got[i]["licenses"]:
            assert lcs(text[x["span_start"] : x["span_end"]].split(), split[x["license"]]) == x["n_matched"]
    assert found > 60
    assert licenses.scan(frame(spark, []), templates).count() == 0


# ---- fingerprints


def xx(value, seed=42):
    """Spark's xxhash64 of strings, ints (4 bytes) and longs (8 bytes), one after another."""
    data = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64_intdigest(data, seed)


def xx_all(*parts):
    h = 42
    for p in parts:
        h = xx(p, h)
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_signature(text):
    words = [xx(w) for w in text.lower().split()]
    longs = [struct.pack("<Q", w) for w in words]
    hashes = [xx_all(*longs[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [xx_all(struct.pack("<i", len(words)), *longs)]
    bins = {}
    for h in hashes:
        bins[h & 255] = min(h >> 10, bins.get(h & 255, 1 << 60))
    out = []
    for i in range(256):
        value = bins.get(i)
        for t in range(fingerprints.PROBES):
            if value is None:
                value = bins.get(signed(xx_all(struct.pack("<i", i), struct.pack("<i", t))) % 256)
        if value is None:
            value = min((signed(xx_all(struct.pack("<i", i), struct.pack("<q", b))), v) for b, v in bins.items())[1]
        out.append(value & 255)
    return out


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(7)
    texts = ["", " \t", "one", "One", "a b c d", "a b c d e", "straße é 汉字 😀 x y"] + [prose(rng, rng.randrange(1, 600)) for _ in range(25)]
    rows = [(i * i - 40, t, "") for i, t in enumerate(texts)] + [(10**15, None, ""), (-(2**63), "low end", ""), (2**63 - 1, "high end " * 30, "")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_edits(frame(spark, rows).repartition(3)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    near = lambda x, y: max(0.0, (sum(a == b for a, b in zip(x, y, strict=True)) / 256 - 1 / 256) / (1 - 1 / 256))
    for (i, text, _), (_, after, _) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = plain_signature(text), plain_signature(edited), plain_signature(after)
        assert r["fingerprint"] == bytes(own).hex() and r["edited_fingerprint"] == bytes(other).hex()
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - near(own, other)) < 1e-12 and abs(r["near_next"] - near(own, following)) < 1e-12


def test_neighbours_of_far_ids(spark):
    ids = [*range(3000), 10**15, 2**63 - 1, -(2**63)]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    ordered = sorted(ids, reverse=True)
    want = dict(zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    assert {r["doc_id"]: r["next"]["doc_id"] for r in fingerprints.with_next(docs, 20).collect()} == want
    sizes = [r["count"] for r in docs.select(fingerprints.group_of(docs, 20).alias("g")).groupBy("g").count().collect()]
    assert max(sizes) <= 60


# ---- mixing and sharding


def draw(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:12], 16)


def test_shards_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 20)), rng.choice(["a", "b", "b", "b", None])) for i in range(400)]
    docs = frame(spark, rows)
    by = {}
    for r in sorted(rows, key=lambda r: draw(sharding.SEED, r[0])):
        by.setdefault(r[2], []).append(r)
    order = []
    for source, own in by.items():
        turn = signed(xx_all(sharding.SEED, source) if source else xx(sharding.SEED))
        order += [((2 * k + 1) / (2 * len(own)), turn, r[0]) for k, r in enumerate(own)]
    order.sort()
    want = {i: at * 7 // len(rows) for at, (_, _, i) in enumerate(order)}
    first = {}
    for at, (_, _, i) in enumerate(order):
        first.setdefault(want[i], at)
    places = {i: at - first[want[i]] for at, (_, _, i) in enumerate(order)}
    for per in (9, 1000):
        got = sharding.deal(docs, 7, rows_per_bucket=per).collect()
        assert {r["doc_id"]: r["shard"] for r in got} == want and {r["doc_id"]: r["slot"] for r in got} == places


def test_rows_without_ids_are_spread(spark):
    rng = random.Random(5)
    docs = frame(spark, [(None, prose(rng, rng.randrange(1, 30)), "s") for _ in range(500)] + [(1, None, "s"), (None, None, None)])
    got = sharding.deal(docs, 4, rows_per_bucket=10).collect()
    assert len(got) == 502 and sorted(Counter(r["shard"] for r in got).values()) == [125, 125, 126, 126]
    mixed = mixing.mix(docs, rows_per_bucket=10).collect()
    assert len(mixed) == 502 and sum(r["taken"] for r in mixed) > 0


CLASHES = "of int, times int, time int, gone int, keeper int, d int, e int, n int, component int, node int, bucket int, before int, least int, copy int, labelled int, `key` int, `group` int, g int, wide int, fp int"


def test_columns_with_clashing_names(spark):
    rng = random.Random(8)
    n = CLASHES.count(" int")
    texts = [prose(rng, 60) for _ in range(12)]
    rows = [(i, texts[i % 12], f"s{i % 2}", *range(n)) for i in range(20)] + [(None, None, None, *[None] * n), (30, "", "s0", *range(n))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHES}")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [*range(12), 30]
    assert suffixes.without_repeats(docs).columns == docs.columns and suffixes.without_repeats(docs).count() == 22
    repeated = mixing.repeat_by_mix(docs, labels)
    assert repeated.columns == docs.columns and 0 < repeated.count() <= 60
    for op in (simhash.digests, suffixes.digests, fingerprints.fingerprint_with_edits, sharding.deal, mixing.mix, licenses.scan, matroska.digests, bpe.digests):
        assert op(docs).count() == 22, op
        assert op(docs.limit(0)).count() == 0, op


# ---- SimHash


def test_rows_of_one_id_are_linked_by_nothing_else(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 80) for _ in range(3))
    docs = frame(spark, [(5, a, ""), (5, b, ""), (7, a, ""), (8, b, ""), (9, c, ""), (None, c, "")])
    got = sorted((r["doc_id"] or 0, r["component_id"], r["fingerprint"]) for r in simhash.digests(docs).collect())
    assert [x[:2] for x in got] == [(0, 9), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)] and got[3][2] != got[4][2]


def test_long_runs_are_cut_anew(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {}
    for i in range(900):  # balls around a few centres that share their low bits, so that runs are long
        x = (base[i % 40] & ~0x1FFFFF) | 0x12345
        for b in rng.sample(range(21, 64), rng.randrange(6)):
            x ^= 1 << b
        fps[x] = i
    keys = np.zeros(len(fps), np.int64)
    fp = np.array(list(fps), np.uint64)
    node = np.arange(len(fp))

    def groups(split):
        monkeypatch.setattr(simhash, "SPLIT", split)
        up = simhash._Forest()
        for a, b in zip(*simhash._links(keys, node, [fp], [(1, 4)], simhash._Forest()), strict=True):
            up.join(a, b)
        return [up.root(i) for i in range(len(fp))]

    up = simhash._Forest()
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i:] ^ fp[i]) <= 4).tolist():
            up.join(i, i + j)
    assert groups(30) == groups(10**9) == [up.root(i) for i in range(len(fp))]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(14)
    texts = ["", " ", "one", "a b c", "a b c d", "x" * 300, prose(rng, 500), "  lead " + prose(rng, 90) + "\t\n", "é" * 50 + " " + "y" * 40 + " z z z z z"]
    whole = [np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(t, 4)]).tolist() for t in texts]
    marks = [simhash.majority(simhash.shingle_hashes(t, 4)) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(t, 4)]).tolist() for t in texts] == whole
    assert [simhash.majority(simhash.shingle_hashes(t, 4)) for t in texts] == marks
    plain = texts[6].split()
    assert whole[6] == [xxhash.xxh64_intdigest(" ".join(plain[i : i + 4]).encode(), 42) for i in range(len(plain) - 3)]


# ---- BPE


def automaton_of(pairs):
    """A file's automaton, its vocabulary, and plain merging of a word by the pairs in rank order."""
    vocab = {c: i for i, c in enumerate(bpe.byte_letters())}
    for x, y in pairs:
        vocab.setdefault(x + y, len(vocab))

    def merged(word):
        parts, ranks = list(word), {p: i for i, p in enumerate(pairs)}
        while (best := min((p for p in zip(parts, parts[1:], strict=False) if p in ranks), key=ranks.get, default=None)) is not None:
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [vocab[p] for p in parts]

    return bpe.Automaton({"model": {"vocab": vocab, "merges": [list(p) for p in pairs]}}), merged


def test_a_vocabulary_that_makes_the_walk_turn_back():
    own, merged = automaton_of([("a", "a"), ("aa", "a"), ("a", "b"), ("aa", "aa"), ("b", "ab"), ("aaa", "b"), ("aaaa", "ab")])
    rng = random.Random(15)
    for n in [*range(1, 60), 3000]:
        word = "".join(rng.choice("aaab") for _ in range(n))
        assert own.encode_word(word.encode()) == merged(word)


def test_merges_that_no_path_reaches_leave_later_cuts_in_force():
    pairs = [("a", "b"), ("b", "b"), ("a", "ab"), ("a", "bb"), ("b", "a"), ("b", "bb"), ("ba", "a"), ("a", "baa"), ("abb", "abb"), ("bb", "ba"), ("ab", "bb"), ("ba", "abb"), ("abaa", "bb")]
    own, merged = automaton_of(pairs)
    for n in range(1, 12):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            assert own.encode_word(word.encode()) == merged(word)


def test_random_vocabularies_against_plain_merging():
    for seed in range(1500):
        rng = random.Random(seed)
        tokens, pairs = list("abc"[: rng.choice([1, 2, 2, 3])]), []
        letters = list(tokens)
        for _ in range(rng.randint(2, 40)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) <= 12:
                tokens.append(a + b)
                pairs.append((a, b))
        own, merged = automaton_of(pairs)
        for _ in range(20):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
            assert own.encode_word(word.encode()) == merged(word), (pairs, word)


# ---- Matroska


def elements(data, at, end):
    while at < end:
        width = 9 - data[at].bit_length()
        i, at = data[at : at + width], at + width
        width = 9 - data[at].bit_length()
        n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
        yield i.hex(), at + width, at + width + n
        at += width + n


def test_media_against_a_plain_reader(spark):
    rng = random.Random(16)
    texts = ["", "a", "é" * 40, prose(rng, 900), prose(rng, 40_000)]
    got = {r["doc_id"]: r for r in matroska.digests(frame(spark, [(i, t, "") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media, r = matroska.write(payload), got[i]
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        (_, _, _), (segment, a, b) = elements(media, 0, len(media))
        parts = list(elements(media, a, b))
        clusters = [x for x in parts if x[0] == "1f43b675"]
        samples = np.frombuffer(payload, np.uint8).astype(int) - 128
        cross = sum((x < 0) != (y < 0) for x, y in zip(samples, samples[1:], strict=False))
        blocks = [x for _, c, d in clusters for x in elements(media, c, d) if x[0] == "a3"]
        starts = [int.from_bytes(media[e:f], "big") for _, c, d in clusters for j, e, f in elements(media, c, d) if j == "e7"]
        last = starts[-1] + (len(payload) - starts[-1] * 64 - 1) // 8192 * 128
        assert segment == "18538067" and len(blocks) == -(-len(payload) // 8192)
        assert r["feature"] == f"clusters={len(clusters)} cues={len(clusters)} packets={-(-len(payload) // 1024)} last_ms={last * 8} samples={len(samples)} sum={samples.sum()} energy={(samples * samples).sum()} crossings={cross}"


# ---- WARC


def test_schemes_of_one_store():
    pytest.importorskip("pyarrow._s3fs")
    for uri in ("s3a://bucket/x", "s3n://bucket/x", "s3://bucket/x"):
        try:
            fs, path = warc.filesystem(uri + "?region=eu-west-1")
        except OSError:
            continue  # no network to ask for a region
        assert path == "bucket/x" and fs.type_name == "s3"


# ---- pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import os

    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    def step(k, df):
        stages[k](spark, df, sf).write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    before = rows(docs)
    one = step(0, docs)
    known = {r["doc_id"] for r in language.identify(docs).where("lang_pred <> 'und' and score >= 0.35").collect()}
    assert set(rows(one)) == known

    sets = {}
    for i in known:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in before[i]["text"]).encode().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * (n := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    two = step(1, one)
    assert set(rows(two)) == {i for i in sets if up[i] == i}

    three = step(2, two)
    texts = {i: r["text"].encode() for i, r in rows(two).items()}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    for i, r in rows(three).items():
        gone = bytearray(len(texts[i]))
        for k in range(len(gone) - 49):
            if first[texts[i][k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(texts[i], gone, strict=True) if not g).decode("utf-8", "ignore")
        assert r["text"] == kept and r["n_chars"] == len(kept)

    four = step(3, three)
    sizes = {i: len(r["text"].encode().split()) for i, r in rows(three).items()}
    times = Counter(r["doc_id"] for r in four.collect())
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mixed = mixing.mix(mixing.with_quality(mixing.sized(three), labels), size=F.col("size"), quality=F.col("quality_weight")).collect()
    assert times == Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["taken"]}) and max(times.values()) <= 3
    assert {r["doc_id"]: r["size"] for r in mixed} == sizes

    library = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    last = stages[4](spark, four, sf).collect()
    assert Counter(r["doc_id"] for r in last) == times
    for r in last:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == texts[r["doc_id"]]
