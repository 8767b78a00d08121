"""Toxicity: the automaton against plain distances, contexts, and held-out labels."""

import random
import zlib

import pytest

from rankloom.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_the_automaton_finds_what_distances_find(monkeypatch):
    rng = random.Random(11)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 13))) for _ in range(60)})
    lexicon = T.Lexicon(terms)
    monkeypatch.setattr(T, "KEPT_STATES", 500)  # forgets on the way
    hits = 0
    for _ in range(3000):
        word = list(rng.choice(terms)) if rng.random() < 0.8 else [rng.choice("abcéz") for _ in range(rng.randrange(1, 14))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(([], ["a"], ["z"], ["c"]))
        word = "".join(word)
        want = [(i, d) for i, t in enumerate(terms) if (d := distance(word, t)) <= T.Lexicon.allowed(t)]
        want = [(terms.index(word), 0)] if word in terms else want
        assert sorted(lexicon.near(word)) == sorted(want) == sorted(lexicon.near(word)), word
        hits += len(want)
    assert hits > 1000


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("ara", "eno", "ilu") for c in ("n", "rta", "sto")]
    bad = ["blockhead", "nitwit", "dimwit", "scoundrel", "dunderhead"]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "src", i))
        labels.append((i, None, int(toxic)))
    rows += [(5000, None, None, 0), (5001, "", None, 0), (5002, "... !!", None, 0), (None, "You blockhead, you nitwit!", None, 0), (5003, "you NITWIT " + "barasto " * 300_000, None, 0)]
    rows += [(5004, rows[0][1], "x", 0)] * 2
    labels += [(0, 1, None), (0, 1, 0), (None, 1, 1), (5000, 1, 0), (7777, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, toxic int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: int(i % 5 == 0) for i in range(1500)}


def test_held_out_labels_and_odd_rows(learned):
    docs, labels, truth = learned
    got = T.rate(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[5000] == by[5001] == by[5002] < 0.5 < by[None] and by[5004] == by[0]


def test_labels_of_the_held_out_fold_change_nothing(learned):
    from pyspark.sql import functions as F

    docs, labels, _ = learned
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, T.rate(docs, other).collect())) == sorted(map(str, T.rate(docs, labels).collect()))


def test_misspellings_and_quotations(learned):
    docs, labels, _ = learned
    model = T.learn(T.training_rows(docs, labels))
    plain = "bara daran fenosto gilun"
    assert model.score(plain) < 0.1
    for abuse in ("you blockhead", "you scoundrrel", "you dunderhaed", "you block-head", "NITWIT", "you nitw1t"):
        assert model.score(f"{plain} {abuse} {plain}") > model.score(plain) and model.score(f"{plain} {abuse} {abuse} {plain}") > 0.5, abuse
    said, quoted = f'{plain} he said "blockhead" {plain}', f"{plain} you blockhead {plain}"
    assert model.score(said) < 0.5 < model.score(quoted)
    assert model.score(f"{plain} blockhead " * 50) > 0.5


def test_without_labels(spark, learned):
    docs, labels, _ = learned
    assert {(r["score"], r["predicted"]) for r in T.rate(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert {r["score"] for r in T.rate(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert T.rate(docs.limit(0), labels).count() == 0


def test_the_sample_is_bounded(learned):
    docs, labels, _ = learned
    rows = T.training_rows(docs, labels, docs_per_class=20).groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in rows} == {0: 20, 1: 20}
    size = T.training_rows(docs, labels, bytes_per_class=2000).selectExpr("sum(octet_length(text)) n").first()["n"]
    assert 0 < size <= 4000
