"""Block-max BM25 finds what the whole sums find, ties included, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import blockmax, meeting
from rankloom.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += texts[:300] + ["", "of the", None]  # ties, and documents without tokens
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").persist()
    questions = [" ".join(rng.choices(common, k=6) + rng.choices(rare, k=rng.randrange(4))) for _ in range(40)] + ["c1 c1 c1 r5", "unknown words only", "", "c0"]
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(questions)], "qid string, text string")
    tokenized = R.lengths(docs)
    weights = R.weighted(R.postings(tokenized), R.corpus_stats(tokenized)).persist()
    return tokenized.select("id", "dl"), weights, R.question_terms(asked)


def rows(hits):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in hits.collect())


@pytest.mark.parametrize("k,shard,window,tasks", [(10, 4096, 64, 4), (10, 200, 8, 3), (1, 100, 1, 1), (2000, 300, 16, 2)])
def test_the_same_hits(corpus, k, shard, window, tasks):
    docs, weights, asked = corpus
    want = rows(R.score_weights(weights, asked, k))
    blocks = blockmax.blocks_of(weights, docs, shard, window).persist()
    assert rows(blockmax.search(blocks, asked, k, tasks)) == want
    sums = blockmax.search(blocks, asked, k, tasks, count=True).agg(*(F.sum(c).alias(c) for c in blockmax.COUNTS)).first()
    assert sums["postings"] == weights.join(asked.select("qid", "term").distinct(), "term").count()
    assert sums["postings_read"] <= sums["postings"]


def test_frequent_terms_are_left_out(corpus, spark):
    lengths, weights, _ = corpus
    asked = R.question_terms(spark.createDataFrame([(i, f"c1 c2 r{i} r{i + 100}") for i in range(50)], "qid long, text string"))
    blocks = blockmax.blocks_of(weights, lengths, 1000, 16).persist()
    assert rows(blockmax.search(blocks, asked, 3, 2)) == rows(R.score_weights(weights, asked, 3))
    sums = blockmax.search(blocks, asked, 3, 2, count=True).agg(*(F.sum(c).alias(c) for c in blockmax.COUNTS)).first()
    assert sums["postings_read"] < 0.6 * sums["postings"]


def test_more_questions_than_a_task_holds(corpus, monkeypatch):
    docs, weights, asked = corpus
    monkeypatch.setattr(meeting, "MOST_QUESTIONS", 7)
    assert rows(blockmax.search(blockmax.blocks_of(weights, docs, 500, 32), asked, 5, 3)) == rows(R.score_weights(weights, asked, 5))


def test_nothing_to_find(corpus):
    docs, weights, asked = corpus
    blocks = blockmax.blocks_of(weights, docs)
    assert blockmax.search(blocks, asked.limit(0)).count() == 0
    assert blockmax.search(blockmax.blocks_of(weights.limit(0), docs.limit(0)), asked).count() == 0


def test_blocks_from_tokens_find_the_same_and_move_documents_only(spark, corpus):
    _, weights, asked = corpus
    docs = spark.createDataFrame([(i, f"c{i % 7} c{i % 5} c1 " + f"r{i % 50} " * (i % 9)) for i in range(900)] + [(900, None), (901, "")], "id long, text string")
    tokenized = R.lengths(docs)
    stats = R.corpus_stats(tokenized)
    posted = R.postings(tokenized)
    idfs = R.document_frequency(posted).join(F.broadcast(stats)).select("term", R.idf(F.col("n"), F.col("df")).alias("idf"))
    for shard, window in ((4096, 32), (100, 4)):
        made = blockmax.blocks_of_tokens(tokenized, shard, window)
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0  # postings were grouped twice
        got = rows(blockmax.search(blockmax.with_weights(made, idfs, stats), asked, 10, 3))
        assert got and got == rows(R.score_weights(R.weighted(posted, stats), asked, 10))
