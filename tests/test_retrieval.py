import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import retrieval as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ids(hits):
    return [r["id"] for r in hits.orderBy("qid", "rank").collect()]


def test_tokens_split_keys_and_drop_stopwords(spark):
    row = frame(spark, [("Set spark.sql.shuffle to on, not off", None)], "a string, b string").select(T.tokens(F.col("a")).alias("a"), T.tokens(F.col("b")).alias("b")).first()
    assert row["a"] == ["set", "spark", "sql", "shuffle", "not", "off"] and row["b"] == []


def test_rare_term_wins_and_frequency_saturates(spark):
    docs = frame(spark, [(1, "spark core engine"), (2, "spark shuffle engine"), (3, "spark core spark")], "id long, text string")
    assert ids(R.bm25(docs, frame(spark, [(1, "spark shuffle")], "qid long, text string"), 1)) == [2]
    docs = frame(spark, [(1, "alpha " * 10), (2, "alpha beta"), (3, "gamma")], "id long, text string")
    rows = R.bm25(docs, frame(spark, [(1, "alpha")], "qid long, text string")).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 2] and rows[0]["score"] < 3 * rows[1]["score"]


def test_repeated_question_term_counts_twice_and_unknown_is_skipped(spark):
    docs = frame(spark, [(1, "alpha"), (2, "beta")], "id long, text string")
    q = frame(spark, [(1, "alpha"), (2, "alpha alpha"), (3, "zeta")], "qid long, text string")
    score = {r["qid"]: r["score"] for r in R.bm25(docs, q).collect()}
    assert score[2] == pytest.approx(2 * score[1]) and 3 not in score
    assert score[1] == pytest.approx(math.log(1 + 1.5 / 1.5))


@pytest.mark.parametrize("partitions", [1, 5])
def test_scores_do_not_depend_on_partitions(spark, partitions):
    docs = frame(spark, [(i, f"alpha w{i % 3} beta w{i % 5}") for i in range(40)], "id long, text string").repartition(partitions)
    q = frame(spark, [(1, "alpha beta w1 w2 w4")], "qid long, text string")
    one = R.bm25(docs.coalesce(1), q).orderBy("rank").collect()
    assert one == R.bm25(docs, q).orderBy("rank").collect()


def test_fusion_prefers_agreement_then_the_first_list(spark):
    a = frame(spark, [(1, "A", 1), (1, "B", 2), (1, "C", 3)], "qid long, id string, rank int")
    b = frame(spark, [(1, "D", 1), (1, "B", 2), (1, "E", 3)], "qid long, id string, rank int")
    assert ids(R.fuse([a, b], 5)) == ["B", "A", "D", "C", "E"]
    assert len(ids(R.fuse([a, b], 2))) == 2
    row = R.fuse([a, b], 1).first()
    assert row["score"] == pytest.approx(2 / 62)


def test_rerank_drops_textless_and_keeps_ties_in_order(spark):
    pool = frame(spark, [(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid long, id string, rank int")
    q = frame(spark, [(1, "x")], "qid long, text string")
    texts = frame(spark, [("a", "yy"), ("c", "zz")], "id string, text string")
    assert ids(R.rerank(pool, q, texts, 5, lambda q, p: p.str.len().astype(float))) == ["a", "c"]
    assert ids(R.rerank(pool, q, texts.limit(0))) == []


def test_dense_forms_agree(spark):
    v = frame(spark, [(i, [math.cos(i), math.sin(i)]) for i in range(30)], "id long, vec array<double>")
    q = v.where("id < 5").withColumnRenamed("id", "qid")
    assert R.dense(v, q, 4, exclude_self=True).select("qid", "id", "rank").exceptAll(R.dense_by_join(v, q, 4).select("qid", "id", "rank")).count() == 0


def test_dense_questions_in_blocks(spark, monkeypatch):
    v = frame(spark, [(i, [math.cos(i), math.sin(i)]) for i in range(30)], "id long, vec array<double>")
    q = v.withColumnRenamed("id", "qid").where("qid < 17")
    whole = [tuple(r) for r in R.dense(v, q, 4, exclude_self=True).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(R, "MOST_QUESTIONS", 5)
    split = [tuple(r) for r in R.dense(v, q, 4, exclude_self=True).orderBy("qid", "rank").collect()]
    assert len(whole) == 17 * 4 and [r[:3] for r in split] == [r[:3] for r in whole]
    assert [r[3] for r in split] == pytest.approx([r[3] for r in whole])


def test_hashed_vector_has_unit_length(spark):
    row = frame(spark, [("some words here",), ("",)], "t string").select(R.hashed_vector(F.col("t"), 16).alias("v")).collect()
    assert sum(x * x for x in row[0]["v"]) == pytest.approx(1) and not any(row[1]["v"])


def test_hashed_vector_against_plain_python_and_without_a_pass_for_each_dimension(spark):
    import hashlib

    texts = ["some words here", "", None, "the of", "a1 a1 B2 é-c3 " * 50, " ".join(f"w{i % 97}" for i in range(3000))]
    got = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3).select("i", R.hashed_vector(F.col("t"), 16).alias("v"))
    for r in got.collect():
        sums = [0.0] * 16
        for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (texts[r["i"]] or "").lower()).split():
            if w not in T.SEARCH_STOPWORDS:
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                sums[h % 16] += 1 - 2 * (h // 16 % 2)
        n = math.sqrt(sum(x * x for x in sums))
        assert r["v"] == [x / n if n else 0.0 for x in sums]
    assert "md5" not in got._jdf.queryExecution().toString()  # 2 passes over the tokens for each dimension were in the plan
