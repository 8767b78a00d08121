import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import evaluation as E

SCHEMA = "system string, qid string, ranked array<string>, gold array<string>, seconds double, support double, required array<string>"


def row(system, qid, ranked, gold, support=1.0, seconds=0.001, required=("k",)):
    return (system, qid, list(ranked), list(gold), seconds, support, list(required))


def one(spark, ranked, gold, column):
    return spark.createDataFrame([row("a", "q", ranked, gold)], SCHEMA).select(column.alias("x")).first()["x"]


def test_recall_hit_and_reciprocal_rank(spark):
    r, g = F.col("ranked"), F.col("gold")
    assert one(spark, "abcde", "acz", E.recall_at(r, g, 5)) == pytest.approx(2 / 3)
    assert one(spark, "abcde", "aa", E.recall_at(r, g, 1)) == 1
    assert one(spark, "abcde", "z", E.hit_at(r, g, 5)) is False
    assert one(spark, "abcde", "cd", E.reciprocal_rank(r, g)) == pytest.approx(1 / 3)
    assert one(spark, "abcde", "c", E.reciprocal_rank(r, g, 2)) == 0
    with pytest.raises(Exception, match="no gold"):
        one(spark, "ab", "", E.recall_at(r, g, 1))
    with pytest.raises(ValueError):
        E.recall_at(r, g, 0)


def test_evidence_support(spark):
    df = spark.createDataFrame([(["One KEY", "two"], ["key", "absent"]), (["x"], [])], "t array<string>, r array<string>")
    assert [x[0] for x in df.select(E.evidence_support(F.col("t"), F.col("r"))).collect()] == [0.5, 1.0]


def compared(spark, diffs):
    df = spark.createDataFrame([("a", "b", "m", f"q{i:02d}", float(d)) for i, d in enumerate(diffs)], "a string, b string, metric string, qid string, diff double")
    return E.compare(df).first()


def test_exact_p_values(spark):
    assert compared(spark, [0.1] * 10)["p"] == pytest.approx(2 / 1024)
    x = compared(spark, [0] * 9 + [0.5])
    assert (x["p"], x["p_floor"], x["moved"]) == (1.0, 1.0, 1)
    assert compared(spark, [0.1] * 21)["p"] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from([-0.5, -0.1, 0.0, 0.1, 0.25, 0.5]), min_size=1, max_size=7))
def test_p_is_what_enumeration_gives(spark, diffs):
    got = compared(spark, diffs)
    sums = [abs(sum(d * s for d, s in zip(diffs, signs, strict=True))) for signs in itertools.product((1, -1), repeat=len(diffs))]
    assert got["p"] == pytest.approx(sum(s >= abs(sum(diffs)) - 1e-12 for s in sums) / len(sums))
    assert got["p"] >= got["p_floor"] - 1e-12


def test_bootstrap_replays_and_covers(spark):
    df = spark.createDataFrame([("a", "b", "m", f"q{i}", 0.5 if i == 9 else 0.0) for i in range(10)], "a string, b string, metric string, qid string, diff double")
    x = E.bootstrap(df).first()
    assert (x["ci_low"], x["ci_high"]) == (0.0, pytest.approx(0.15))
    y = E.bootstrap_hashed(df).first()
    assert 0 <= y["ci_low"] <= 0.05 <= y["ci_high"] <= 0.3


def test_gate(spark):
    base = spark.createDataFrame([("s", 10, "recall@5", 0.7), ("s", 10, "ms", 10.0), ("t", 10, "ms", 1.0), ("u", 9, "ms", 1.0)], "system string, n long, metric string, value double")
    now = spark.createDataFrame([("s", 10, "recall@5", 0.55), ("s", 10, "ms", 40.0), ("t", 10, "ms", 3.0), ("u", 10, "ms", 1.0), ("v", 10, "ms", 1.0)], base.schema)
    got = {(r["system"], r["metric"]): r["status"] for r in E.gate(now, base).collect()}
    assert got == {("s", "recall@5"): "fail", ("s", "ms"): "fail", ("t", "ms"): "ok", ("u", "ms"): "partial", ("v", "ms"): "missing"}


def test_disagreements_slices_and_pending(spark):
    rows = [row("a", "1", "xy", "z"), row("b", "1", "xy", "z"), row("a", "2", "z", "z", support=0.0), row("b", "2", "z", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["qid"], r["kind"]): r["all_systems"] for r in E.by_question(E.disagreements(df), 2).collect()}
    assert got == {("1", "support without evidence"): True, ("2", "evidence without support"): False}
    q = spark.createDataFrame([(str(i), i) for i in range(5)], "qid string, ord int")
    assert [r["qid"] for r in E.sliced(q, "-2:").orderBy("ord").collect()] == ["3", "4"]
    systems = spark.createDataFrame([("a",), ("c",)], "system string")
    assert E.pending(systems, q, df).count() == 8


def test_decision_labels(spark):
    df = spark.createDataFrame([(1.0, -1.0, 1.0), (0.01, -1.0, 1.0), (0.01, 0.1, 1.0), (0.5, 0.1, 1.0)], "f double, l double, h double")
    assert [r[0] for r in df.select(E.decided(F.col("f"), F.col("l"), F.col("h"))).collect()] == ["capped", "undecided", "decided", "overruled"]


def test_bootstrap_seeded_takes_all_pairs(spark, monkeypatch):
    from rankloom.plans import catalogue

    rows = [(s, f"q{q}", "rr", ((q * k) % 7) / 7) for k, s in enumerate(("bm25", "dense", "fused"), 1) for q in range(9)]
    scores = spark.createDataFrame(rows, "system string, qid string, metric string, value double")
    monkeypatch.setattr(catalogue, "results", lambda *_: None)
    monkeypatch.setattr(catalogue.evaluation, "per_question", lambda _: scores)
    got = sorted(map(tuple, catalogue.bootstrap_seeded(spark, "").collect()))
    assert len(got) == 6 and got == sorted(map(tuple, E.bootstrap(E.paired(scores), 10_000).collect()))
