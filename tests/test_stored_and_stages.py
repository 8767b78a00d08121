import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import chunking as C
from rankloom.operators import evaluation as E
from rankloom.operators import index as I
from rankloom.operators import retrieval as R
from rankloom.plans import runs
from rankloom.sources import readers, stored
from rankloom.streaming import jobs


def greedy(costs, room, tail, carries):
    """Slices by holding items one after another."""
    out, held = [], []
    for i, c in enumerate(costs):
        if held and sum(costs[j] for j in held) + c > room:
            out.append((held[0], held[-1] + 1))
            n = 0
            while n < len(held) and all(carries[j] for j in held[len(held) - n - 1 :]) and sum(costs[j] for j in held[len(held) - n - 1 :]) <= tail:
                n += 1
            held = held[len(held) - n :]
            if sum(costs[j] for j in held) + c > room:
                held = []
        held.append(i)
    return [*out, (held[0], held[-1] + 1)] if held else out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=20), st.integers(1, 15), st.integers(0, 8))
def test_fills_are_those_of_a_greedy_walk(items, room, tail):
    costs, carries = [c for c, _ in items], [x for _, x in items]
    assert list(C.fills(costs, room, tail, carries)) == greedy(costs, room, tail, carries)
    assert list(C.fills(costs, room)) == greedy(costs, room, 0, [True] * len(costs))


def test_chunks_by_an_exact_counter(spark):
    public = pytest.importorskip("public_tokenizers")
    count = C.exact(public.path("byte_bpe_50k.json"))
    assert count("two words") == 2 and count("") == 0
    docs = spark.createDataFrame([("a.md", "# H\n" + "antidisestablishmentarianism " * 300)], "name string, text string")
    rows = C.chunk_documents(docs, 128, 16, count).collect()
    assert len(rows) > 5 and all(r["n_tokens"] == count(r["text"]) for r in rows)


def test_a_corpus_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"good \xff\xfe bad \xe2\x82")
    (tmp_path / "b.md").write_bytes("é".encode())
    got = {r["name"]: r["text"] for r in readers.corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.md": b"good \xff\xfe bad \xe2\x82".decode("utf-8", "replace"), "b.md": "é"}


def test_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "q1", 2), ("a", "q1", 1), ("a", "q2", 3)], "system string, qid string, x int")
    for _ in range(2):
        jobs.append_results(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", "q1", 1), ("a", "q2", 3)]


def test_stored_until_the_input_changes(spark, tmp_path):
    made, source = [], str(tmp_path / "in")

    def make():
        made.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    for n, times in ((3, 1), (3, 1), (5, 2)):
        if times > len(made):
            spark.range(n).write.mode("overwrite").parquet(source)
        assert stored.stored(spark, "doubled", [source], make).count() == n and len(made) == times


def test_stages_are_timed_after_a_warm_up(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"word{i} shared text", "d") for i in range(20)], "id string, text string, doc string")
    at = I.build(chunks, str(tmp_path / "index"))
    asked = spark.createDataFrame([("q1", "word3 text"), ("q2", "shared")], "qid string, text string")
    took = runs.stage_ms(at, asked)
    assert list(took) == ["dense", "bm25", "fuse", "rerank"] and all(t > 0 for t in took.values())
    runs.warm_up(["bm25"], at)
    with pytest.raises(ValueError, match="unknown"):
        runs.warm_up(["other"], at)


def test_the_mean_of_nothing_is_an_error(spark):
    none = spark.createDataFrame([], "system string, qid string, ranked array<string>, gold array<string>, seconds double, support double, required array<string>")
    with pytest.raises(ValueError, match="nothing to average"):
        runs.report(none, 0)


def test_exact_sums_and_p_values(spark):
    import random

    rng = random.Random(0)
    values = [rng.random() * 30 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    a, b = (df.repartition(n).agg(R.exact_sum(F.col("v"))).first()[0] for n in (1, 7))
    assert a == b and abs(a - sum(values)) < 1e-9
    ps = [0.0625, 0.1875, 0.0055, 0.5, 1.0, 0.001, 0.0015, 0.0025] + [rng.random() for _ in range(200)] + [i / 1024 for i in range(2, 1024, 37)]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(T.p_value_text(F.col("p"))).collect()
    assert [r[0] for r in got] == ["<.001" if p < 0.001 else f"{p:.3f}" for p in ps]


def test_labels_of_decisions(spark):
    df = spark.createDataFrame([(0.5, -1.0, 1.0), (0.01, -1.0, 1.0), (0.01, 0.5, 1.0), (0.5, 0.5, 1.0)], "p double, a double, b double")
    assert [r[0] for r in df.select(E.decided(F.col("p"), F.col("a"), F.col("b"))).collect()] == ["capped", "undecided", "decided", "overruled"]
