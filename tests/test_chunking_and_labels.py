import urllib.error

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import chunking as C
from rankloom.operators import labels as L
from rankloom.sources import readers
from rankloom.streaming import jobs


def test_blocks_and_front_matter():
    title, blocks = C.blocks_of("---\ntitle: Guide\n---\n# One\ntext\n\n```\n# no heading\n```\n<table><tr><td>1</td></tr></table>\nafter")
    assert title == "Guide" and [b.kind for b in blocks] == ["heading", "text", "code", "table", "text"]
    assert C.blocks_of("---\ntitle: x\nnever closed")[1] == []


def test_table_pieces_repeat_their_header():
    rows = "".join(f"<tr><td>key{i}</td><td>some longer value {i}</td></tr>\n" for i in range(40))
    chunks = list(C.Chunker(120, 16).chunks(f"# T\n<table>\n<tr><th>k</th><th>v</th></tr>\n{rows}</table>"))
    assert len(chunks) > 3 and all("<th>k</th>" in c[2] for c in chunks) and not any(c[4] for c in chunks)
    assert "<th>" in list(C.Chunker().chunks("<table><tr><th>only</th></tr></table>"))[0][2]


@pytest.mark.parametrize("text", ["word " * 2000, "x = 1\n" * 400, "a" * 3000, "Alpha one. " * 90 + "\n- item\n" * 30])
def test_no_chunk_exceeds_its_budget(text):
    chunks = list(C.Chunker(100, 20).chunks("# Head\n" + text))
    assert chunks and all(c[3] <= 100 for c in chunks) and all(c[2].startswith("Head\n") for c in chunks)


def test_paths_and_oversized_prefix():
    chunks = list(C.Chunker(200, 20).chunks("# A\nx\n## B\ny\n# C\nz"))
    assert [c[0] for c in chunks] == ["A", "A > B", "C"]
    long = "".join(f"{'#' * min(6, i + 1)} part {'word ' * 30}{i}\n" for i in range(6)) + "body " * 50
    assert any(c[4] for c in C.Chunker(100, 10).chunks(long))


def test_chunk_documents_and_windows(spark):
    docs = spark.createDataFrame([("a.md", "# H\none. Two three."), ("b.md", None), ("c.md", "")], "name string, text string")
    rows = C.chunk_documents(docs).collect()
    assert [(r["id"], r["heading_path"], r["kind"]) for r in rows] == [("a.md#0000", "H", "text")]
    words = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, "")], "id long, text string")
    assert [r["text"] for r in L.fixed_windows(words, 4, 1).orderBy("ord").collect()] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]


def test_claims(spark):
    df = spark.createDataFrame([("Set spark.a.b to 4; shuffles move many rows between stages. It is so.",)], "a string")
    assert df.select(T.claim_clauses(F.col("a"))).first()[0] == ["shuffles move many rows between stages."]
    claims = spark.createDataFrame([("q", "alpha bravo charlie delta")], "qid string, claim string")
    paras = spark.createDataFrame([("q", 0, "alpha bravo"), ("q", 1, "charlie delta"), ("q", 2, "nothing")], "qid string, ord int, paragraph string")
    best = L.claim_coverage(claims, paras).first()
    assert (best["coverage"], best["paragraph"]) == (0.5, "alpha bravo")
    assert L.claim_coverage(claims, paras.where("ord = 2")).first()["paragraph"] == ""


def test_repeated_ids_are_told_apart_by_line(spark):
    rows = [(1, "q", "Set spark.a.b now.", ["x.md"], ["one"]), (2, "q", "Set spark.a.b now.", ["y.md"], ["two"]), (3, None, "Set spark.c.d now.", None, None)]
    golden = spark.createDataFrame(rows, "line long, id string, answer string, source_docs array<string>, answer_spans array<string>")
    corpus = spark.createDataFrame([("x.md", "spark.a.b and two"), ("y.md", "Two")], "name string, text string")
    found = sorted(tuple(r) for r in L.ungrounded(golden, corpus, "line").select("line", "kind", "missing").collect())
    assert found == [(1, "span", "one"), (2, "key", "spark.a.b"), (3, "key", "spark.c.d")]
    claims = spark.createDataFrame([(1, "q", "alpha bravo"), (2, "q", "alpha bravo")], "line long, qid string, claim string")
    paras = spark.createDataFrame([(1, 0, "alpha bravo"), (2, 0, "alpha only")], "line long, ord int, paragraph string")
    best = L.claim_coverage(claims, paras, "line").orderBy("line").collect()
    assert [(r["line"], r["coverage"], r["paragraph"]) for r in best] == [(1, 1.0, "alpha bravo"), (2, 0.5, "alpha only")]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb\u2028c\n", "org.apache.spark.serializer.KryoSerializer. spark.x.y.")], "a string, b string")
    row = df.select(T.lines(F.col("a")).alias("l"), T.config_keys(F.col("b")).alias("k"), T.squashed(F.lit("  a  b ")).alias("s")).first()
    assert row["l"] == ["a", "b", "c"] and row["k"] == ["spark.serializer.KryoSerializer", "spark.x.y"] and row["s"] == "a b"


def test_fetch_tries_again():
    calls, waits = [], []

    class Answer:
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None
        read = lambda self: b"ok"

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return Answer()

    assert readers.fetch("u", 3, opener=opener, pause=waits.append) == b"ok" and waits == [1.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        readers.fetch("u", 3, opener=lambda *a, **k: (_ for _ in ()).throw(urllib.error.HTTPError("u", 500, "", {}, None)), pause=waits.append)


def test_strict_json_lines_and_jobs(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\n{broken\n')
    rows, problems = readers.json_lines_strict(spark, str(tmp_path / "x.jsonl"), "id string")
    assert [(r["line"], r["id"]) for r in rows.collect()] == [(1, "1")] and [r["line"] for r in problems.collect()] == [3]
    spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.embed_new(spark, str(tmp_path / "in"), "id string, text string", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    done = spark.createDataFrame([("s", "1")], "system string, qid string")
    jobs.append_results(done, str(tmp_path / "res"))
    jobs.append_results(done.union(spark.createDataFrame([("s", "2")], done.schema)), str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2
