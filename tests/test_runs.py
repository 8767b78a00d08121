import json

import pytest
from pyspark.sql import functions as F

from rankloom import __main__ as cli
from rankloom.operators import index as I
from rankloom.operators import retrieval as R
from rankloom.plans import runs
from rankloom.sources import readers


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A corpus of three files, two questions with labels, and the index of its chunks."""
    top = tmp_path_factory.mktemp("world")
    (top / "corpus").mkdir()
    texts = {"a.md": "# Memory\nSet spark.executor.memory to grow the executor heap.", "b.md": "# Shuffle\nRows move between stages in a shuffle.", "c.md": "# Other\nNothing to see here."}
    for name, text in texts.items():
        (top / "corpus" / name).write_text(text)
    questions = [
        {"id": "q1", "question": "how to grow the executor heap", "source_docs": ["a.md"], "answer": "Set spark.executor.memory high.", "difficulty": "easy"},
        {"id": "q2", "question": "when do rows move between stages", "source_docs": ["b.md"], "answer": "Rows move in a shuffle.", "answer_spans": ["shuffle"], "difficulty": "hard"}]
    (top / "golden.jsonl").write_text("".join(json.dumps(q) + "\n" for q in questions))
    gold = [{"id": "q1", "gold_chunks": ["a.md#0000"], "why": ""}, {"id": "q2", "gold_chunks": ["b.md#0000"], "why": ""}]
    (top / "gold.jsonl").write_text("\n".join(map(json.dumps, gold)))
    assert cli.main(["chunk", f"{top}/corpus", f"{top}/chunks"], spark) == 0
    assert cli.main(["index", f"{top}/chunks", f"{top}/index"], spark) == 0
    return top


def test_stored_postings_rank_like_the_scan(spark, world):
    index = I.Index(spark, f"{world}/index")
    asked = spark.createDataFrame([("x", "executor heap heap"), ("y", "rows of other stages"), ("z", "unheard")], "qid string, text string")
    found = sorted(map(tuple, I.bm25(index, asked).collect()))
    assert found == sorted(map(tuple, R.bm25(index.texts, asked).collect())) and {r[0] for r in found} == {"x", "y"}


def test_runs_resume_and_gate(spark, world, capsys):
    out, base = f"{world}/results", f"{world}/baseline"
    files = [f"{world}/index", f"{world}/golden.jsonl", f"{world}/gold.jsonl"]
    assert cli.main(["run", *files, out, "--slice", ":1", "--seconds", "600"], spark) == 0
    assert cli.main(["baseline", out, files[1], base, "why"], spark) == 1  # one of two questions
    assert cli.main(["run", *files, out, "--seconds", "600"], spark) == 0
    assert cli.main(["run", *files, out, "--seconds", "600"], spark) == 0
    said = capsys.readouterr()
    assert [x for x in said.out.splitlines() if "new rows" in x] == ["4 new rows"] * 2 + ["0 new rows"] and "partial" in said.err
    results = spark.read.parquet(out)
    assert results.count() == 8 and {r["support"] for r in results.where("system = 'bm25'").collect()} == {1.0}
    assert cli.main(["gate", out, base], spark) == 1  # no baseline yet
    assert cli.main(["baseline", out, files[1], base, "first"], spark) == 0
    assert cli.main(["gate", out, base], spark) == 0
    worse = results.withColumn("ranked", F.array(F.lit("c.md#0000")))
    assert not runs.check(worse, runs.read_baseline(spark, base), ["bm25"])[1]
    assert cli.main(["report", out, files[1]], spark) == 0
    assert "| bm25 | 2 | 1.000" in capsys.readouterr().out
    assert cli.main(["compare", out, "--a", "bm25", "--b", "dense", "--reps", "50"], spark) == 0
    assert cli.main(["diagnose", out, "--strict"], spark) in (0, 1)
    assert cli.main(["smoke", *files, "--systems", "bm25"], spark) == 0
    assert "bm25: 2 of 2" in capsys.readouterr().out


def test_labels_are_strict(spark, world):
    golden = cli.golden(spark, f"{world}/golden.jsonl")
    gold = readers.json_lines(spark, f"{world}/gold.jsonl", readers.GOLD)
    with pytest.raises(ValueError, match="without gold labels.*q2"):
        runs.labelled(golden, gold.where("id = 'q1'"))
    with pytest.raises(ValueError, match="without a question.*q2"):
        runs.labelled(golden.where("id = 'q1'"), gold)
    with pytest.raises(ValueError, match="unknown systems"):
        runs.known(["bm25", "other"])


def test_validate_stats_and_search(spark, world, capsys):
    assert cli.main(["validate", f"{world}/golden.jsonl", f"{world}/corpus", "--claims"], spark) == 0
    assert cli.main(["stats", f"{world}/corpus"], spark) == 0
    assert cli.main(["search", f"{world}/index", "rerank", "executor heap"], spark) == 0
    assert "a.md#0000" in capsys.readouterr().out
    (world / "broken.jsonl").write_text('{"id": "q"}\n{"id"\n')
    assert cli.main(["validate", f"{world}/broken.jsonl", f"{world}/corpus"], spark) == 1
    assert "broken.jsonl:2" in capsys.readouterr().err


def test_fetched_corpus_is_kept_unless_verified(tmp_path):
    listing = [{"type": "file", "name": "a.md", "download_url": "u/a", "sha": "s"}, {"type": "file", "name": "README.md", "download_url": "u/r"}]
    asked = []

    def get(url):
        asked.append(url)
        return json.dumps(listing).encode() if url == "list" else b"text"

    for verify in (False, False, True):
        found = readers.fetch_corpus("list", str(tmp_path), verify=verify, get=get)
    assert asked == ["list", "u/a", "list", "list", "u/a"] and found["a.md"]["bytes"] == 4
    listing[0]["name"] = "../a.md"
    with pytest.raises(ValueError, match="not a file name"):
        readers.fetch_corpus("list", str(tmp_path), get=get)
