"""A pinned corpus: ranges of its manifest, checks by the tasks, and filters before files are opened."""

import json

import pytest

from rankloom.sources import pinned


@pytest.fixture
def corpus(spark, tmp_path):
    rows = spark.createDataFrame([(f"é{i}.md", None if i == 3 else f"text {i} é\n" * i) for i in range(40)], "name string, text string").repartition(3)
    pinned.write(rows, str(tmp_path / "files"), str(tmp_path / "manifest"))
    return tmp_path, {r["name"]: r["text"] or "" for r in rows.collect()}


@pytest.mark.parametrize("size", ["1", "64", "1048576"])
def test_every_line_belongs_to_one_range(spark, corpus, size):
    at, want = corpus
    df = pinned.read(spark, str(at / "files"), f"file://{at}/manifest", rangeBytes=size)
    got = df.collect()
    assert {r["name"]: r["text"] for r in got} == want and len(got) == 40 and all(r["ok"] and r["bytes"] == len(want[r["name"]].encode()) for r in got)


def test_bad_bytes_and_missing_files_are_told(spark, corpus):
    at, _ = corpus
    bad, gone, longer = (at / "files" / f"é{i}.md" for i in (5, 6, 7))
    content = bytearray(bad.read_bytes())
    content[3] ^= 1
    bad.write_bytes(content)
    gone.unlink()
    longer.write_bytes(longer.read_bytes() + b" ")
    got = pinned.read(spark, str(at / "files"), str(at / "manifest")).where("not ok").collect()
    assert {(r["name"], r["text"]) for r in got} == {("é5.md", None), ("é6.md", None), ("é7.md", None)}


def test_names_are_told_apart_before_files_are_opened(spark, corpus):
    at, want = corpus
    with (at / "manifest" / "more.json").open("w") as f:
        f.write(json.dumps({"name": "../x", "sha256": "", "bytes": 0}))  # opening it would be an error
    df = pinned.read(spark, str(at / "files"), str(at / "manifest"), names="é1*")
    assert {r["name"] for r in df.collect()} == {n for n in want if n.startswith("é1")} and df.where("name = 'é12.md'").count() == 1 and df.count() == 11
    with pytest.raises(Exception, match="not a file name"):
        pinned.read(spark, str(at / "files"), str(at / "manifest")).count()
    with pytest.raises(Exception, match="manifest"):
        spark.read.format(pinned.NAME).option("path", "x").load().count()


def test_a_task_holds_few_texts_at_once(corpus, tmp_path, monkeypatch):
    at, want = corpus
    reader = pinned.PinnedReader({"path": str(at / "files"), "manifest": str(at / "manifest")})
    monkeypatch.setattr(pinned, "HELD", 300)
    sizes, names = [], []
    for part in reader.partitions():
        for batch in reader.read(part):
            names += batch.column(0).to_pylist()
            sizes.append(sum(batch.column(2).to_pylist()))
            assert sum(batch.column(2).to_pylist()[:-1]) < 300
    assert sorted(names) == sorted(want) and len(sizes) > 10
