"""Batches and keys are added once, whatever is run again or breaks off."""

import pytest

from rankloom.streaming import jobs
from rankloom.streaming.sink import OnceSink


def rows(sink):
    return sorted((tuple(r) for r in sink.read().select("k", "x").collect()), key=str)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "k string, x int")


def test_batches_and_keys_once(spark, tmp_path):
    sink = OnceSink(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert sink.add(frame(spark, [("a", 2), ("a", 1), ("b", 3), (None, 1)]), "q-0")
    assert not sink.add(frame(spark, [("z", 0)]), "q-0")
    assert sink.add(frame(spark, [("b", 4), ("c", 5), (None, 9)]), "q-1")
    assert rows(sink) == [("a", 1), ("b", 3), ("c", 5), (None, 1)]
    assert {n: c["rows"] for n, c in sink.commits().items()} == {"q-0": 3, "q-1": 1}
    assert spark.read.parquet(sink.path).count() == 4
    with pytest.raises(ValueError):
        sink.add(frame(spark, []), "../up")


@pytest.mark.parametrize("step", ["_index", "_move", "_commit"])
def test_a_batch_that_breaks_off(spark, tmp_path, monkeypatch, step):
    sink = OnceSink(spark, str(tmp_path / "t"), ["k"])
    sink.add(frame(spark, [("a", 1)]), "q-0")
    whole = getattr(OnceSink, step)

    def broken(self, *args):
        if step != "_commit":
            whole(self, *args)  # done, but what follows isn't
        raise RuntimeError("lost")

    monkeypatch.setattr(OnceSink, step, broken)
    with pytest.raises(RuntimeError):
        sink.add(frame(spark, [("b", 2), ("a", 7)]), "q-1")
    assert rows(sink) == [("a", 1)]
    monkeypatch.setattr(OnceSink, step, whole)
    assert sink.add(frame(spark, [("b", 2), ("a", 7)]), "q-1")
    assert rows(sink) == [("a", 1), ("b", 2)] and spark.read.parquet(sink.path).count() == 2


def test_only_touched_buckets_are_read(spark, tmp_path):
    sink = OnceSink(spark, str(tmp_path / "t"), ["k"], buckets=64)
    sink.add(frame(spark, [(f"k{i}", i) for i in range(3000)]), "q-0")
    sink.add(frame(spark, [("k5", 1), ("new", 2)]), "q-1")
    last = sink.commits()["q-1"]
    assert last["rows"] == 1 and last["buckets"] == 2 and 0 < last["keys_read"] < 200


def test_rows_from_before_are_keys_too(spark, tmp_path):
    at = str(tmp_path / "t")
    frame(spark, [("a", 1), ("b", 2)]).write.parquet(at)
    sink = OnceSink(spark, at, ["k"])
    sink.add(frame(spark, [("b", 5), ("c", 6)]), "q-0")
    sink.add(frame(spark, [("a", 5), ("d", 7)]), "q-1")
    assert rows(sink) == [("a", 1), ("b", 2), ("c", 6), ("d", 7)]


def test_a_new_checkpoint_adds_nothing_twice(spark, tmp_path):
    frame(spark, [(f"k{i}", i) for i in range(50)]).repartition(3).write.parquet(str(tmp_path / "in"))
    sink = OnceSink(spark, str(tmp_path / "out"), ["k"])
    for checkpoint in ("one", "one", "two"):
        jobs.stream_once(spark, str(tmp_path / "in"), "k string, x int", sink, str(tmp_path / checkpoint), lambda b: b, 1)
    assert sink.read().count() == 50 and len(sink.commits()) == 6
    assert sum(c["rows"] for c in sink.commits().values()) == 50
