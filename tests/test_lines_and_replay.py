"""Line numbers across ranges of files, sign flips by halves, and the replayed generator."""

import itertools
import json
import random

import numpy as np
import pytest

from rankloom.operators import evaluation as E
from rankloom.sources import readers


@pytest.mark.parametrize("size", ["64", "134217728"])
def test_lines_are_numbered_across_ranges(spark, tmp_path, size):
    rng = random.Random(3)
    want, bad = {}, {}
    for name, end in (("a.jsonl", "\n"), ("b.jsonl", "\r\n"), ("c.jsonl", "")):
        lines = []
        for i in range(1, 60):
            text = rng.choice((json.dumps({"id": f"{name}{i}", "n": i, "pad": "é" * rng.randrange(90)}), json.dumps({"id": f"{name}{i}", "n": i}), "", "  ", "{broken", '{"n": 1} x'))
            lines.append(text)
            if text.strip() and text[-1] == "}":
                want[f"{name}{i}"] = i
            elif text.strip():
                bad[name, i] = text
        (tmp_path / name).write_text((end or "\n").join(lines) + end, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "64" else "4194304")
    try:
        rows, problems = readers.json_lines_strict(spark, str(tmp_path), "id string, n long")
        assert size != "64" or rows.rdd.getNumPartitions() > 8
        assert {r["id"]: r["line"] for r in rows.collect()} == want
        assert {(r["file"], r["line"]): r["text"] for r in problems.collect()} == bad and bad
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def flips(d):
    least = abs(sum(d)) - 1e-12
    return sum(abs(sum(x * s for x, s in zip(d, signs, strict=True))) >= least for signs in itertools.product((1, -1), repeat=len(d))) / 2 ** len(d)


def test_sign_flips_by_halves(spark):
    rng = random.Random(6)
    cases = [[rng.choice((0.0, 0.5, -0.5, 1.0, 0.1, -0.2)) for _ in range(n)] for n in (1, 2, 3, 7, 10, 12)] + [[0.0] * 5, [0.1] * 9, [1.0, -1.0]]
    rows = [("x", "y", str(i), q, v) for i, d in enumerate(cases) for q, v in enumerate(d)]
    rows += [("x", "y", "many", q, rng.random() - 0.3) for q in range(20)] + [("x", "y", "more", q, 0.5) for q in range(21)]
    got = {r["metric"]: r["p"] for r in E.compare(spark.createDataFrame(rows, "a string, b string, metric string, qid int, diff double")).collect()}
    assert got["more"] is None and 0 < got["many"] <= 1
    d = np.array([v for _, _, m, _, v in rows if m == "many"])
    sums = np.zeros(1)
    for x in d:
        sums = np.concatenate([sums + x, sums - x])
    assert got["many"] == pytest.approx((np.abs(sums) >= abs(d.sum()) - 1e-12).mean())
    for i, case in enumerate(cases):
        assert got[str(i)] == pytest.approx(flips(case)), case


def test_the_generator_is_replayed(spark, monkeypatch):
    for seed, n in ((0, 1), (0, 10), (3, 16), (9, 200)):
        rng = random.Random(seed)
        want = [[rng.randrange(n) for _ in range(n)] for _ in range(50)]
        assert np.concatenate(list(E.draws(seed, n, 50, 300))).tolist() == want
    rng = random.Random(1)
    values = [[rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9) for _ in range(40)] for _ in range(200)]
    assert E.compensated(np.array(values).T).tolist() == [sum(v) for v in values]
    rows = [("x", "y", m, q, rng.choice((0.0, 0.1, 0.5, -1.0))) for m, n in (("p", 10), ("q", 10), ("r", 7)) for q in range(n)]
    got = {r["metric"]: (r["ci_low"], r["ci_high"]) for r in E.bootstrap(spark.createDataFrame(rows, "a string, b string, metric string, qid int, diff double"), 400).collect()}
    for m in "pqr":
        d = [v for *_, k, _, v in rows if k == m]
        rng, n = random.Random(0), len(d)
        means = sorted(sum(d[rng.randrange(n)] for _ in range(n)) / n for _ in range(400))
        assert got[m] == (means[10], means[390])
