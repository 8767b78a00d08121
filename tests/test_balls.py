"""Dense search over balls finds what the nested loop finds, and leaves out what can't be among the first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import balls, meeting
from rankloom.operators import retrieval as R


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.concatenate([centres[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16)) * 0.15, rng.normal(size=(40, 16)), np.repeat(rng.normal(size=(1, 16)), 300, axis=0)])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").persist()


def rows(hits):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 8)) for r in hits.collect())


@pytest.mark.parametrize("k,block,centres,tasks,most", [(10, 64, 1024, 2, 20_000), (1, 32, 5, 1, 20_000), (400, 50, 12, 3, 25)])
def test_the_same_hits(vectors, monkeypatch, k, block, centres, tasks, most):
    monkeypatch.setattr(meeting, "MOST_QUESTIONS", most)
    asked = vectors.where("id % 23 = 0").withColumnRenamed("id", "qid")
    made = balls.balls_of(vectors, block, centres).persist()
    assert made.count() == 1840 and made.groupBy("block").count().agg(F.max("count")).first()[0] < 3 * block + 30
    want = rows(R.dense_by_join(vectors, asked, k))
    assert rows(balls.search(made, asked, k, exclude_self=True, tasks=tasks)) == want
    sums = balls.search(made, asked, k, exclude_self=True, tasks=tasks, count=True).agg(*(F.sum(c).alias(c) for c in balls.COUNTS)).first()
    assert sums["vectors"] == 1840 * asked.count() and (k > 10 or sums["vectors_read"] < 0.8 * sums["vectors"])


def test_texts_as_ids_and_nothing_to_find(spark, vectors):
    named = vectors.limit(50).select(F.concat(F.lit("d"), "id").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    made = balls.balls_of(named, 8)
    asked = named.limit(5).withColumnRenamed("id", "qid")
    assert {r["id"] for r in balls.search(made, asked, 1, tasks=2).collect()} and balls.search(made, asked, 50, tasks=2).count() == 250
    assert balls.search(made, asked.limit(0)).count() == 0
    assert balls.search(balls.balls_of(named.limit(0)), asked).count() == 0
