"""Worker-resident models, and joins that leave bucketed rows where they are."""

import re
import uuid

from pyspark.sql import functions as F

from rankloom.operators import models
from rankloom.operators import retrieval as R
from rankloom.sources import stored


def test_models_load_once_a_worker_and_get_like_lengths(spark, tmp_path):
    class Counting(models.TermShare):
        """Writes a file for every load, and remembers the batches it gets."""

        def __init__(self, folder):
            models.TermShare.__init__(self)
            self.folder = folder
            (folder / f"load-{uuid.uuid4().hex}").touch()

        def encode(self, texts):
            assert len(texts) <= 8
            spread = max(map(len, texts)) - min(map(len, texts))
            (self.folder / f"batch-{uuid.uuid4().hex}").write_text(str(spread))
            return models.TermShare.encode(self, texts)

    rows = spark.range(600).select("id", F.repeat(F.lit("w "), (F.col("id") * 37 % 200).cast("int")).alias("text")).repartition(12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = models.encoder(f"counting-{uuid.uuid4().hex}", lambda: Counting(tmp_path), window=40, batch=8)(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: r["vec"][0] for r in got} == {i: 2.0 * (i * 37 % 200) for i in range(600)}
    loads, batches = list(tmp_path.glob("load-*")), [int(p.read_text()) for p in tmp_path.glob("batch-*")]
    assert 1 <= len(loads) <= 4 < 12 and len(batches) < 120  # four workers, twelve tasks
    assert sum(batches) / len(batches) < 150  # texts of one batch without sorting differ by some 340


def test_a_resident_scorer_reranks_as_the_plain_one(spark):
    texts = spark.createDataFrame([(i, f"alpha w{i} beta w{i % 3}") for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(q, f"alpha w{q} w{q % 3} unknown") for q in range(5)] + [(5, "")], "qid long, text string")
    pool = asked.select("qid").crossJoin(texts.select("id", (F.col("id") + 1).alias("rank")))
    scorer = models.pair_scorer("plain-share", models.TermShare)
    assert sorted(R.rerank(pool, asked, texts, 7, scorer).collect()) == sorted(R.rerank(pool, asked, texts, 7).collect())


def test_bucketed_texts_are_not_moved(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(2000).select("id", F.concat(F.lit("text "), "id").alias("text")).write.parquet(source)
    made = [stored.bucketed(spark, "t", [source], lambda: spark.read.parquet(source), "id", 8) for _ in range(2)]
    assert made[0].count() == 2000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pool = spark.range(5000).select((F.col("id") * 3 % 2500).alias("id"), F.col("id").alias("qid"))
        joined = pool.join(made[1], "id")
        plan = joined._jdf.queryExecution().explainString(joined._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        tree = plan.split("\n\n")[0]
        assert tree.count("Exchange") == 1 and re.search(r"Bucketed: true|SelectedBucketsCount", plan)
        assert joined.count() == pool.where("id < 2000").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
