"""Resumable jobs: embed new chunks, and append results that are not there yet.

Both write to an ``OnceSink``: a batch that is run again after a failure adds
nothing twice, and keys that arrive again stay out, at the cost of reading the
keys of the buckets that a batch touches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.retrieval import hashed_vector
from rankloom.streaming.sink import OnceSink

RESULT_KEY = ("system", "qid")


def stream_once(spark: SparkSession, source: str, schema: str, sink: OnceSink, checkpoint: str, make: Callable[[DataFrame], DataFrame], files_at_once: int = 100) -> None:
    """Add what ``make`` makes of the Parquet files that have come since the last call; ends when all are done.

    A batch is named by the query that its checkpoint keeps, so a new checkpoint
    starts with new names and the keys alone keep rows from being added again.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = [r["value"] for r in spark.read.text(f"{checkpoint}/metadata").collect()]
        sink.add(make(batch), f"{json.loads(kept[0])['id']}-{number:09d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def embed_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files_at_once: int = 100, encode: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Embed the Parquet chunks (id, text) that have come since the last call."""
    encode = encode or (lambda d: d.select("id", hashed_vector(F.col("text")).alias("vec")))
    stream_once(spark, source, schema, OnceSink(spark, sink, ["id"]), checkpoint, lambda batch: encode(batch.dropDuplicates(["id"])), files_at_once)


def append_results(new: DataFrame, sink: str) -> None:
    """Append results whose (system, qid) the sink doesn't have; of several rows for one, the least of all columns."""
    out = OnceSink(new.sparkSession, sink, RESULT_KEY)
    out.add(new, out.next_batch())
