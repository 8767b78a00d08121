"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents. Stages that run Python
bound the session's Arrow batches (``small_batches``). ``run`` writes each
stage's result as Parquet in the folder that the cluster shares and reads it
again for the next; what a stage left there goes when its result is written.
The last stage's input stays until ``rankloom.llm.common.release`` is called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import bpe, language, mixing, simhash, suffixes
from rankloom.llm.common import checkpoints, release, remove, remove_later, shared_dir, small_batches, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    small_batches(spark)
    return language.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that a smaller document has."""
    small_batches(spark)
    return suffixes.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.repeat_by_mix(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the decoded text."""
    small_batches(spark)
    return bpe.encode_documents(docs)


STAGES = [
    ("language identification", known_language),
    ("near duplicates", near_copies),
    ("suffix deduplication", repeated_passages),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: No SQL expresses the trained model, the fingerprints or the tokenizer; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        mark = checkpoints()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        release(spark, mark)
        docs = spark.read.parquet(f"{folder}/{k}")
        if last:
            remove(spark, last)
        last = f"{folder}/{k}"
    remove_later(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
