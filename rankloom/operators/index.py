"""A retrieval index as Parquet tables: texts, postings, corpus statistics, vectors.

Postings hold what each adds to a score, so a search is one join and a sum.
They lie in ranges of (term, id), sorted, so that a search skips the row
groups without a term that is asked for, and a term of very many documents is
spread over several files. Vectors are keyed by id, never by position. An index
is read lazily: a BM25 search doesn't touch vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import retrieval as R

#: id, text to id, vec.
Encoder = Callable[[DataFrame], DataFrame]


def stand_in(rows: DataFrame) -> DataFrame:
    return rows.select("id", R.hashed_vector(F.col("text")).alias("vec"))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def texts(self) -> DataFrame:
        return self._table("texts")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def stats(self) -> DataFrame:
        return self._table("stats")

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors")


def build(chunks: DataFrame, folder: str, encode: Encoder = stand_in) -> Index:
    """Index chunks(id, text, ...); all their columns are kept with the texts. Each table is written once, over what was there."""
    spark = chunks.sparkSession
    index = Index(spark, folder)
    chunks.write.mode("overwrite").parquet(f"{folder}/texts")
    tokenized = R.lengths(index.texts)
    R.corpus_stats(tokenized).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    postings_of(tokenized, index.stats).write.mode("overwrite").parquet(f"{folder}/postings")
    encode(index.texts.select("id", "text")).write.mode("overwrite").parquet(f"{folder}/vectors")
    return index


def postings_of(tokenized: DataFrame, stats: DataFrame) -> DataFrame:
    """term, id, weight, as an index keeps them."""
    return R.weighted(R.postings(tokenized), stats).repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def bm25(index: Index, questions: DataFrame, k: int = 10) -> DataFrame:
    """qid, id, rank, score from stored postings."""
    return R.score_weights(index.postings, R.question_terms(questions), k)


def dense(index: Index, questions: DataFrame, k: int = 10, encode: Encoder = stand_in, prefix: str = R.QUERY_PREFIX) -> DataFrame:
    """The same by inner products; the instruction prefix goes before questions only."""
    asked = encode(questions.select(F.col("qid").alias("id"), F.concat(F.lit(prefix), "text").alias("text")))
    return R.dense(index.vectors, asked.select(F.col("id").alias("qid"), "vec"), k)
