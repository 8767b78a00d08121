"""Batch retrieval: BM25, exact dense search, rank fusion, reranking.

All plans take a whole table of questions. Hits are rows (qid, id, rank from 1,
score); ties have explicit keys, and scores are compared rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T

K1, B = 1.5, 0.75


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts groups before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ordered_sum(position: str, value: str) -> Column:
    """Sum in the order of positions: the same double however rows are dealt."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(position, value))), F.lit(0.0), lambda a, x: a + x[value])


def exact_sum(value: Column) -> Column:
    """Sum of doubles below 2^18 in fixed point of 2^-44: the same however rows are dealt, and partial sums before the shuffle."""
    return F.sum(F.rint(value * F.lit(float(1 << 44))).cast("long")) / F.lit(float(1 << 44))


def lengths(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_).alias("id"), T.tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))


def corpus_stats(tokenized: DataFrame) -> DataFrame:
    return tokenized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(tokenized: DataFrame) -> DataFrame:
    """id, dl, term, tf."""
    return tokenized.select("id", "dl", F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, pos, term; a repeated term counts each time."""
    return questions.select("qid", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))


def bm25(docs: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """qid, id, rank, score. Only postings of terms that are asked for leave the scan."""
    tokenized = lengths(docs)
    asked = question_terms(questions)
    wanted = asked.select("term").distinct()
    posted = tokenized.select("id", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    posted = posted.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return score_postings(posted, corpus_stats(tokenized), asked, k)


def weighted(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """term, id, weight: what a posting(id, dl, term, tf) adds to the score of each question that asks for its term; stats has one row."""
    per_term = document_frequency(posted).join(F.broadcast(stats)).select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return posted.join(per_term, "term").select("term", "id", part.alias("weight"))


def score_postings(posted: DataFrame, stats: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """qid, id, rank, score from the postings(id, dl, term, tf) of asked(qid, pos, term) and the corpus's one row of statistics."""
    return score_weights(weighted(posted, stats), asked, k)


def score_weights(weights: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """qid, id, rank, score: the sum of weights(term, id, weight) over a question's terms; ties by the first term that a document has, then its id."""
    sums = weights.join(asked, "term").groupBy("qid", "id").agg(exact_sum(F.col("weight")).alias("score"), F.min("pos").alias("first"))
    nine = F.rint(F.col("score") * 1e9)  # decimals that count; rounding to a decimal is several times slower
    return top(sums, ["qid"], [nine.desc(), F.col("first"), F.col("id")], k).select("qid", "id", "rank", "score")


def term_overlap(docs: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """A plain second system: documents by the number of a question's distinct terms that they have."""
    return overlap_of(lengths(docs).select("id", F.explode(F.array_distinct("tokens")).alias("term")), questions, k)


def overlap_of(has: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The same from has(id, term), a row for each distinct term of a document."""
    asked = question_terms(questions).select("qid", "term").distinct()
    sums = has.join(asked, "term").groupBy("qid", "id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return top(sums, ["qid"], [F.col("score").desc(), F.col("id")], k).select("qid", "id", "rank", "score")


#: Questions whose matrix goes to a task at once.
MOST_QUESTIONS = 20_000
#: Questions whose scores with a batch of vectors are in memory at once.
AT_ONCE = 256


def _question_blocks(questions: DataFrame) -> Iterator[list]:
    """All questions(qid, vec), ``MOST_QUESTIONS`` rows at a time; more than one block are ranges of qid."""
    rows = questions.select("qid", "vec")
    first = rows.limit(MOST_QUESTIONS + 1).collect()
    if len(first) <= MOST_QUESTIONS:
        yield first
        return
    ordered = rows.orderBy("qid").toLocalIterator()
    while block := list(islice(ordered, MOST_QUESTIONS)):
        yield block


def dense(vectors: DataFrame, questions: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """Exact inner products of questions(qid, vec) with vectors(id, vec), in blocks.

    The matrix of a block of at most ``MOST_QUESTIONS`` questions goes to every
    task; each Arrow batch of vectors is one matrix product whose best k rows
    for every question leave the task. More questions are so many passes over
    the vectors; the driver holds all question vectors.
    """

    def scores_of(rows: list) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        ids = [r["qid"] for r in rows]
        asked = np.array(ids, None if ids and not isinstance(ids[0], str) else object)
        matrix = np.array([r["vec"] for r in rows], np.float64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not ids:
                    continue
                vectors_ = np.stack(batch["vec"].to_list()).astype(np.float64)
                keep = min(len(batch), k + 1 + int(exclude_self))
                for low in range(0, len(ids), AT_ONCE):
                    scores = vectors_ @ matrix[low : low + AT_ONCE].T
                    # Rounded scores decide and ids break ties, here as in the final rank; all that tie with the last stay.
                    rounded = np.round(scores, 9)
                    least = np.partition(rounded, len(batch) - keep, axis=0)[len(batch) - keep]
                    row, question = np.nonzero(rounded >= least)
                    yield pd.DataFrame({"qid": asked[low + question], "id": batch["id"].to_numpy()[row], "score": scores[row, question]})

        return run

    kinds = dict(vectors.dtypes)["id"], dict(questions.dtypes)["qid"]
    found = None
    for block in _question_blocks(questions):
        part = vectors.select("id", "vec").mapInPandas(scores_of(block), f"qid {kinds[1]}, id {kinds[0]}, score double")
        found = part if found is None else found.union(part)
    if exclude_self:
        found = found.where("qid <> id")
    return top(found, ["qid"], [F.round("score", 9).desc(), F.col("id")], k).select("qid", "id", "rank", "score")


def dense_by_join(vectors: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """The same by SQL expressions: a nested loop join over the stated questions."""
    product = F.aggregate(F.zip_with(F.col("vec").cast("array<double>"), F.col("qvec").cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = vectors.join(questions.withColumnRenamed("vec", "qvec")).where("qid <> id").select("qid", "id", product.alias("score"))
    return top(scored, ["qid"], [F.round("score", 9).desc(), F.col("id")], k).select("qid", "id", "rank", "score")


def fuse(lists: list[DataFrame], k: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of hit lists: each adds 1 / (constant + rank); ties go to the earlier list, then its rank."""
    rows = None
    for number, hits in enumerate(lists):
        part = hits.select("qid", "id", F.lit(number).alias("list"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("c", 1.0 / (constant + F.col("rank")))
    order = F.struct("list", "rank").alias("at")
    sums = rows.select("qid", "id", order, "c").groupBy("qid", "id").agg(ordered_sum("at", "c").alias("score"), F.min("at").alias("first"))
    return top(sums, ["qid"], [F.round("score", 12).desc(), F.col("first")], k).select("qid", "id", "rank", "score")


def carried(dense_hits: DataFrame, sparse_hits: DataFrame) -> DataFrame:
    """qid, id and the score carried along: the dense one where both lists have the id."""
    a, b = dense_hits.select("qid", "id", F.col("score").alias("d")), sparse_hits.select("qid", "id", F.col("score").alias("s"))
    return a.join(b, ["qid", "id"], "full_outer").select("qid", "id", F.coalesce("d", "s").alias("score"))


PairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def coverage(question: Column, passage: Column) -> Column:
    """The stand-in pair scorer: the share of a question's distinct terms that the passage has."""
    asked = F.array_distinct(T.tokens(question))
    return F.size(F.array_intersect(asked, T.tokens(passage))) / F.greatest(F.size(asked), F.lit(1))


def rerank(pool: DataFrame, questions: DataFrame, texts: DataFrame, k: int = 5, scorer: PairScorer | None = None) -> DataFrame:
    """Candidates (qid, id, rank) by a pair score, ties by their rank in the pool; ids without text drop out.

    Texts join late, by id. ``scorer`` maps Series of questions and passages to
    scores in a pandas UDF (a model loads once in each worker); without it the
    stand-in runs in the JVM.
    """
    pairs = pool.select("qid", "id", F.col("rank").alias("before")).join(texts.select("id", F.col("text").alias("passage")), "id").join(questions.select("qid", F.col("text").alias("question")), "qid")
    udf = scorer if hasattr(scorer, "evalType") else scorer and F.pandas_udf(scorer, "double")
    score = udf("question", "passage") if udf else coverage(F.col("question"), F.col("passage"))
    return top(pairs.select("qid", "id", "before", score.alias("score")), ["qid"], [F.round("score", 9).desc(), F.col("before")], k).select("qid", "id", "rank", "score")


QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """The stand-in encoder: signed feature hashing of tokens, scaled to length 1.

    The first 32 bits of a token's MD5 give its dimension and its sign. A batch
    hashes each of its different tokens once and counts all in one pass.
    """

    @F.arrow_udf("array<double>")
    def vectors_of(tokens: pa.Array) -> pa.Array:
        row = pa.compute.list_parent_indices(tokens).to_numpy()
        coded = pa.compute.dictionary_encode(pa.compute.list_flatten(tokens))
        cells = np.array([int.from_bytes(md5(w.encode()).digest()[:4], "big") for w in coded.dictionary.to_pylist()], np.int64)
        cell = cells[coded.indices.to_numpy()]
        sums = np.bincount(row * dims + cell % dims, 1.0 - 2.0 * (cell // dims % 2), len(tokens) * dims).astype(np.float64).reshape(-1, dims)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))  # of whole numbers: the same in any order
        scaled = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dims), pa.array(scaled.ravel()))

    return vectors_of(T.tokens(text))
