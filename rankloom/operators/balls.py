"""Exact dense search over vectors in balls, leaving out balls that can't reach a question's k-th score.

Vectors are dealt to the nearest of some centres, and each centre's into shells
by their distance to it and into blocks of a bounded size. A block keeps its
centre and the largest distance r of a vector from it, so no vector of it has an
inner product with a question q above q.c + |q| r. A task goes through its blocks
with the k-th score of each question so far, which runs on from block to block,
and multiplies a block only with the questions that it can still serve. Bounds
leave room for rounding, so ties at the edge stay in.

Centres are a bounded sample, chosen by a hash of the id, and so small a table
that tasks get it whole (``CENTRES`` times the dimensions); any choice gives the
same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import retrieval as R
from rankloom.operators.meeting import meet

#: Centres at most, vectors of a block on average, shells per unit of distance; what sums may be off by.
CENTRES, BLOCK, SHELLS, ROOM = 1024, 256, 8, 1e-8
COUNTS = ("vectors", "vectors_read")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def balls_of(vectors: DataFrame, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """block, centre, radius, id, vec from vectors(id, vec); blocks are numbered from 0 on."""
    vectors = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    wanted = max(1, min(centres, -(-vectors.count() // block)))
    points = np.array([r["vec"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()])  # a bounded sample
    kind = dict(vectors.dtypes)["id"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            if len(x):
                cell = ((points**2).sum(axis=1) - 2 * x @ points.T).argmin(axis=1).astype(np.int32)
                away = np.sqrt(((x - points[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(away)], names=["id", "vec", "cell", "away"])

    dealt = vectors.mapInArrow(nearest, f"id {kind}, vec array<double>, cell int, away double").withColumn("shell", F.floor(F.col("away") * SHELLS))
    shells = dealt.groupBy("cell", "shell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    # a row for each shell: some ten times the centres, whatever the number of vectors
    first = F.sum("parts").over(Window.orderBy("cell", "shell").rowsBetween(Window.unboundedPreceding, -1))
    shells = shells.withColumn("first", F.coalesce(first, F.lit(0)))
    there = spread(vectors.sparkSession, points)
    placed = dealt.join(F.broadcast(shells.join(there, "cell")), ["cell", "shell"])
    number = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    return placed.select(number.cast("int").alias("block"), "centre", "radius", "id", "vec").repartitionByRange("block").sortWithinPartitions("block")


def spread(spark, points: np.ndarray) -> DataFrame:
    """cell, centre: the centres as a table."""
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell int, centre array<double>")


def search(balls: DataFrame, questions: DataFrame, k: int = 10, *, exclude_self: bool = False, tasks: int | None = None, count: bool = False) -> DataFrame:
    """qid, id, rank, score for questions(qid, vec): as ``retrieval.dense`` finds them.

    With ``count``: the vectors that there are for each question, and those that were multiplied with it.
    """
    tasks = tasks or max(1, int(balls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    questions = questions.select("qid", F.col("vec").cast("array<double>").alias("vec"))
    kinds = dict(questions.dtypes)["qid"], dict(balls.dtypes)["id"]

    def run(asked: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.Table]:
        q, qid = _matrix(asked.column("vec")), asked.column("qid").to_numpy()
        length = np.sqrt((q**2).sum(axis=1))
        least = np.full(len(q), -np.inf)  # a question's k-th rounded score so far
        hits: list[list[tuple]] = [[] for _ in qid]
        there, read = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        kind = None
        for table in blocks:
            kind = table.schema.field("id").type
            centre, radius = np.array(table.column("centre")[0].as_py()), table.column("radius")[0].as_py()
            bound = q @ centre + length * (radius + ROOM) + ROOM
            there += table.num_rows
            served = np.flatnonzero(bound >= least)
            if not len(served):
                continue
            ids, x = table.column("id").to_numpy(), _matrix(table.column("vec"))
            scores = q[served] @ x.T
            rounded = np.round(scores, 9)
            read[served] += len(ids)
            for i, row, nine in zip(served.tolist(), scores, rounded, strict=True):
                at = np.flatnonzero(nine >= least[i])
                if exclude_self:
                    at = at[ids[at] != qid[i]]
                if len(at) > k:
                    at = at[nine[at] >= np.partition(nine[at], len(at) - k)[len(at) - k]]
                if len(at):
                    hits[i] = sorted([*hits[i], *zip((-nine[at]).tolist(), ids[at].tolist(), row[at].tolist(), strict=True)])[:k]
                    if len(hits[i]) == k:
                        least[i] = -hits[i][-1][0]
        if count:
            yield pa.table({"qid": asked.column("qid"), "vectors": there, "vectors_read": read})
        elif rows := [(n, h[1], h[2]) for n, found in zip(asked.column("qid").to_pylist(), hits, strict=True) for h in found]:
            n, id_, score = zip(*rows, strict=True)
            yield pa.table({"qid": pa.array(n, asked.column("qid").type), "id": pa.array(id_, kind), "score": pa.array(score, pa.float64())})

    if count:
        found = meet(questions, balls, "block", [], run, f"qid {kinds[0]}, vectors long, vectors_read long", tasks)
        return found.groupBy("qid").agg(*(F.sum(c).alias(c) for c in COUNTS))
    found = meet(questions, balls, "block", [], run, f"qid {kinds[0]}, id {kinds[1]}, score double", tasks)
    return R.top(found, ["qid"], [F.round("score", 9).desc(), F.col("id")], k).select("qid", "id", "rank", "score")
