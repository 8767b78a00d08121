"""Questions meet stored blocks in tasks: a shuffle brings both together, and neither goes through the driver.

Blocks of a key stay whole, and every task gets all questions of a block of
questions before its first block of rows. Rows stream by; a task holds its
questions, what each has found so far, and one key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions that a task holds at once; more are so many passes over the rows.
MOST_QUESTIONS = 20_000
#: What a task does: gets its questions and an iterator of the rows of each key, and yields tables of results.
Run = Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.Table]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its length, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, int | None, pa.Table]]:
    """(task, key, rows) of a sorted stream; the key of questions is None."""
    now, held = None, []
    for batch in batches:
        group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = batch.column(3)
        values = rows.field(key).to_numpy(zero_copy_only=False) if batch.num_rows else np.array([])
        changes = (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]) | (values[1:] != values[:-1]) & (kind[1:] == 1)
        edges = np.flatnonzero(np.r_[True, changes, True]) if batch.num_rows else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = (int(group[a]), None if kind[a] == 0 else int(values[a]))
            if at != now and held:
                yield (*now, pa.Table.from_batches(held))
                held = []
            now = at
            column = batch.column(2 if kind[a] == 0 else 3).slice(a, b - a)
            held.append(pa.RecordBatch.from_struct_array(column))
    if held:
        yield (*now, pa.Table.from_batches(held))


def meet(questions: DataFrame, rows: DataFrame, key: str, order: list[str], run: Run, ddl: str, tasks: int) -> DataFrame:
    """What ``run`` yields for questions(qid, ...) and the rows of every key (numbers from 0 on), in so many tasks; rows of a key come in the given order."""
    out = None
    blocks = max(1, -(-questions.count() // MOST_QUESTIONS))
    place = F.pmod(F.col(key), F.lit(tasks)).cast("int")
    there = rows.select(place.alias("task"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("row"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _keys(batches, key)
        ahead = next(stream, None)
        while ahead:
            task, rows_key, asked = ahead  # questions come first
            ahead = next(stream, None)
            if rows_key is not None:
                continue  # nobody asks

            def of_task(task: int = task) -> Iterator[pa.Table]:
                nonlocal ahead
                while ahead and ahead[0] == task:
                    yield ahead[2]
                    ahead = next(stream, None)

            for table in run(asked, of_task()):
                yield from table.to_batches()

    for block in range(blocks):
        part = questions.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else questions
        asked = part.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(0).alias("kind"), F.struct(*part.columns).alias("asked"))
        both = asked.unionByName(there, allowMissingColumns=True).select("task", "kind", "asked", "row")
        both = both.repartitionById(tasks, "task").sortWithinPartitions("task", "kind", *(f"row.{c}" for c in [key, *order]))
        found = both.mapInArrow(each, ddl)
        out = found if out is None else out.unionByName(found)
    return out
