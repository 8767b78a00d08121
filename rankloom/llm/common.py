"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in every operator whose words are runs of non-blank characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: A key with one of so many parts of all rows, or more, is joined by broadcast; there are so many at most.
HOT_PARTS = 1000
#: Bytes of an Arrow batch in ``small_batches``.
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Checkpoints and folders that are still there, by the order they were made in.
_checkpoints: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on one machine (a ``local`` master, as in tests) a temporary folder
    takes the place of an unset ``spark.checkpoint.dir``; on a cluster that is
    an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rankloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def small_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python workers in batches of ``BATCH`` bytes, or less if it is so set.

    Spark's own limits are 10,000 rows and 64 MB, whatever the texts' lengths;
    executors and workers hold several copies of a batch, and keep much of that
    memory afterwards. The setting stays, as results are computed later.
    """
    if _bytes(spark.conf.get(BATCH_BYTES)) > BATCH:
        spark.conf.set(BATCH_BYTES, f"{BATCH}b")


def _bytes(setting: str) -> int:
    """Bytes of a setting like 64m or 67108864b; a limit of none counts as more than any."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", setting.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit.strip("b") or " ") if int(number) > 0 else 1 << 63


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; ``release`` removes its files."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _checkpoints.append(file.get())
    return out


def checkpoints() -> int:
    """How many checkpoints are there: a mark for ``release``."""
    return len(_checkpoints)


def remove_later(path: str) -> None:
    """Let ``release`` remove a folder too."""
    _checkpoints.append(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the checkpoints made since a mark, once the results that read them are written."""
    for path in _checkpoints[since:]:
        remove(spark, path)
    del _checkpoints[since:]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` uses it in inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed(seed: str, *columns: Column) -> Column:
    """48 bits of MD5 over a seed and columns: the same number in any SQL engine."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, to size partitions by."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows inner joined with keyed, which has a row for each ``key`` and in ``n`` how many rows have it.

    Rows of hot keys stay where they are: a key with a part in ``HOT_PARTS`` of
    the total or more is broadcast, and there can't be more of these than
    ``HOT_PARTS``. All other rows are shuffled by the key.
    """
    least = max(1, -(-total // HOT_PARTS))
    hot = F.broadcast(keyed.where(F.col(n) >= least))
    cold = rows.join(F.broadcast(keyed.where(F.col(n) >= least).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(keyed.where(F.col(n) < least), key))


def running(cells: DataFrame, by: list[str], cell: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """cells(by..., cell, value) with the sum of the values of smaller cells, in two levels.

    Runs of ``width`` cells are summed first, so the one task that orders a
    group sees a row for each run, and any other no more than a run's cells.
    """
    wide, before = fresh("wide", cells), fresh("before_wide", cells)
    cells = cells.withColumn(wide, F.floor(F.col(cell) / width))
    earlier = Window.partitionBy(*by).orderBy(wide).rowsBetween(Window.unboundedPreceding, -1)
    runs = cells.groupBy(*by, wide).agg(F.sum(value).alias(before))
    runs = runs.select(*(F.col(c).alias(f"{c}__") for c in by), F.col(wide).alias(f"{wide}__"), F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    same = F.col(wide) == F.col(f"{wide}__")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    inside = Window.partitionBy(*by, wide).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    out = cells.join(runs, same).withColumn(name, F.col(before) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop(wide, f"{wide}__", before, *(f"{c}__" for c in by))
