"""Tables that several queries read: made once for a state of their inputs, and kept in the folder that the cluster shares."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder in its place only on one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rankloom-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def place(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.exists(at)


def state(spark: SparkSession, path: str) -> str:
    """What tells whether a table's files are the same as before: bytes, number of files and the time of the last change."""
    fs, at = place(spark, path)
    summary = fs.getContentSummary(at)
    return f"{path} {summary.getLength()} {summary.getFileCount()} {fs.getFileStatus(at).getModificationTime()}"


@cache
def code() -> str:
    """A digest of the code that tables are made by: a change of it makes them anew."""
    here = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for file in sorted([*here.glob("functions/*.py"), *here.glob("operators/*.py")]):
        digest.update(file.read_bytes())
    return digest.hexdigest()


def kept(spark: SparkSession, name: str, inputs: Sequence[str], write: Callable[[str], None]) -> str:
    """The folder of a table for this state of the input tables and of the code; ``write`` fills it where it isn't there.

    It is written under another name first, so no reader sees a part of it, and
    of two jobs that make the same table one is kept.
    """
    key = hashlib.sha256("\n".join([code(), *(state(spark, p) for p in inputs)]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/rankloom-stored/{key}/{name}"
    if not exists(spark, path):
        made = f"{path}.{uuid.uuid4().hex}"
        write(made)
        (fs, to), (_, here) = place(spark, path), place(spark, made)
        if fs.exists(to) or not fs.rename(here, to):
            fs.delete(here, True)
        else:  # where the other job was faster, some stores move a folder into the one that is there
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to, here.getName()), True)
    return path


def stored(spark: SparkSession, name: str, inputs: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returned for this state of the input tables and of the code, from Parquet."""
    return spark.read.parquet(kept(spark, name, inputs, lambda path: make().write.parquet(path)))


def bucketed(spark: SparkSession, name: str, inputs: Sequence[str], make: Callable[[], DataFrame], column: str, buckets: int) -> DataFrame:
    """The same in hash buckets of a column, so that joins by it leave these rows where they are.

    The catalogue of the session is told of the files; another session tells its own.
    """

    def write(path: str) -> None:
        draft = f"rankloom_draft_{uuid.uuid4().hex}"
        make().repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).format("parquet").option("path", path).saveAsTable(draft)
        spark.sql(f"DROP TABLE {draft}")  # its files stay: the folder is the caller's

    path = kept(spark, f"{name}-{column}-{buckets}", inputs, write)
    table = f"rankloom_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{c}` {kind}" for c, kind in spark.read.parquet(path).dtypes)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
