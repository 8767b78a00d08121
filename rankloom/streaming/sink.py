"""A Parquet table that takes every batch once and every key once, whatever is run again.

Below the table's folder, which any reader reads as plain Parquet:

* ``batch-NAME-...`` are the rows of a batch;
* ``_keys/batch=NAME/bucket=N`` are the keys of a batch by hash buckets, so a batch
  reads the keys of the buckets that it touches, no other column and no rows;
* ``_commits/NAME`` says that a batch is whole, and what it read and wrote.

A batch's name comes from the query that makes it and its number, so a batch that
is run again after its commit changes nothing, and one that was broken off before
is removed and made anew. Rows move into place before the commit is written;
``read`` leaves out those of a batch without one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.stored import exists, place

BUCKETS = 64
#: The name of the keys of rows that were there before the table had any.
BEFORE = "before"


class OnceSink:
    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets

    # ---- files

    def _names(self, folder: str) -> list[str]:
        fs, at = place(self.spark, folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _remove(self, path: str) -> None:
        fs, at = place(self.spark, path)
        fs.delete(at, True)

    def _write(self, path: str, text: str) -> None:
        """A small file that is whole or isn't there."""
        draft = f"{self.path}/_drafts/{uuid.uuid4().hex}"
        fs, at = place(self.spark, draft)
        out = fs.create(at, True)
        out.write(text.encode())
        out.close()
        _, to = place(self.spark, path)
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            fs.delete(at, True)

    def commits(self) -> dict[str, dict]:
        """What each whole batch read and wrote: rows, buckets, keys_read."""
        names = self._names(f"{self.path}/_commits")
        if not names:
            return {}
        rows = self.spark.read.text(f"{self.path}/_commits", wholetext=True).select(F.element_at(F.split("_metadata.file_name", "/"), -1), "value").collect()
        return {name: json.loads(value) for name, value in rows}

    def committed(self, batch: str) -> bool:
        return exists(self.spark, f"{self.path}/_commits/{batch}")

    # ---- tables

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _known(self, touched: list[int], schema) -> DataFrame | None:
        """The keys of whole batches in some buckets, if there are any batches and buckets."""
        whole = [n for n in [BEFORE, *self._names(f"{self.path}/_commits")] if exists(self.spark, f"{self.path}/_keys/batch={n}")]
        if not whole or not touched:
            return None
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = self.spark.read.option("basePath", f"{self.path}/_keys").schema(f"{fields}, batch string, bucket int").parquet(*(f"{self.path}/_keys/batch={n}" for n in whole))
        return keys.where(F.col("bucket").isin(touched)).select(*self.key)

    def _index(self, rows: DataFrame, batch: str) -> None:
        self._bucketed(rows.select(*self.key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/_keys/batch={batch}")

    def add(self, rows: DataFrame, batch: str) -> bool:
        """Add the rows of a batch whose keys aren't there; of several rows of a key, the least of all columns. False if the batch is there already."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        if self.committed(batch):
            return False
        self._clear(batch)
        if not exists(self.spark, f"{self.path}/_commits") and not exists(self.spark, f"{self.path}/_keys/batch={BEFORE}") and any(not n.startswith("_") for n in self._names(self.path)):
            self._index(self.spark.read.parquet(self.path), BEFORE)
        rows = self._bucketed(rows.groupBy(*self.key).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")).persist()
        try:
            touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
            known, new, read = self._known(touched, rows.select(*self.key).schema), rows, 0
            if known is not None:
                read = known.count()
                known = known.select(*(F.col(k).alias(f"known_{k}") for k in self.key))
                new = rows.join(known, [rows[k].eqNullSafe(known[f"known_{k}"]) for k in self.key], "left_anti")
            staged = f"{self.path}/_staged/{batch}"
            new.drop("bucket").write.mode("overwrite").parquet(staged)
            written = self.spark.read.schema(rows.drop("bucket").schema).parquet(staged)
            n = written.count()
            self._index(written, batch)
            self._move(staged, batch)
            self._commit(batch, {"rows": n, "buckets": len(touched), "keys_read": read})
        finally:
            rows.unpersist()
        return True

    def _clear(self, batch: str) -> None:
        """Remove what a run of the batch left that was broken off."""
        for name in self._names(self.path):
            if name.startswith(f"batch-{batch}-"):
                self._remove(f"{self.path}/{name}")
        self._remove(f"{self.path}/_keys/batch={batch}")
        self._remove(f"{self.path}/_staged/{batch}")

    def _move(self, staged: str, batch: str) -> None:
        for name in self._names(staged):
            if name.endswith(".parquet"):
                (fs, here), (_, to) = place(self.spark, f"{staged}/{name}"), place(self.spark, f"{self.path}/batch-{batch}-{name}")
                if not fs.rename(here, to):
                    raise OSError(f"{staged}/{name} can't be moved")
        self._remove(staged)

    def _commit(self, batch: str, what: dict) -> None:
        self._write(f"{self.path}/_commits/{batch}", json.dumps(what, sort_keys=True))

    def next_batch(self) -> str:
        """A name for a batch that isn't a stream's: a number that no commit has."""
        return f"{sum(n.isdigit() for n in self._names(f'{self.path}/_commits')):09d}"

    def read(self) -> DataFrame:
        """The rows of whole batches, and those that were there before."""
        whole = set(self._names(f"{self.path}/_commits"))
        files = [n for n in self._names(self.path) if not n.startswith(("_", "."))]
        kept = [n for n in files if not (m := re.fullmatch(r"batch-(.+)-part-.*", n)) or m[1] in whole]
        if not kept:
            raise ValueError(f"no whole batch at {self.path}")
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in kept)) if len(kept) < len(files) else self.spark.read.parquet(self.path)
