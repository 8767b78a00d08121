"""A pinned corpus as a Spark data source: files by a manifest, checked by the tasks that read them.

``spark.read.format("pinned_corpus").option("path", FOLDER).option("manifest", M)``
gives name, text, bytes, sha256 and ok. The manifest is JSON lines (name, sha256,
bytes) in a file or a folder of files. A partition is a range of the manifest's
bytes, and its task reads the lines that begin inside, so neither the listing
nor a file goes through the driver. The option names, a pattern like ``sql-*.md``,
is applied before any file is opened (filters that Spark 4.1 pushes to a Python
source stay with a DataFrame that is used again, so none are taken). bytes and sha256 are the manifest's; ok says whether the file that is
there has them. The text of one that hasn't is null; bytes of a good one that
aren't UTF-8 become replacement characters.

Files are opened by pyarrow: a mounted folder, S3, GCS, or HDFS with libhdfs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "pinned_corpus"
SCHEMA = "name string, text string, bytes long, sha256 string, ok boolean"
#: Bytes of a manifest that a task reads: the lines of some 10,000 files.
RANGE = 1 << 20
PIECE = 1 << 16
#: Bytes of texts that a task holds at once, and one text more; rows of as many files.
HELD, ROWS = 1 << 22, 1000
COLUMNS = pa.schema([("name", pa.string()), ("text", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("ok", pa.bool_())])


def store(path: str) -> tuple[files.FileSystem, str]:
    if "://" in path:
        return files.FileSystem.from_uri(path)
    return files.LocalFileSystem(), path.removeprefix("file:")


def lines_from(fs: files.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a file that begin in [start, end)."""
    with fs.open_input_file(path) as f:
        at, rest = max(0, start - 1), b""
        f.seek(at)
        skip = start > 0  # what is left of a line that began before, with its end
        while True:
            piece = f.read(PIECE)
            rest += piece
            while (cut := rest.find(b"\n")) >= 0 or (not piece and rest):
                line, rest, size = (rest[:cut], rest[cut + 1 :], cut + 1) if cut >= 0 else (rest, b"", len(rest))
                if not skip:
                    if at >= end:
                        return
                    yield line
                skip, at = False, at + size
            if not piece or at >= end:
                return


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class PinnedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if missing := [o for o in ("path", "manifest") if not options.get(o)]:
            raise ValueError(f"{NAME} needs the options {missing}")
        self.folder, self.manifest, self.size = options["path"], options["manifest"], int(options.get("rangebytes", options.get("rangeBytes", RANGE)))
        self.names = options.get("names")

    def partitions(self) -> list[Range]:
        fs, path = store(self.manifest)
        found = fs.get_file_info(path)
        if found.type == files.FileType.NotFound:
            raise FileNotFoundError(self.manifest)
        parts = [found] if found.is_file else [i for i in fs.get_file_info(files.FileSelector(path)) if i.is_file and not i.base_name.startswith(("_", "."))]
        return [Range(i.path, low, min(low + self.size, i.size)) for i in sorted(parts, key=lambda i: i.path) for low in range(0, i.size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The rows of a range, in batches of ``HELD`` bytes of text; Spark would hold 10,000 files."""
        rows, held = [], 0
        for row in self.rows(partition):
            rows.append(row)
            held += row[2] if row[4] else 0
            if held >= HELD or len(rows) >= ROWS:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def rows(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        listing, _ = store(self.manifest)
        fs, folder = store(self.folder)
        for line in lines_from(listing, partition.path, partition.start, partition.end):
            if not line.strip():
                continue
            entry = json.loads(line)
            name = entry["name"]
            if self.names and not fnmatchcase(name, self.names):
                continue
            if "/" in name or name in ("", ".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            try:
                with fs.open_input_stream(f"{folder}/{name}") as f:
                    content = f.read()
            except FileNotFoundError:
                content = None
            ok = content is not None and len(content) == entry["bytes"] and hashlib.sha256(content).hexdigest() == entry["sha256"]
            yield name, content.decode("utf-8", "replace") if ok else None, entry["bytes"], entry["sha256"], ok


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


class PinnedCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PinnedReader:
        return PinnedReader(dict(self.options))


def read(spark: SparkSession, folder: str, manifest: str, **options: str) -> DataFrame:
    """The rows of a pinned corpus; the session learns the source."""
    spark.dataSource.register(PinnedCorpus)
    return spark.read.format(NAME).options(path=folder, manifest=manifest, **options).load()


def write(rows: DataFrame, folder: str, manifest: str) -> None:
    """Rows(name, text) as a file each, and their manifest; tasks write the files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = store(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            lines = []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):  # one text after another becomes Python's
                name, content = name.as_py(), (text.as_py() or "").encode("utf-8", "replace")
                with fs.open_output_stream(f"{at}/{name}") as f:
                    f.write(content)
                lines.append(json.dumps({"name": name, "sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content)}, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    rows.select("name", "text").where(F.col("name").isNotNull()).mapInArrow(each, "value string").write.text(manifest)
