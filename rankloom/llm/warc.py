"""WARC archives: written from pages, read back by tasks that each own a byte range.

Every record is a gzip member. A reading task scans its range for the gzip
magic, validates a candidate by decoding the member's start (it must begin a
WARC record) and its whole (checksum right, and another member or the file's
end behind it), and from the first record on goes member by member. It owns
the records that start inside its range and reads past the range's end to
finish the last one, so every record is read once however files are split.

Writing: of records with equal payloads of at least ``SHARED`` bytes, the one
with the smallest page_id is a response and the others are revisits that refer
to it; a revisit keeps the HTTP head, whose Content-Length tells the payload's
size. Archives are written to the folder that the cluster shares, under a
temporary name first, so that a task that runs again leaves one file.

Defined cases: null html is an empty payload; null urls are empty; a null
page_id is kept as null and never referred to. Repeated rows are records of
their own, and all rows with the smallest page_id of their payload are
responses. An empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import cut, join_by_key, remove, shared_dir

SHARED = 100
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
ID = "urn:rankloom:page:"
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT = 4 << 20
PIECE = 1 << 20


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path, and the path in it. Archives need one that pyarrow knows: a mounted folder, S3 (by any of its schemes), GCS, or HDFS with libhdfs."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def safe(value: str) -> str:
    """A header's value in one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    heads = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", safe(url))]
    if refers_to is None:
        block += payload
    else:
        heads += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    heads += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: which rows are revisits, and of what.

    Only (page_id, digest) pairs of repeated payloads meet by digest; html
    moves once, by page_id.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    ids = cut(rows.where(F.octet_length("html") >= SHARED).select("page_id", "digest"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = join_by_key(ids, first, "digest", "n", ids.count()).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of deduplicated(pages) in a shared folder; path and bytes of each, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        held, out = f"{name}.{task.taskAttemptId()}.tmp", None
        try:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(held)
                    out.write(member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            fs.move(held, name)
            yield pa.RecordBatch.from_pydict({"path": [folder + name[len(base) :]], "bytes": [fs.get_file_info(name).size]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return cut(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, bytes long"))


# ---- reading


class _File:
    """Bytes of a file from any offset on, read in pieces and let go of behind."""

    def __init__(self, file: pyarrow.NativeFile, at: int) -> None:
        self.file, self.size, self.start, self.data = file, file.size(), at, bytearray()

    def upto(self, end: int) -> None:
        """Hold bytes up to an offset, or to the end of the file."""
        end = min(end, self.size)
        have = self.start + len(self.data)
        if have < end:
            self.data += self.file.read_at(max(PIECE, end - have), have)

    def drop(self, at: int) -> None:
        if at - self.start > PIECE:
            del self.data[: at - self.start]
            self.start = at

    def find(self, what: bytes, at: int, end: int) -> int:
        """Where ``what`` begins in [at, end), or -1."""
        while at < end:
            self.upto(min(end, at + PIECE) + len(what) - 1)
            found = self.data.find(what, at - self.start, min(end, at + PIECE) - self.start + len(what) - 1)
            if found >= 0:
                return self.start + found
            at = min(end, at + PIECE)
            self.drop(at)
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The member at an offset and where it ends, if a whole WARC record is there."""
        unpack, out, pos = zlib.decompressobj(31), [], at
        got, started = 0, False
        try:
            while not unpack.eof:
                self.upto(pos + 65536)
                piece = bytes(self.data[pos - self.start : pos - self.start + 65536])
                if not piece:
                    return None
                out.append(unpack.decompress(piece))
                got += len(out[-1])
                pos += len(piece)
                if not started and got >= len(VERSION):
                    if not b"".join(out).startswith(b"WARC/1."):
                        return None
                    started = True
        except zlib.error:
            return None
        end = pos - len(unpack.unused_data)
        self.upto(end + len(MAGIC))
        behind = self.data[end - self.start : end - self.start + len(MAGIC)]
        return (b"".join(out), end) if started and bytes(behind) in (b"", MAGIC) else None


@dataclass(frozen=True, slots=True)
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    def page(self, header: str) -> int | None:
        digits = self.headers.get(header, "").strip("<>").removeprefix(ID)
        return int(digits) if digits else None

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line), payload


def parse(data: bytes, offset: int) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
    return Record(offset, headers, rest[: int(headers["Content-Length"])])


def records(file: pyarrow.NativeFile, start: int, end: int) -> Iterator[Record]:
    """The records that start in [start, end)."""
    held, at = _File(file, start), start
    while (at := held.find(MAGIC, at, end)) >= 0:
        found = held.member(at)
        if found is None:
            at += 1
            continue
        yield parse(found[0], at)
        at = found[1]
        held.drop(at)


def splits(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """path, start, end of byte ranges of files(path, bytes)."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    return ranges.select("path", "start", F.least(F.col("start") + size, "bytes").alias("end"))


def read(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """A row for each record of files(path, bytes); payload digests are made anew from what a record holds."""
    spread = splits(files, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = filesystem(path)
                rows = []
                with fs.open_input_file(name) as f:
                    for r in records(f, start, end):
                        head, payload = r.http()
                        claimed = r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = r.headers["WARC-Type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != claimed:
                            raise ValueError(f"{path} at byte {r.offset}: the payload doesn't have its digest")
                        n = len(payload) if kind == "response" else int(head["Content-Length"])
                        rows.append((r.page("WARC-Record-ID"), n, claimed, kind, r.page("WARC-Refers-To"), path, r.offset, r.headers.get("WARC-Target-URI", "")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return spread.repartition("path", "start").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """The digest rows: every page written to archives in the shared folder and read back from them."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = write(deduplicated(pages), folder)
    rows = cut(read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, folder)
    return rows


ORACLE = f"""
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (
  SELECT page_id, html, first, octet_length(encode(coalesce(html, ''))) >= {SHARED} AND page_id <> first AS again
  FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""
