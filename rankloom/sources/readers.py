"""Sources: tables, JSON lines, corpora of text files, and a download with retries.

Every read has an explicit schema; nothing is inferred.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T

GOLDEN = "id string, question string, source_docs array<string>, answer string, answer_spans array<string>, difficulty string, failure_mode string"
GOLD = "id string, gold_chunks array<string>, why string"
RESULTS = "system string, qid string, ranked array<string>, gold array<string>, seconds double, support double, required array<string>"
CHUNKS = "id string, doc string, ord int, heading_path string, kind string, text string, n_tokens int, oversized boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, a missing file is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


MARK = 739188227
#: Ranges of files whose line counts are joined by broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text of every line of files that tasks read by ranges.

    Each range's lines are counted, the counts summed over the ranges before it,
    and a line is told by its place in its range. Lines end with a line feed, a
    carriage return before it is left out, and the last one needs no end.
    """
    place = ["file", "start"]
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    ranges = read.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("before", F.coalesce(before, F.lit(0))).persist()
    joined = read.join(F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges, place)
    return joined.select(F.element_at(F.split("file", "/"), -1).alias("file"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def json_lines_strict(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their line numbers, and the lines that don't parse: (rows, problems(file, line, text))."""
    # A parser stops behind the first value, so what follows it shows in an array with a mark at its end.
    mark = f"try_parse_json('[' || text || ',{MARK}]')"
    valid = F.expr(f"try_parse_json(text) is not null and coalesce(try_variant_get({mark}, '$[1]', 'int') = {MARK}, false) and try_variant_get({mark}, '$[2]', 'string') is null")
    found = numbered_lines(spark, path).where(T.stripped(F.col("text")) != "").withColumn("row", F.from_json("text", schema)).withColumn("valid", valid)
    return found.where("valid").select("line", "row.*"), found.where("not valid").select("file", "line", "text")


def corpus(spark: SparkSession, path: str, documentation_only: bool = True) -> DataFrame:
    """name, text of a folder of Markdown files; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return files.where(T.is_documentation(F.col("name"))) if documentation_only else files


def manifest(files: DataFrame) -> DataFrame:
    """name, sha256, bytes of files(name, text)."""
    return files.select("name", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by an explicit order column."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def fetch(url: str, retries: int = 3, *, opener: Callable = urllib.request.urlopen, pause: Callable[[float], None] = time.sleep) -> bytes:
    """A download. Refusals (403) and broken connections are tried again after 1, 2, 4... seconds; other answers raise."""
    for attempt in range(retries):
        try:
            with opener(url, timeout=30) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code != 403 or attempt == retries - 1:
                raise
        except urllib.error.URLError:
            if attempt == retries - 1:
                raise
        pause(2.0**attempt)
    raise ValueError("retries must be positive")


def list_documentation(listing: bytes) -> list[dict]:
    """The documentation files of a repository listing in JSON."""
    return [x for x in json.loads(listing) if x["type"] == "file" and x["name"].endswith(".md") and x["name"] not in ("README.md", "index.md", "404.md")]


def fetch_corpus(listing: str, folder: str, *, verify: bool = False, get: Callable[[str], bytes] = fetch) -> dict:
    """Download the documentation files that a listing names into a folder of the driver, with a manifest of what is there.

    Files that are there stay, unless ``verify`` downloads and hashes all anew.
    """
    place, found = Path(folder), {}
    place.mkdir(parents=True, exist_ok=True)
    for entry in list_documentation(get(listing)):
        if Path(entry["name"]).name != entry["name"]:
            raise ValueError(f"not a file name: {entry['name']!r}")
        at = place / entry["name"]
        if verify or not at.exists():
            at.write_bytes(get(entry["download_url"]))
        content = at.read_bytes()
        found[entry["name"]] = {"sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content), "upstream_sha": entry.get("sha")}
    (place / "manifest.json").write_text(json.dumps(found, indent=2, sort_keys=True), encoding="utf-8")
    return found
