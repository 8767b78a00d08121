"""Deal documents into shards by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's
fractional rank is (2 rank - 1) / (2 rows of the source). Sorted by it, all
sources run through the whole order at an even rate, so that equal cuts of the
order give shards of the overall mixture. The law is ``rows``: shard sizes in
rows differ by one at most.

Neither rank is made by sorting a source, or the table, in one task: rows fall
into buckets by hash, then by fractional rank, buckets are counted first, and
rows are sorted within a bucket only. Buckets hold ``rows_per_bucket`` rows on
average at any size, and their counts are summed in two levels by ``running``.

Defined cases: a null source is a source of its own; a null text has 16 bytes
and the checksum of no bytes; repeated rows are rows of their own, null ids
are dealt by their text's hash. An empty table gives an empty result. Other
columns of the input are ignored. Equal texts are not held together: the law
``rows`` lets shards differ by one row, which a group of more copies than that
would break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut, hashed, running

SEED = "shard-1"


def deal(docs: DataFrame, shards: int = 40, *, seed: str = SEED, rows_per_bucket: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), a row for each document."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text.cast("binary"))))).alias("draw")))
    total = rows.count()
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s")
    bucket = F.floor(F.col("draw") / float(1 << 48) * F.ceil(F.col("n") / rows_per_bucket))
    dealt = rows.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket)
    counts = dealt.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    counts = running(counts, ["source"], "bucket", "in_bucket", "before").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    shuffled = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size", "text_crc32")
    ranked = dealt.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(shuffled))
    ranked = cut(ranked.select(
        "doc_id", "source", "size", "text_crc32", "draw", ((2 * F.col("rank") - 1) / (2 * F.col("n"))).alias("part"),
        F.xxhash64(F.lit(seed), "source").alias("turn")))
    cells = max(1, -(-total // rows_per_bucket))
    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("part") * cells), F.lit(cells - 1)))
    counts = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell"))
    counts = running(counts, [], "cell", "in_cell", "before").select(F.col("cell").alias("c"), "before")
    order = Window.partitionBy("cell").orderBy("part", "turn", "source", "draw", "doc_id", "size", "text_crc32")
    placed = ranked.join(counts, F.col("cell") == F.col("c")).withColumn("at", F.col("before") + F.row_number().over(order) - 1)
    shard = F.expr(f"(at * {shards}L) div {max(total, 1)}L")
    placed = placed.withColumn("shard", shard)
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
