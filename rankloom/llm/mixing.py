"""Mix sources to target weights with Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, at most ``max_epochs``
times what the source has; what one cannot take is shared out again by weight.
A source is taken in complete epochs first. The rest of its target is filled
by weighted sampling without replacement: every document draws an exponential
key scaled by its quality weight, keys are sorted within the source and the
sorted sizes prefix-summed to the budget. The document at the budget's edge is
in if more than half of it fits, so that a source misses its target by half a
document at most.

The prefix sum never sorts a whole source in one task: keys fall into buckets
of about ``rows_per_bucket`` rows, buckets are summed first (by ``running``, so
that not even all buckets of a source need meet), and rows are sorted within
(source, bucket) only. Buckets are cut where the keys of the source's own mix
of weights lie (weights are told apart by ``GRADES`` steps to an octave), so
they are even at any weight.

Defined cases: a null source is a source of its own, last in order. Rows of
null ids draw by their source and size. A null or
empty text has size 0 and is never taken. Repeated rows are rows of their own.
Null, NaN, infinite, zero or negative quality weights count as 1. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import WORD, cut, fresh, hashed, running

SEED = "mix-1"
#: Weights of labelled documents; all others weigh 1.
GOOD, POOR = 2.0, 0.5
#: Steps of an octave in which weights are counted, to cut buckets by.
GRADES = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, n, source_size, target from rows (source, size), one per source.

    The cap is solved in closed form: ordered by the level at which they reach
    their caps, sources before the cut take their caps and the others share
    the rest by weight. One row per source passes the unpartitioned windows.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place).withColumn("w", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("long"))
    per = per.withColumn("most", F.col("source_size") * max_epochs)
    before = Window.orderBy(F.col("most") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    rest = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0))
    shares = F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", rest.cast("double") / shares.cast("double"))
    fits = F.col("level") <= F.col("most") / F.col("w")
    first = F.min(F.when(fits, F.struct((F.col("most") / F.col("w")).alias("at"), "place", "level"))).over(everywhere)
    target = F.least(F.col("most").cast("double"), F.col("w") * F.coalesce(first["level"], F.lit(0.0)))
    return per.select("source", "n", "source_size", target.alias("target"))


def expected_share(key: Column, grades: Column) -> Column:
    """The share of a source's keys that should lie below one, by how many rows have weights of each grade.

    Grades are summed in their order, so every evaluation gives the same double,
    and the sum never falls as keys grow.
    """
    below = F.aggregate(grades, F.lit(0.0), lambda total, g: total + g["rows"] * (1 - F.exp(-F.pow(F.lit(2.0), g["grade"] / float(GRADES)) * key)))
    return below / F.aggregate(grades, F.lit(0.0), lambda total, g: total + g["rows"])


def mix(
    docs: DataFrame,
    *,
    size: Column | None = None,
    quality: Column | None = None,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = SEED,
    rows_per_bucket: int = 1000,
) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, a row for each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    quality = F.lit(1.0) if quality is None else quality.cast("double")
    # A null id draws by what else is known of its row; equal rows are interchangeable.
    drawn_by = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("null"), F.xxhash64(size, "source").cast("string")))
    u = (hashed(seed, drawn_by).cast("double") + 0.5) / float(1 << 48)
    weight = F.when((quality > 0) & (quality < float("inf")), quality).otherwise(1.0)
    grade = F.round(F.log2(weight) * GRADES).cast("int")
    rows = cut(docs.select("doc_id", "source", size.cast("long").alias("size"), (-F.log(u) / weight).alias("key"), grade.alias("grade")))
    targets = source_targets(rows, weights, max_epochs).withColumnRenamed("source", "s")
    grades = rows.groupBy("source", "grade").agg(F.count(F.lit(1)).alias("rows")).groupBy(F.col("source").alias("of"))
    grades = grades.agg(F.sort_array(F.collect_list(F.struct("grade", "rows"))).alias("grades"))
    targets = targets.join(grades, F.col("s").eqNullSafe(F.col("of"))).drop("of")
    place = F.floor(expected_share(F.col("key"), F.col("grades")) * F.ceil(F.col("n") / rows_per_bucket))
    dealt = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", place).drop("s", "grade", "grades")
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = running(sums, ["source"], "bucket", "in_bucket", "before").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    so_far = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    fits = so_far + F.col("size") / 2.0 <= rest
    taken = F.col("size") * (F.col("epochs") + F.when(fits, 1).otherwise(0))
    return dealt.withColumn("epochs", epochs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def repeat_by_mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it. Rows of equal doc_id are taken equally often."""
    rows = with_quality(sized(docs), labels)
    taken = mix(rows, size=F.col("size"), quality=F.col("quality_weight")).where("taken > 0")
    of, times, time = (fresh(name, docs) for name in ("of", "times", "time"))
    often = taken.groupBy(F.col("doc_id").alias(of)).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias(times))
    joined = docs.join(cut(often), F.col("doc_id").eqNullSafe(F.col(of)))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(time)).drop(time)


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, source, size) with a quality weight from labels: GOOD, POOR or 1 where there is none."""
    found = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("good"))
    weight = F.when(F.col("good") >= 1, GOOD).when(F.col("good") < 1, POOR).otherwise(1.0)
    return docs.join(found, F.col("doc_id") == F.col("labelled"), "left").withColumn("quality_weight", weight).drop("labelled", "good")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


ORACLE = f"""
WITH lab AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    -ln((('0x' || substr(md5('{SEED}|' || documents.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / CASE WHEN good >= 1 THEN {GOOD} WHEN good < 1 THEN {POOR} ELSE 1.0 END AS key
  FROM documents LEFT JOIN lab ON documents.doc_id = lab.doc_id),
p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS most, 1 + place % 3 AS w FROM p),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0)::DOUBLE)
    / ((sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER b, 0)::DOUBLE) AS level
  FROM w WINDOW b AS (ORDER BY most::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS shared FROM l WHERE level <= most::DOUBLE / w ORDER BY most::DOUBLE / w, place LIMIT 1),
t AS (
  SELECT source, source_size, least(most::DOUBLE, w * shared) AS target,
    CASE WHEN source_size > 0 THEN floor(least(most::DOUBLE, w * shared) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM l, f),
c AS (
  SELECT doc_id, size, source_size, target, epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN so_far + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
