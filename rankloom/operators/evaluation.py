"""Metrics, summaries, paired tests, the regression gate and diagnostics.

Results are rows (system, qid, ranked, gold, seconds, support, required):
``ranked`` best first without repeats, one row for each system and question.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
METRICS = ("recall@1", "recall@5", "recall@10", "hit@1", "hit@5", "mrr@10", "support@5", "ms")
# How far a metric may fall before the gate fails.
TOLERANCE = {"recall@1": 0.05, "recall@5": 0.05, "recall@10": 0.05, "hit@1": 0.10, "hit@5": 0.10, "mrr@10": 0.05, "support@5": 0.10}
LATENCY_FACTOR, LATENCY_SLACK_MS = 2.0, 5.0
EXACT_LIMIT = 20
SLACK = 1e-12


def cut(ranked: Column, k: int) -> Column:
    if k <= 0:
        raise ValueError("k must be positive")
    return F.slice(ranked, 1, k)


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    want = F.array_distinct(gold)
    return F.when(F.size(want) == 0, F.raise_error(F.lit("no gold labels"))).otherwise(F.size(F.array_intersect(want, cut(ranked, k))) / F.size(want))


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.size(F.array_intersect(cut(ranked, k), gold)) > 0, F.lit(False))


def reciprocal_rank(ranked: Column, gold: Column, k: int | None = None) -> Column:
    places = F.transform(ranked if k is None else cut(ranked, k), lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def evidence_support(texts: Column, required: Column) -> Column:
    """The share of required strings found, whatever their case, in texts joined by newlines; 1 if none is required."""
    joined = F.lower(F.array_join(texts, "\n"))
    n = F.size(required)
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(required, lambda r: joined.contains(F.lower(r)))) / F.greatest(n, F.lit(1)))


def with_metrics(results: DataFrame) -> DataFrame:
    ranked, gold = F.col("ranked"), F.col("gold")
    columns = {f"recall@{k}": recall_at(ranked, gold, k) for k in KS} | {f"hit@{k}": hit_at(ranked, gold, k).cast("double") for k in KS}
    return results.withColumns(columns | {"mrr@10": reciprocal_rank(ranked, gold, 10), "support@5": F.col("support"), "ms": F.col("seconds") * 1000})


def summarise(results: DataFrame) -> DataFrame:
    names = [f"recall@{k}" for k in KS] + [f"hit@{k}" for k in KS] + ["mrr@10", "support@5", "ms"]
    return with_metrics(results).groupBy("system").agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(f"`{m}`")).alias(m) for m in names))


def per_question(results: DataFrame, order: str | None = None) -> DataFrame:
    """system, qid, metric, value; of repeated (system, qid) the last by ``order``."""
    if order:
        results = results.groupBy("system", "qid").agg(F.max_by(F.struct(*results.columns), order).alias("r")).select("r.*")
    rows = with_metrics(results)
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in METRICS)))
    return rows.select("system", "qid", pairs.alias("x")).select("system", "qid", "x.metric", "x.value")


def paired(scores: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """a, b, metric, qid, diff = a - b over the questions that both systems answered."""
    left = scores.select(F.col("system").alias("a"), "qid", "metric", F.col("value").alias("va"))
    right = scores.select(F.col("system").alias("b"), "qid", "metric", F.col("value").alias("vb"))
    joined = left.join(right, ["qid", "metric"]).where("a <> b")
    if a:
        joined = joined.where(F.col("a") == a)
    if b:
        joined = joined.where(F.col("b") == b)
    return joined.select("a", "b", "metric", "qid", (F.col("va") - F.col("vb")).alias("diff"))


def _folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def compare(diffs: DataFrame) -> DataFrame:
    """For each (a, b, metric): n, diff, the exact two-sided sign-flip p, its floor, and the questions that moved.

    All 2^n sign vectors of up to ``EXACT_LIMIT`` questions are counted; beyond
    that p is null. Sums of a vector's halves meet in the middle: those of one
    half are put in order once, among the bounds that each sum of the other half
    sets, and counted by a running sum, so there are some 3 x 2^(n/2) rows.
    """
    by = ["a", "b", "metric"]
    grouped = diffs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("qid", "diff"))).alias("rows"))
    grouped = grouped.select(*by, F.transform("rows", lambda r: r["diff"]).alias("d"))
    moved = F.size(F.filter("d", lambda x: F.abs(x) > SLACK))
    grouped = grouped.withColumns({"n": F.size("d"), "moved": moved, "observed": F.abs(_folded(F.col("d")))})
    half = F.floor(F.col("n") / 2).cast("int")
    sums = lambda part: F.aggregate(part, F.array(F.lit(0.0)), lambda acc, x: F.concat(F.transform(acc, lambda y: y + x), F.transform(acc, lambda y: y - x)))
    small = grouped.where(F.col("n").between(1, EXACT_LIMIT))
    halves = small.select(*by, "n", (F.col("observed") - SLACK).alias("least"), sums(F.slice("d", F.lit(1), half)).alias("low"), sums(F.slice("d", half + 1, F.col("n"))).alias("high"))
    # at equal values a bound from below comes before the sums, and one from above behind them
    marks = F.concat(
        F.transform("low", lambda x: F.struct((F.col("least") - x).alias("at"), F.lit(0).alias("kind"))),
        F.transform("high", lambda y: F.struct(y.alias("at"), F.lit(1).alias("kind"))),
        F.transform("low", lambda x: F.struct((-F.col("least") - x).alias("at"), F.lit(2).alias("kind"))))
    placed = halves.select(*by, "n", "least", F.size("high").alias("many"), F.explode(marks).alias("m")).select(*by, "n", "least", "many", "m.*")
    so_far = F.count_if(F.col("kind") == 1).over(Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    beyond = F.when(F.col("kind") == 0, F.col("many") - F.col("so_far")).when(F.col("kind") == 2, F.col("so_far"))
    counted = placed.withColumn("so_far", so_far).groupBy(*by, "n", "least").agg(F.sum(beyond).alias("beyond"))
    tested = counted.select(*by, F.when(F.col("least") <= 0, 1.0).otherwise(F.col("beyond") / F.pow(F.lit(2.0), F.col("n"))).alias("p"))
    floor = F.when(F.col("moved") == 0, 1.0).otherwise(2.0 / F.pow(F.lit(2.0), F.col("moved")))
    return grouped.join(tested, by, "left").select(*by, "n", (_folded(F.col("d")) / F.col("n")).alias("diff"), "p", floor.alias("p_floor"), "moved")


def draws(seed: int, n: int, reps: int, at_once: int = 1 << 21) -> Iterator[np.ndarray]:
    """Rows of n numbers below n, ``reps`` in all: what CPython's seeded ``randrange(n)`` gives one after another.

    The generator's raw words are taken by blocks; a word's high bits are a
    draw, and draws that are too large are passed over.
    """
    words, bits = np.random.MT19937(), n.bit_length()
    state = random.Random(seed).getstate()[1]
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    rest, done = np.zeros(0, np.int64), 0
    while done < reps:
        drawn = (words.random_raw(at_once) >> np.uint64(32 - bits)).astype(np.int64)
        rest = np.concatenate([rest, drawn[drawn < n]])
        rows = min(len(rest) // n, reps - done)
        if rows:
            yield rest[: rows * n].reshape(rows, n)
        rest, done = rest[rows * n :], done + rows


def compensated(columns: Iterator[np.ndarray]) -> np.ndarray:
    """Sums of columns as CPython's ``sum`` adds doubles: what a sum loses is kept and added last."""
    total = lost = None
    for x in columns:
        if total is None:
            total, lost = x + 0.0, np.zeros(len(x))
            continue
        new = total + x
        lost = lost + np.where(np.abs(total) >= np.abs(x), (total - new) + x, (x - new) + total)
        total = new
    return total + lost


def bootstrap(diffs: DataFrame, reps: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """a, b, metric, ci_low, ci_high by resampling questions with CPython's seeded generator, replayed in blocks.

    Pairs of as many questions draw the same numbers, so they share a task's blocks: rows of a group are (a, b, metric, d).
    """
    by = ["a", "b", "metric"]
    grouped = diffs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("qid", "diff"))).alias("rows"))
    grouped = grouped.select(*by, F.transform("rows", lambda r: r["diff"]).alias("d")).withColumn("n", F.size("d"))
    # Which of the means in order bound the interval.
    low, high = int(alpha / 2 * reps), min(int((1 - alpha / 2) * reps), reps - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, same in batch.groupby("n"):
                d = np.stack([np.asarray(x, np.float64) for x in same["d"]])
                means = [[] for _ in d]
                for drawn in draws(seed, int(n), reps):
                    for values, found in zip(d, means, strict=True):
                        found.append(compensated(values[column] for column in drawn.T) / n)
                ordered = np.sort(np.array([np.concatenate(x) for x in means]), axis=1)
                yield pd.DataFrame({c: same[c].to_numpy() for c in by} | {"ci_low": ordered[:, low], "ci_high": ordered[:, high]})

    return grouped.repartition("n", "metric").mapInPandas(run, "a string, b string, metric string, ci_low double, ci_high double")


def bootstrap_hashed(diffs: DataFrame, reps: int = 1000, alpha: float = 0.05, seed: str = "b0") -> DataFrame:
    """The same from a hash instead of a generator, in SQL functions: order statistics of resampled means."""
    by = ["a", "b", "metric"]
    grouped = diffs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("qid", "diff"))).alias("rows"))
    grouped = grouped.select(*by, F.transform("rows", lambda r: r["diff"]).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draw = lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.size("d")).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.get(F.col("d"), draw(i)))
    means = grouped.select(*by, "rep", (_folded(drawn) / F.size("d")).alias("mean"))
    means = means.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("mean", "rep")))
    low, high = int(alpha / 2 * reps) + 1, min(int((1 - alpha / 2) * reps), reps - 1) + 1
    return means.groupBy(*by).agg(F.max(F.when(F.col("place") == low, F.col("mean"))).alias("ci_low"), F.max(F.when(F.col("place") == high, F.col("mean"))).alias("ci_high"))


def decided(p_floor: Column, ci_low: Column, ci_high: Column) -> Column:
    crosses = (ci_low <= 0) & (ci_high >= 0)
    return F.when(crosses & (p_floor > 0.05), "capped").when(crosses, "undecided").when(p_floor <= 0.05, "decided").otherwise("overruled")


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """system, metric, status, change of summaries in long form (system, n, metric, value).

    ok, up, fail, partial (fewer questions than the baseline), missing (no such
    system in the baseline). Values are compared as they are, without rounding.
    """
    base = baseline.select("system", "metric", F.col("n").alias("bn"), F.col("value").alias("bv"))
    joined = current.join(base, ["system", "metric"], "left")
    limits = F.create_map(*(F.lit(x) for kv in TOLERANCE.items() for x in kv))
    tolerance = F.try_element_at(limits, F.col("metric"))
    drop = F.col("bv") - F.col("value")
    slow = (F.col("value") > LATENCY_FACTOR * F.col("bv")) & (F.col("value") - F.col("bv") > LATENCY_SLACK_MS)
    status = (
        F.when(F.col("bv").isNull(), "missing").when(F.col("n") != F.col("bn"), "partial").when((F.col("metric") == "ms") & slow, "fail").when(F.col("metric") == "ms", "ok")
        .when(drop > tolerance, "fail").when(drop < -tolerance, "up").otherwise("ok"))
    return joined.where(F.col("metric").isin(*TOLERANCE, "ms")).select("system", "metric", status.alias("status"), (F.col("value") - F.col("bv")).alias("change"))


def long_summary(summary: DataFrame) -> DataFrame:
    names = [*TOLERANCE, "ms"]
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in names)))
    return summary.select("system", "n", pairs.alias("x")).select("system", "n", "x.metric", "x.value")


def disagreements(results: DataFrame, k: int = 10) -> DataFrame:
    """Where evidence and labels differ: system, qid, kind, support, hit, required."""
    rows = results.withColumns({"hit": hit_at(F.col("ranked"), F.col("gold"), k), "required": F.coalesce("required", F.array().cast("array<string>"))})
    kind = F.when((F.col("support") >= 1) & ~F.col("hit"), "support without evidence").when((F.col("support") <= 0) & F.col("hit"), "evidence without support")
    return rows.withColumn("kind", kind).where("kind is not null").select("system", "qid", "kind", "support", "hit", "required")


def by_question(records: DataFrame, n_systems: int) -> DataFrame:
    systems = F.array_sort(F.collect_list("system"))
    return records.groupBy("qid", "kind").agg(systems.alias("systems")).withColumn("all_systems", F.size("systems") == n_systems)


def thin_anchors(results: DataFrame, order: str, threshold: int = 1) -> DataFrame:
    """Questions whose first row requires at most ``threshold`` strings."""
    first = results.groupBy("qid").agg(F.min_by("required", order).alias("required"))
    return first.where(F.size("required") <= threshold).select("qid", F.size("required").alias("n_required"))


def reciprocal_rank_pivot(results: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    rr = with_metrics(results).select("system", "qid", F.col("`mrr@10`").alias("rr"))
    return rr.groupBy("qid").pivot("system", list(systems)).agg(F.first("rr"))


def pending(systems: DataFrame, questions: DataFrame, done: DataFrame) -> DataFrame:
    """(system, qid) pairs of a stated few systems that have no result yet."""
    return systems.select("system").join(questions.select("qid")).join(done.select("system", "qid"), ["system", "qid"], "left_anti")


def sliced(questions: DataFrame, text: str | None, order: str = "ord") -> DataFrame:
    """Questions of a slice "a:b" over their order; negative bounds count from the end."""
    if not text:
        return questions
    low, _, high = text.partition(":")
    n = questions.count()
    a, b, _ = slice(int(low) if low else None, int(high) if high else None).indices(n)
    place = F.row_number().over(Window.orderBy(order)) - 1
    return questions.withColumn("_at", place).where(F.col("_at").between(a, b - 1)).drop("_at")
