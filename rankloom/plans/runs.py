"""Evaluation runs: strict labels, the four systems, resumable results, reports and baselines."""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import evaluation as E
from rankloom.operators import index as I
from rankloom.operators import retrieval as R
from rankloom.sources.stored import exists
from rankloom.streaming.jobs import append_results

SYSTEMS = ("dense", "bm25", "fused", "rerank")
DEPTH, POOL = 10, 50


def known(systems: Sequence[str]) -> list[str]:
    if unknown := sorted(set(systems) - set(SYSTEMS)):
        raise ValueError(f"unknown systems {unknown}; there are {list(SYSTEMS)}")
    return list(systems)


def labelled(golden: DataFrame, gold: DataFrame, most: int = 20) -> DataFrame:
    """line, qid, text, gold, required, source_docs: questions with their labels, one to one.

    An id that only one side has is an error, which names ``most`` at most.
    """
    labels = gold.select(F.col("id").alias("labelled"), "gold_chunks")
    joined = golden.join(labels, F.col("id") == F.col("labelled"), "full_outer")
    for side, ids in (("questions without gold labels", joined.where("labelled is null").select("id")), ("gold labels without a question", joined.where("id is null").select("labelled"))):
        if found := [r[0] for r in ids.distinct().orderBy(ids.columns[0]).limit(most).collect()]:
            raise ValueError(f"{side}: {found}")
    required = T.required_evidence(F.col("answer"), F.col("answer_spans"))
    return joined.select("line", F.col("id").alias("qid"), F.col("question").alias("text"), F.col("gold_chunks").alias("gold"), required.alias("required"), "source_docs")


def hits(system: str, index: I.Index, questions: DataFrame, k: int = DEPTH, *, pool: int = POOL, encode: I.Encoder = I.stand_in, scorer: R.PairScorer | None = None) -> DataFrame:
    """qid, id, rank, score of one system for all questions(qid, text)."""
    known([system])
    if system == "dense":
        return I.dense(index, questions, k, encode)
    if system == "bm25":
        return I.bm25(index, questions, k)
    lists = [I.dense(index, questions, pool, encode), I.bm25(index, questions, pool)]
    if system == "fused":
        return R.fuse(lists, k)
    return R.rerank(R.fuse(lists, pool), questions, index.texts, k, scorer)


def results_of(system: str, found: DataFrame, index: I.Index, questions: DataFrame, seconds: float) -> DataFrame:
    """Result rows of hits; a question without hits has an empty ranking."""
    texts = index.texts.select("id", "text")
    best = found.where("rank <= 5").join(texts, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("best"))
    ranked = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ranked"))
    none = F.array().cast("array<string>")
    rows = questions.join(ranked, "qid", "left").join(best, "qid", "left")
    support = E.evidence_support(F.coalesce(F.transform("best", lambda x: x["text"]), none), F.col("required"))
    return rows.select(F.lit(system).alias("system"), "qid", F.coalesce("ranked", none).alias("ranked"), "gold", F.lit(seconds).alias("seconds"), support.alias("support"), "required")


def run(index: I.Index, questions: DataFrame, out: str, systems: Sequence[str] = SYSTEMS, *, budget: float | None = None, encode: I.Encoder = I.stand_in, scorer: R.PairScorer | None = None) -> int:
    """Evaluate systems one after another over the questions that ``out`` has no results of; returns how many rows are new.

    One question that isn't scored runs through each system first, so that
    times hold neither model loads nor the compilation of code. No system starts once ``budget`` seconds are over; what is written stays
    and another call goes on. ``seconds`` is a system's time for its whole
    batch, divided by the questions in it.
    """
    spark, began, written = questions.sparkSession, time.monotonic(), 0
    for system in known(systems):
        if budget is not None and time.monotonic() - began > budget:
            break
        todo = E.pending(spark.createDataFrame([(system,)], "system string"), questions, recorded(spark, out)).select("qid")
        todo = questions.join(todo, "qid", "left_semi").persist()
        n = todo.count()
        if n:
            warm_up([system], index, encode=encode, scorer=scorer)
            start = time.monotonic()
            found = hits(system, index, todo, encode=encode, scorer=scorer).persist()
            found.count()
            append_results(results_of(system, found, index, todo, (time.monotonic() - start) / n), out)
            found.unpersist()
        todo.unpersist()
        written += n
    return written


WARM_UP = "a question that loads models and compiles plans and that nobody scores"


def warm_up(systems: Sequence[str], index: I.Index, *, encode: I.Encoder = I.stand_in, scorer: R.PairScorer | None = None) -> None:
    """Run one question through each system and drop the answer; a BM25 run touches neither vectors nor models."""
    asked = index.spark.createDataFrame([("warm-up", WARM_UP)], "qid string, text string")
    for system in known(systems):
        hits(system, index, asked, 1, encode=encode, scorer=scorer).write.format("noop").mode("overwrite").save()


def stage_ms(index: I.Index, questions: DataFrame, k: int = DEPTH, *, pool: int = POOL, encode: I.Encoder = I.stand_in, scorer: R.PairScorer | None = None) -> dict[str, float]:
    """Milliseconds a question of each stage of the whole pipeline: dense, bm25, fuse, rerank; each stage reads what the one before has made."""
    warm_up(["rerank"], index, encode=encode, scorer=scorer)
    n, took, held = max(1, questions.count()), {}, []

    def timed(stage: str, made: DataFrame) -> DataFrame:
        start = time.monotonic()
        held.append(made.persist())
        made.count()
        took[stage] = (time.monotonic() - start) * 1000 / n
        return made

    lists = [timed("dense", I.dense(index, questions, pool, encode)), timed("bm25", I.bm25(index, questions, pool))]
    timed("rerank", R.rerank(timed("fuse", R.fuse(lists, pool)), questions, index.texts, k, scorer))
    for df in held:
        df.unpersist()
    return took


class Watched:
    """Rows that each stage of one run gives the next, counted while it runs: nothing is kept and no stage runs twice."""

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}

    def stage(self, name: str, made: DataFrame) -> DataFrame:
        """The stage's rows, counted as they pass; each stage is read once in the plan."""
        self.stages[name] = Observation()
        return made.observe(self.stages[name], F.count(F.lit(1)).alias("n"))

    def run(self, last: DataFrame) -> tuple[dict[str, int], float]:
        """Rows by stage, and the seconds of the whole run."""
        start = time.monotonic()
        last.write.format("noop").mode("overwrite").save()
        took = time.monotonic() - start
        return {name: int(seen.get["n"]) for name, seen in self.stages.items()}, took


def recorded(spark, out: str) -> DataFrame:
    """system, qid of the results that are there."""
    return spark.read.parquet(out).select("system", "qid") if exists(spark, out) else spark.createDataFrame([], "system string, qid string")


def source_found(found: DataFrame, index: I.Index, questions: DataFrame, k: int = 5) -> DataFrame:
    """qid, found: whether any of a question's source documents is among the documents of its first k hits."""
    docs = found.where(F.col("rank") <= k).join(index.texts.select("id", "doc"), "id").groupBy("qid").agg(F.collect_set("doc").alias("docs"))
    return questions.join(docs, "qid", "left").select("qid", F.coalesce(F.arrays_overlap("docs", "source_docs"), F.lit(False)).alias("found"))


def in_order(summary: DataFrame) -> list:
    """A summary's rows, one for each system, in the systems' order; the mean of nothing is an error."""
    if not (rows := summary.collect()):
        raise ValueError("no results: nothing to average")
    return sorted(rows, key=lambda r: (SYSTEMS.index(r["system"]) if r["system"] in SYSTEMS else len(SYSTEMS), r["system"]))


def report(results: DataFrame, n_questions: int) -> list[str]:
    """A Markdown table of all systems, and of reciprocal ranks by question."""
    rows = in_order(E.summarise(results))
    lines = ["| system | n | " + " | ".join(E.METRICS) + " |", "|" + "---|" * (len(E.METRICS) + 2)]
    for r in rows:
        cells = [f"{r[m]:.0f}" if m == "ms" else f"{r[m]:.3f}" for m in E.METRICS]
        lines.append(f"| {r['system']} | {r['n']}{'' if r['n'] == n_questions else '  (partial)'} | " + " | ".join(cells) + " |")
    systems = [r["system"] for r in rows]
    lines += ["", "| qid | " + " | ".join(systems) + " |", "|" + "---|" * (len(systems) + 1)]
    for r in E.reciprocal_rank_pivot(results, tuple(systems)).orderBy("qid").collect():
        lines.append(f"| {r['qid']} | " + " | ".join("" if r[s] is None else f"{r[s]:.3f}" for s in systems) + " |")
    return lines


# ---- baselines


def commit() -> str | None:
    """The short name of the commit that runs, if there is one."""
    try:
        done = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None


def write_baseline(results: DataFrame, n_questions: int, note: str, path: str) -> dict:
    """Store the summaries of complete systems as JSON; a system with fewer or more questions is an error."""
    if not note.strip():
        raise ValueError("a baseline needs a note that says why it moved")
    stats = {r["system"]: {k: v for k, v in r.asDict().items() if k != "system"} for r in in_order(E.summarise(results))}
    if partial := {s: v["n"] for s, v in stats.items() if v["n"] != n_questions}:
        raise ValueError(f"partial runs can't be a baseline: {partial}, expected {n_questions} questions")
    payload = {"note": note, "commit": commit(), "questions": n_questions, "systems": stats}
    text = json.dumps(payload, indent=2, sort_keys=True)
    results.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return payload


def read_baseline(spark, path: str) -> DataFrame:
    """A baseline as a long summary (system, n, metric, value)."""
    if not exists(spark, path):
        raise ValueError(f"no baseline at {path}")
    systems = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))["systems"]
    rows = [(s, int(v["n"]), m, float(v[m])) for s, v in systems.items() for m in [*E.TOLERANCE, "ms"]]
    return spark.createDataFrame(rows, "system string, n long, metric string, value double")


def check(results: DataFrame, baseline: DataFrame, systems: Sequence[str] | None = None) -> tuple[list[str], bool]:
    """The gate's lines, and whether it passes."""
    if systems:
        results = results.where(F.col("system").isin(*known(systems)))
    rows = E.gate(E.long_summary(E.summarise(results)), baseline).orderBy("system", "metric").collect()
    if not rows:
        raise ValueError("no results to check")
    lines = [f"{r['system']} {r['metric']}: {r['status']}" + ("" if r["change"] is None else f" ({r['change']:+.3f})") for r in rows]
    return lines, all(r["status"] not in ("fail", "partial") for r in rows)


def significance(results: DataFrame, a: str | None = None, b: str | None = None, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """a, b, metric with difference, interval, exact p, its floor, questions moved and the decision."""
    diffs = E.paired(E.per_question(results), a, b)
    rows = E.compare(diffs).join(E.bootstrap(diffs, reps, seed=seed), ["a", "b", "metric"])
    return rows.withColumn("decision", E.decided(F.col("p_floor"), F.col("ci_low"), F.col("ci_high")))
