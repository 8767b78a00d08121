"""Command line: ``python -m rankloom COMMAND ...``. Paths may be in any store that Spark reads.

A failed gate, failed label checks, and (with --strict) a disagreement that all
systems share exit with 1.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import chunking, evaluation, labels
from rankloom.operators import index as I
from rankloom.plans import runs
from rankloom.sources import readers


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their line numbers; a line that doesn't parse is an error that names it."""
    rows, problems = readers.json_lines_strict(spark, path, readers.GOLDEN)
    if bad := problems.orderBy("line").first():
        raise ValueError(f"{bad['file']}:{bad['line']}: not JSON")
    return rows


def labelled(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return runs.labelled(golden(spark, args.golden), readers.json_lines(spark, args.gold, readers.GOLD))


def show(df: DataFrame) -> None:
    """Print all rows of a report, separated by tabs; the driver holds a partition at a time."""
    print("\t".join(df.columns))
    for r in df.toLocalIterator():
        print("\t".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))


def fetch(spark: SparkSession, args: argparse.Namespace) -> int:
    readers.fetch_corpus(args.listing, args.folder, verify=args.verify)
    return 0


def stats(spark: SparkSession, args: argparse.Namespace) -> int:
    found = labels.profile(readers.corpus(spark, args.corpus, documentation_only=False))
    show(found.agg(F.count(F.lit(1)).alias("files"), *(F.sum(c).alias(c) for c in found.columns[1:])))
    show(found.orderBy(F.desc("chars"), "name").limit(args.top))
    show(found.orderBy(F.desc("html_rows"), "name").limit(args.top).where("html_tables > 0"))
    return 0


def chunk(spark: SparkSession, args: argparse.Namespace) -> int:
    count = chunking.exact(args.tokenizer) if args.tokenizer else chunking.approximate
    chunking.chunk_documents(readers.corpus(spark, args.corpus), args.budget, args.overlap, count).write.mode("overwrite").parquet(args.out)
    show(chunking.chunk_stats(spark.read.parquet(args.out)))
    return 0


def index(spark: SparkSession, args: argparse.Namespace) -> int:
    I.build(spark.read.parquet(args.chunks), args.out)
    return 0


def search(spark: SparkSession, args: argparse.Namespace) -> int:
    at = I.Index(spark, args.index)
    asked = spark.createDataFrame([("q", args.question)], "qid string, text string")
    found = runs.hits(args.system, at, asked, args.k).join(at.texts.select("id", "text"), "id")
    show(found.select("rank", "id", "score", T.squashed(F.col("text")).alias("text")).orderBy("rank"))
    return 0


def smoke(spark: SparkSession, args: argparse.Namespace) -> int:
    at, asked = I.Index(spark, args.index), labelled(spark, args)
    for system in runs.known(args.systems.split(",")):
        r = runs.source_found(runs.hits(system, at, asked, 5), at, asked).agg(F.count_if("found"), F.count(F.lit(1))).first()
        print(f"{system}: {r[0]} of {r[1]} questions have a source document among the first 5 hits")
    print("ms a question by stage: " + ", ".join(f"{k} {v:.1f}" for k, v in runs.stage_ms(at, asked).items()))
    return 0


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    asked = evaluation.sliced(labelled(spark, args), args.slice, "line")
    print(runs.run(I.Index(spark, args.index), asked, args.results, args.systems.split(","), budget=args.seconds), "new rows")
    return 0


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    print(*runs.report(spark.read.parquet(args.results), golden(spark, args.golden).count()), sep="\n")
    return 0


def gate(spark: SparkSession, args: argparse.Namespace) -> int:
    lines, passed = runs.check(spark.read.parquet(args.results), runs.read_baseline(spark, args.baseline), args.systems and args.systems.split(","))
    print(*lines, "passed" if passed else "REGRESSION", sep="\n")
    return 0 if passed else 1


def baseline(spark: SparkSession, args: argparse.Namespace) -> int:
    runs.write_baseline(spark.read.parquet(args.results), golden(spark, args.golden).count(), args.note, args.baseline)
    return 0


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    show(runs.significance(spark.read.parquet(args.results), args.a, args.b, args.reps, args.seed).orderBy("a", "b", "metric"))
    return 0


def diagnose(spark: SparkSession, args: argparse.Namespace) -> int:
    results = spark.read.parquet(args.results)
    found = evaluation.by_question(evaluation.disagreements(results, args.k), results.select("system").distinct().count())
    show(found.orderBy("qid", "kind"))
    show(evaluation.thin_anchors(results, "system").orderBy("qid"))
    return 1 if args.strict and found.where("all_systems").count() else 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    rows, corpus = golden(spark, args.golden), readers.corpus(spark, args.corpus, documentation_only=False)
    lines = spark.read.text(args.golden, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "t"))
    fields = lines.select((F.col("at") + 1).alias("line"), F.from_json("t", "map<string,string>").alias("fields"))
    problems = labels.schema_problems(rows.join(fields, "line"), corpus.select("name")).orderBy("line", "problem", "detail")
    ungrounded = labels.ungrounded(rows, corpus, "line").orderBy("line", "kind", "missing")
    show(problems)
    show(ungrounded)
    show(rows.groupBy("difficulty").count().orderBy("difficulty"))
    if args.claims:
        claims = rows.select("line", F.col("id").alias("qid"), F.explode(T.claim_clauses(F.col("answer"))).alias("claim"))
        cited = rows.select("line", F.posexplode("source_docs").alias("pos", "name")).join(corpus, "name")
        passages = cited.select("line", "pos", F.posexplode(T.paragraphs(F.col("text"))).alias("at", "paragraph"))
        passages = passages.select("line", (F.col("pos").cast("long") * (1 << 40) + F.col("at")).alias("ord"), "paragraph")
        show(labels.weakest_first(labels.claim_coverage(claims, passages, "line")))
    return 1 if problems.count() + ungrounded.count() else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def add(f, *names: str, **options: object) -> None:
        """A command with positional paths and options by their defaults."""
        p = commands.add_parser(f.__name__)
        p.set_defaults(do=f)
        for n in names:
            p.add_argument(n)
        for n, value in options.items():
            if value is False:
                p.add_argument(f"--{n}", action="store_true")
            else:
                p.add_argument(f"--{n}", default=value, type=str if value is None else type(value))

    everything = ",".join(runs.SYSTEMS)
    add(fetch, "listing", "folder", verify=False)
    add(stats, "corpus", top=10)
    add(chunk, "corpus", "out", budget=512, overlap=64, tokenizer=None)
    add(index, "chunks", "out")
    add(search, "index", "system", "question", k=5)
    add(smoke, "index", "golden", "gold", systems=everything)
    add(run, "index", "golden", "gold", "results", systems=everything, slice="", seconds=38.0)
    add(report, "results", "golden")
    add(gate, "results", "baseline", systems="")
    add(baseline, "results", "golden", "baseline", "note")
    add(compare, "results", a=None, b=None, reps=10_000, seed=0)
    add(diagnose, "results", k=10, strict=False)
    add(validate, "golden", "corpus", claims=False)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rankloom").getOrCreate()
    try:
        return args.do(spark, args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
