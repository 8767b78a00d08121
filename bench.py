"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["bm25_topk", "bm25_blockmax_topk", "dense_topk", "dense_pruned_topk", "rrf_fuse", "rerank_stub", "summary_by_system", "paired_differences", "gate_status", "corpus_profile", "fixed_window_chunks", "structure_chunks"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from rankloom.plans import catalogue

    found, took, cold = catalogue.queries(), {}, {}
    for warm in (True, False):  # the first pass compiles code, and makes the stored index
        for name in HEADLINE:
            start = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            (cold if warm else took)[name] = round(time.time() - start, 3)
            spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, steady state", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "sf": sf}))


if __name__ == "__main__":
    main()
