"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES
(comma separated) replaces the list of queries.  Results are fully computed and
thrown away; a small warm-up on one query keeps JVM start-up out of the figures.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "acs_sample", "max_cover", "max_cover_unlabelled", "sequential_cap", "mutual_cap",
    "cosine_edges", "label_edges", "duplicate_cover", "random_sample", "random_sample_events",
    "stratified_sample", "stratified_sample_events", "group_sample", "score_sample",
    "holdout_stratified", "classification_report", "entity_scores", "array_scores",
    "csv_source", "relation_source", "bio_token_source", "batch_predictions",
    "few_shot_prompts", "embedded_tfidf", "train_and_report",
]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_DIR") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "label_edges", folder)
    times = {}
    for name in names:
        times[name] = round(run(spark, name, folder), 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total wall-clock of headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
