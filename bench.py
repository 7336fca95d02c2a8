"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (optional) a comma-separated choice.
The tables are first laid out as several files each, as any large table is: the given ones are one row group, hence one
task.  Then every query is executed in full into Spark's no-op sink, once, after a small warm-up of the session.

Queries that train a forest are timed apart, on the tables of ``BENCH_TRAIN_DIR`` (default: sf0.01 beside the others), and
are not in the total; so is the scoring of 100 clauses by a stored model.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pactlens.functions import rules
from pactlens.operators import dataset, forest
from pactlens.plans import catalog
from pactlens.plans.views import view
from pactlens.session import local_session, scratch_path

TABLES = ["lineitem", "documents", "pages", "embeddings", "benchmark"]
HEADLINE = [
    "f1_label_counts",
    "f2_base_labels",
    "c8_contract_gate",
    "b1_clean_text",
    "b1_clean_documents",
    "b17_tokens",
    "e2_contract_lines",
    "e5_contract_clauses",
    "e6_latin_sentences",
    "e7_contract_samples",
    "e8_interleave",
    "e9_train_test",
    "h1_merge_statistics",
    "h9_report_averages",
    "h12_risk_summary",
    "i2_knowledge",
    "i2_retrieval",
    "j1_vocabulary",
    "j1_tfidf",
    "j1_vectors",
    "j6_risk_report",
    "j7_stream_labels",
]
TRAINED = ["j2_forest", "j3_cross_validation", "j4_batch_scoring", "j5_file_scoring"]


def training_times(spark, queries, train_dir: str) -> dict:
    """Seconds of the queries that train, and of scoring 100 clauses with a model from its store."""
    seconds = {}
    for name in TRAINED:
        start = time.perf_counter()
        queries[name](spark, train_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clauses = view(spark, train_dir, "clause_src").select("id", "text")
    path = scratch_path(spark, "bench-model")
    rows = dataset.valid_rows(clauses.withColumn("label", rules.strict_label(clauses["text"])))
    forest.save_model(forest.train(rows, trees=10, depth=8), path)
    start = time.perf_counter()
    forest.score_clauses(clauses.limit(100), forest.load_model(path)).write.format("noop").mode("overwrite").save()
    return {"queries": seconds, "seconds_for_100_clauses": round(time.perf_counter() - start, 3), "dir": train_dir}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, partitions=max(8, int(cores) if cores.isdigit() else 8), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    laid_out = tempfile.mkdtemp(prefix="bench-")
    for table in TABLES:
        given = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        given.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{laid_out}/{table}.parquet")
    queries["h2_fetch_summary"](spark, laid_out).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clauses = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    train_dir = os.environ.get("BENCH_TRAIN_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.01"))
    trained = training_times(spark, queries, train_dir) if os.path.isdir(train_dir) and names == HEADLINE else None
    rates = {n: round(clauses / seconds[n]) for n in ("f1_label_counts", "c8_contract_gate", "j7_stream_labels") if n in seconds}
    found = re.search(r"sf([\d.]+)$", sf_dir)
    print(json.dumps({
        "metric": "clause_risk_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "clauses_per_second": rates,
        "training": trained,
        "sf": float(found.group(1)) if found else sf_dir,
        "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
