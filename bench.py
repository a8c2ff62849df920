"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from korpusmill.plans.queries import QUERIES

HEADLINE = [
    "corpus_filter_dedupe", "stratified_split", "query_sets", "chunk_300_100", "chunk_counts_by_config", "dense_topk", "dense_doc_rank", "sparse_topk", "hybrid_rrf",
    "eval_dense", "eval_methods", "positive_chunk", "hard_negatives", "training_triples", "latency_percentiles", "verbatim_truth",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}").config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "1m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
