"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs to a sink that takes every row and keeps none.  Names on the command line choose
queries; ``all`` runs every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from corpusloom.plans.registry import QUERIES

HEADLINE = [
    "pretokenize",
    "pretoken_histogram",
    "byte_encode",
    "bpe_train",
    "encode_docs",
    "decode_docs",
    "token_offsets",
    "stream_batches",
    "bos_pack_plan",
    "packed_sequences",
    "token_shard_batches",
    "render_conversation",
    "completion_prompts",
    "token_nll",
    "bits_per_byte",
    "debiased_ema",
    "running_best",
    "extract_metrics",
    "summary_pivot",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.corpusloom.inputPartitions", cpus)  # the bench tables are single row groups
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = list(QUERIES) if names == ["all"] else names or HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
