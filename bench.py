"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local threads, BENCH_QUERIES an
optional comma list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tablewake.plans.registry import QUERIES
from tablewake.sources.scratch import clear

HEADLINE = (
    "audit_findings",
    "audit_records",
    "parse_deletions",
    "has_dependents",
    "direct_dependents",
    "dependents_closure",
    "blast_radius",
    "all_tables_blast_radius",
    "format_dependents",
    "lineage_dag",
    "dag_arrows",
    "join_diagram",
    "merge_arrow_jobs",
    "table_readers_writers",
    "search_columns",
    "normalize_jobs",
    "job_cache_key",
    "stale_jobs",
    "validate_extraction",
    "sync_edges",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH", "/tmp/tablewake-bench"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    # The first query must not carry the start of the engine.
    QUERIES[names[0]](spark, sf_dir).limit(1).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        # Every row and column is computed; nothing is brought to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
