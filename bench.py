"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the test tables; BENCH_CPUS: local threads.
Results go to the ``noop`` sink, so every row is computed and none is kept.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from workload.registry import QUERIES

HEADLINE = (
    "best_prices", "store_stats", "cheapest_by_category", "cheapest_by_store", "top_cheapest",
    "active_promotions", "all_promotions", "price_history", "compare_stores", "global_stats",
    "unmapped_categories", "mapped_categories", "mapping_stats", "category_counts",
    "category_resolved", "category_mapped_texts", "product_lookup", "product_lookup_brand",
    "store_upsert", "cascade_delete", "fk_violations", "export_prices",
    "duplicate_groups", "duplicate_links", "duplicate_members", "merge_products", "merge_transfer",
    "merge_stats", "parse_answers", "validate_answers", "expand_alternatives",
    "normalize_name", "flyer_top3", "ingest_stats", "ingest_prices", "ingest_incremental",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gondola-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("count(*)").collect()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
