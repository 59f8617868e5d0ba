"""Wall time of the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite.queries import QUERIES  # noqa: E402

HEADLINE = [
    "scan_documents",
    "scan_pages",
    "scan_page_links_dev",
    "scan_customer_text",
    "scan_customer_text_prod",
    "scan_order_text",
    "union_sources",
    "chunked_scan",
    "same_span_winner",
    "same_span_winner_in_row",
    "scan_status",
    "category_profile",
    "column_value_pii",
    "flagged_columns",
    "column_samples",
    "detection_catalog",
    "findings_sorted_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus.strip("*") or "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    chars = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first()["n"]
    run("scan_documents")  # warm-up of the JVM
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    result = {
        "metric": "headline queries, sum of the better of two runs",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(found.group(1)) if found else sf_dir,
        "documents_mb_per_sec": round(chars / 1e6 / times["scan_documents"], 1),
        "cpus": cpus,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
