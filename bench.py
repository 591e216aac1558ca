"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every query
is planned and run to its last row (no-op sink) once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from procura.plans import catalogue

HEADLINE = (
    "match_assign",
    "match_tiers",
    "folder_review",
    "normalize_tokens",
    "page_links",
    "link_outcome",
    "parse_responses",
    "stub_results",
    "deadline_queue",
    "report_months",
    "report_upsert",
    "tag_summary",
    "order_manifest",
    "archive_members",
    "text_samples",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("procura-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).repartition(8).count()  # start the session, not a query
    chosen = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        result = catalogue.QUERIES[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
