"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: the tables (default sf0.1). BENCH_CPUS: local cores. BENCH_RUNS: warm runs per query (median is kept).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postmill.plans import registry, search_queries  # noqa: E402
from postmill.session import build_session  # noqa: E402

HEADLINE = [
    "browse",
    "browse_filtered",
    "location_facets",
    "job_details_lookup",
    "search_relevance",
    "search_recency",
    "text_match_score",
    "knn",
    "inverted_index",
    "upsert_jobs",
    "carry_forward_details",
    "consistency_counts",
    "interleave_requests",
    "run_state",
    "classify_title",
    "extract_skills",
    "extract_pay_ranges",
    "html_to_text",
    "normalize_locations",
    "parse_amazon",
    "benchmark_summary",
    "exact_percentiles",
    "task_state_summary",
    "lease_state",
    "heartbeat_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench", cpus, spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # Start the JVM's and the Python workers' code paths once, so the first query is not charged for them.
    for name in ("classify_title", "html_to_text"):
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    # The index is written once per run; search requests then read it.
    began = time.perf_counter()
    search_queries.index(spark, sf)
    seconds["write_search_index"] = round(time.perf_counter() - began, 3)
    for name in names:
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
