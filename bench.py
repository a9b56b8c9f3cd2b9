"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local threads, BENCH_QUERIES a comma list of names.
"""

from __future__ import annotations

import json
import os
import time

from postingflow.plans import catalog
from postingflow.session import local_session

HEADLINE = [
    "normalize_text", "fingerprint_duplicates", "html_to_text", "work_mode", "salary", "jsonld_roundtrip", "workday_roundtrip",
    "listing_roundtrip", "links_first_per_url", "match_bulk", "merge_bulk", "merge_crawl", "bulk_summary", "crawl_pass", "expire",
    "search_filters", "search_sort_page", "search_text", "facets", "saved_searches", "favorites_add", "admission", "daily_digest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="postingflow-bench")
    table = catalog.all_queries()
    spark.read.parquet(f"{folder}/documents.parquet").count()
    timings = {}
    for name in names:
        start = time.perf_counter()
        table[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
