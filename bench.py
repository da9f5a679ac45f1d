"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's result is consumed completely through the ``noop`` sink; one
warm-up pass runs first on the smallest data set. Prints one JSON line.
BENCH_QUERIES (comma list) and BENCH_RUNS (median of N) override defaults.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "web_bounce_counts", "web_page_view_map", "web_bounce_slices", "web_parse_access_log",
    "net_parse_facts", "net_interval_counts", "net_anomalies", "net_heavy_anomalies", "net_top_sources",
    "net_explain_anomalies", "net_decayed_categorize",
    "text_tokens", "text_document_frequency", "text_sentiment",
    "rec_upsert_ratings", "rec_top_items",
    "src_add_counters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from fathom.plans import QUERIES
    from fathom.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})

    def consume(name: str, sf: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for n in names:
            consume(n, warm)

    times = {}
    for n in names:
        times[n] = round(statistics.median(consume(n, sf_dir) for _ in range(runs)), 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
