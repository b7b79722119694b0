"""Time the headline queries: one JSON line. Each query runs once to warm up and then ``BENCH_RUNS`` times; the best counts."""

from __future__ import annotations

import json
import os
import sys
import time

from checks import registry
from postwatch import session

HEADLINE = [
    "daily_digest", "digest_outbox", "unsent_candidates", "overlap_scores", "score_filter", "top_per_search", "profiles",
    "postings_scan", "scores_scan", "users_after_requests", "users_upsert", "changes_valid", "outcome_counts",
    "page_triage", "crawl_results", "queue_remaining",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session.local_session(cpus, int(cpus))
    built = registry.all_queries()
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for attempt in range(repeats + 1):
            began = time.perf_counter()
            built[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if attempt and (best is None or took < best):
                best = took
        seconds[name] = round(best, 3)
    spark.stop()
    report = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds}
    print(json.dumps(report | {"sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
