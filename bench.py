"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8). Every query is fully executed with the ``noop`` sink (the
whole plan runs, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ndjson_scan", "first_error", "typed_documents", "text_postings", "term_dictionary",
    "write_index", "bm25_topk", "fetch_stored", "version_state_fold", "ready_transition",
    "resolve_versions", "artifact_manifest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from lexidx.plans import registry
    from lexidx.session import build_session
    spark = build_session(f"local[{cpus}]", "lexidx-bench", shuffle_partitions=max(cpus, 8))
    # Untimed warm-up (JVM start, class loading, JIT) on the smallest scale.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("ndjson_scan", "typed_documents", "ready_transition"):
            registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    timings = {}  # write_index publishes the version that the lookups after it read
    for name in HEADLINE:
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
