"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of warm medians in seconds."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "phone_staged", "phone_classify", "phone_conf_summary", "coverage_strict", "conflict_summary", "null_impact", "source_pairings",
    "name_norm_compare", "name_tier1_summary", "name_subtags", "name_structure", "name_staircase_full", "name_staircase_scale",
    "pair_up", "golden_summary", "compound_scan", "majority_vote", "confusion_matrix", "hash_sample_names", "event_label_counts",
]


def main() -> None:
    from tallyframe.plans import registry
    from tallyframe.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = {}, lambda f: (time.perf_counter(), f.write.format("noop").mode("overwrite").save(), time.perf_counter())
    for name in HEADLINE:
        times = []
        for _ in range(4):
            start, _, end = took(registry.QUERIES[name](spark, sf))
            times.append(end - start)
        queries[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total warm seconds of the headline queries", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
