"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "timeline_with_findings",  # raw intervals -> clean timeline -> QA -> counts
    "clean_timeline",
    "tile_spans",  # signals -> energy -> bursts -> typed spans
    "segment_facts",
    "build_track",
    "run_qa",
    "contact_crosscheck",
    "frames_in_segments",
    "nearest_frame",
    "align_by_midpoint",
    "greedy_match",
    "boundary_scores",
    "consensus",
    "fuzzy_merge",
    "motion_energy",
    "run_length_merge",
    "verdict_classes",
    "object_tokens",
    "non_maximum_suppression",
    "annotate_votes",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from clipweave import catalog
    from clipweave.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalog.SPARK["build_track"](spark, sf).write.format("noop").mode("overwrite").save()  # warm JVM and workers
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            catalog.SPARK[name](spark, sf).write.format("noop").mode("overwrite").save()
            sec = time.perf_counter() - t
            best = sec if best is None else min(best, sec)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
