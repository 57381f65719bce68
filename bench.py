"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from screenlake.plans.catalog import QUERIES  # noqa: E402
from screenlake.session import local_session  # noqa: E402

HEADLINE = [
    "iou_join", "match_greedy_gt", "match_greedy_global", "detection_metrics", "benchmark_summary", "annotation_diff", "union_area", "fuse_candidates",
    "tightest_parent", "structure_findings", "rule_calibration", "validate_annotations", "assign_splits", "priority_queue", "group_lines_fold",
    "reconstruct_table", "extract_item_entities", "semantic_groups", "near_duplicate_text", "key_topics", "page_type", "container_constraints",
    "infer_components", "palette_roles", "parse_model_output", "latency_profile", "cache_hits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
        spark.sparkContext.setLogLevel("ERROR")
        # warm the JVM and the file cache; not timed
        QUERIES["coverage_capped"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times: dict[str, float] = {}
        for name in only:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
        spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
