"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs once to
warm up and once for the clock, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "window_baseline", "trigger_moves", "trigger_scan", "alert_gate", "gated_levels", "severity_rank",
    "level_crossings", "conflict_window", "daily_series", "net_position", "align_series", "derived_metrics",
    "keyword_tags", "dedupe_first", "topk_headlines", "headline_upsert", "control_events", "spend_guard",
    "source_health", "quiet_since", "nav_median", "front_month", "landed_cost", "brief_facts", "levels_report",
    "scan_html_rows", "retention_prune",
)


def main() -> None:
    from catalog import REGISTRY
    from tidemark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    took: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
