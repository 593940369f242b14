"""Headline queries, timed end to end; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "rollup_1m", "rollup_5m", "rollup_1h", "validate_events", "ingest_outcomes", "event_search", "service_health", "event_rate_1m",
    "window_spine", "window_features", "service_features", "label_windows", "temporal_split", "trailing_buffer", "series_features",
    "threshold_sweep", "roc_auc", "pr_auc", "scenario_detection", "psi", "alert_cooldown", "alert_repeat", "context_events",
    "context_metrics", "report_context", "rule_baseline", "forest_scores", "shap_values", "histogram_quantile", "request_log_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    from vigilspark.catalog import QUERIES
    from vigilspark.session import local_session

    spark = local_session("bench", cpus)
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    QUERIES["events_by_level"](spark, sf_dir).collect()  # start-up of the session is not part of a query
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "events": n_events,
                "validated_events_per_s": round(n_events / seconds["validate_events"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
