"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fluxline.queries import load  # noqa: E402
from fluxline.session import get_spark  # noqa: E402

# Queries by the reference figure they stand beside, then one per subject.
HEADLINE = (
    "feature_matrix", "feature_matrix_minute", "interval_inner", "interval_flag", "interval_best",
    "asof_by_key", "asof_global", "kp_label_by_row", "driver_discovery", "model_fit", "attribution",
    "seek", "replay_progress", "session_fingerprint", "rule_flags", "session_summary",
    "mission_report", "packet_gate_report", "daily_coverage", "cadence", "magnitude_consistency",
    "hourly_report", "chain_build", "chain_verify", "alert_state", "provenance",
    "stream_rules", "stream_hourly_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    # One untimed run starts the JVM's compilers and the Python workers.
    queries["feature_matrix"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
