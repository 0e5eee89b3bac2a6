"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import QUERIES  # noqa: E402
from tidewatch.session import build_session  # noqa: E402
from tidewatch.sources.tables import forget  # noqa: E402

HEADLINE = (
    "bars_daily",
    "bars_hourly",
    "series_index",
    "sliding_windows",
    "history_expand",
    "origin_tail",
    "fc_all_baselines",
    "baselines_scoreboard",
    "dm_test_h3",
    "protocol_full_series",
    "protocol_walk_forward",
    "component_linear_forecast",
    "comparison_table",
    "leakage_summary",
    "diag_correlation",
    "diag_skill",
    "window_alignment",
    "patch_odd_rows",
    "dataset_check",
    "recover_index",
    "linear_envelope",
    "sift_decompose",
    "ngram_overlap",
    "key_integrity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["bars_daily"](spark, folder).write.format("noop").mode("overwrite").save()  # start the executors
    seconds = {}
    for name in names:
        forget(spark)  # every query pays for what it needs
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
