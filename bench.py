"""Headline queries over one data folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalogue import QUERIES  # noqa: E402
from pacelake.session import build_session  # noqa: E402

HEADLINE = [
    "a1_workouts_per_month", "a3_distance_by_year_month", "a6_speed_trend", "a8_day_sport_table", "a11_describe",
    "a13_correlation", "a16_compare_with_history", "p30_display_table", "p31_elapsed", "w1_one_row_per_day",
    "w3_last_sessions", "w6_row_positions", "j3_merge_history", "j5_training_windows_20", "j5_training_windows_60",
    "j5_training_windows_asof", "j6_window_for_date", "j7_windows_for_last_days", "s12_record_messages",
    "f3_neighbour_imputation", "f7_robust_scale", "f9_one_hot", "f12_history_encoder", "f13_session_encoder",
    "m10_m12_compare_for_last_days_plain",
]

LEARNERS = ["m1_training_matrix", "m10_predict_for_last_days"]
"""Timed apart from the total: training with its matrix, and a prediction by the trained model."""


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "pacelake-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the engine
    seconds = {}
    for name in HEADLINE + LEARNERS:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds[name] for name in HEADLINE), 3), "unit": "sec",
        "queries": {name: seconds[name] for name in HEADLINE}, "learners": {name: seconds[name] for name in LEARNERS}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
