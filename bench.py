"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. ``build_panel`` reads the order
lines and writes the processed panels; the other queries start from those, as later runs of a pipeline do.
``global_forecast`` includes writing the features and fitting the model; the later queries reuse that model.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallycast.catalog.queries import QUERIES
from tallycast.catalog.workspace import Workspace
from tallycast.operators.origins import generate_origins
from tallycast.plans.backtest import FORECASTERS
from tallycast.session import local_session

HEADLINE = [
    "daily_demand", "scan_csv", "split_profile", "engineer_features", "rolling_features", "volume_segment",
    "stratified_sample_series", "seasonal_naive", "trend_weekly", "holt_winters", "backtest_results",
    "backtest_all_models", "segmented_scores", "training_panel", "training_windows", "policy_summary",
    "submission_table", "series_report", "global_forecast", "score_later_origin", "coldstart_forecast", "global_policy_summary",
    "global_backtest", "global_quantiles", "count_forecast", "holt_winters_bands", "incremental_features", "window_values",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="tallycast-bench")
    spark.sparkContext.setLogLevel("ERROR")
    ws = Workspace(spark, sf_dir)
    seconds = {"build_panel": timed(lambda: [ws.panel(grain) for grain in ("fine", "coarse")])}
    for name in HEADLINE:
        sink = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = timed(sink)
    n_series = ws.panel("fine").select("id").distinct().count()
    n_origins, n_models = len(generate_origins(ws.days()["val"])), len(FORECASTERS)
    print(json.dumps({
        "metric": "total seconds over headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "backtest_series_origins_per_sec": round(n_series * n_origins * n_models / seconds["backtest_all_models"], 1),
    }))


if __name__ == "__main__":
    main()
