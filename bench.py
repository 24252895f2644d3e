"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time

from scarpline.queries import queries
from scarpline.session import session

HEADLINE = [
    "null_threshold_sweep", "optimal_dataset", "numeric_profile", "class_medians",
    "class_box_stats", "rolling_event_stats", "fill_missing_weather", "centered_rolling",
    "climate_enrich", "scenario_expand", "stability_transitions", "soil_outer_chain", "soil_semi",
    "soil_enrich", "weighted_group_mean", "terrain_stencil", "terrain_enrich", "crop_window",
    "rank_both_datasets", "consensus_rank", "stratified_folds", "contiguous_folds",
    "weighted_f1", "ridge_weights", "discriminant_weights", "model_gradient_boosting",
    "model_adaptive_boosting", "evaluate_models_closed", "select_features_closed", "drop_importance_closed",
    "stability_model_closed", "collect_all", "climate_workflow", "select_features", "drop_importance",
    "model_random_forest", "evaluate_models", "complete_analysis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
    })
    registered = queries()
    # One small run starts the JVM's code paths, so that the first query is not charged for them.
    registered["null_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        # A line after every query: whoever stops the run keeps the figures so far.
        print(json.dumps({
            "metric": "headline_queries_total",
            "value": round(sum(times.values()), 3),
            "unit": "sec",
            "queries": times,
            "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        }), file=sys.stdout if len(times) == len(chosen) else sys.stderr, flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
