"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, BENCH_RUNS the timed runs
per query (the best one counts; one untimed run comes first).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.plans import QUERIES
from tallyloom.session import local_session

HEADLINE = (
    "experiment_k3",
    "vote_ahead_by_5",
    "response_flags",
    "land_texts",
    "clause_tasks",
    "text_windows",
    "images_with_captions",
    "nearest_collection",
    "linked_annotations",
    "resolved_versions",
    "sync_uploads",
    "last_metric_values",
    "best_checkpoints",
    "early_stops",
    "run_notes",
    "bleu_summary",
    "rouge_summary",
    "classification_report",
    "roc_auc",
    "latency_percentiles",
    "describe_prices",
    "value_histogram",
    "duplicate_texts",
    "prompt_similarities",
    "zero_shot_classes",
    "online_votes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, app="bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
