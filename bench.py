"""Seconds per headline query: one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. A few queries warm the
JVM up, then each query runs once; results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from linegrain.plans import QUERIES_AND_ORACLES
from linegrain.session import build_session

HEADLINE = [
    "fn_canonical_sequence", "src_collect_observations", "norm_flags", "norm_canonical_lines",
    "norm_line_ids", "val_summary_gate", "merge_upsert", "freq_unigram", "freq_trigram",
    "prefix_patterns", "seq_types", "seq_similarity_join", "seq_clusters", "seq_templates",
    "structural_metrics", "lm_trigram", "cv_leave_one_group_out", "cv_kfold",
    "cv_attribute_holdout", "model_combined_winner", "pert_relabel_per_line",
    "pert_scoreboard_insample", "pert_scoreboard", "artifact_metadata", "anchor_support",
    "volume_totals_share", "run_delta_metrics",
]
WARM_UP = ["fn_canonical_sequence", "freq_bigram", "seq_types", "lm_unigram"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("linegrain-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = QUERIES_AND_ORACLES()[0]
    seconds: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in WARM_UP:
        run(name)
    for name in names:
        seconds[name] = round(run(name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
