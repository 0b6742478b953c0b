"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the number of
threads, BENCH_QUERIES a comma-separated subset or ``all``, BENCH_RUNS the warm runs per
query, of which the median counts. Every result is computed whole and written to the no-op
sink, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

HEADLINE = (
    "vector_topk_exact",
    "vector_topk_filtered",
    "vector_self_neighbours",
    "ann_topk",
    "keyframe_build",
    "rrf_three_lane",
    "maxsim_late_interaction",
    "task_scores",
    "score_rollup_by_type",
    "latency_percentiles",
    "text_normalize_dedup",
    "heldout_anti_join",
    "text_profile_by_lang",
    "strip_diacritics",
    "noise_mixed_ocr",
    "corpus_pairs",
    "pseudo_embed",
    "degradation_at_k",
    "upsert_last_wins",
    "profile_sizes",
)


def main() -> None:
    from lanefold import plans
    from lanefold.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = plans.known() if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            plans.resolve(name)(spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(took[1:] or took), 3)
        print(f"{name}: {took[0]:.2f} cold, {seconds[name]:.2f} warm", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
