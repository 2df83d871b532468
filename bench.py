"""Benchmark the headline plans.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each plan is executed in full with the ``noop`` sink (every row computed,
nothing collected) and timed; one JSON line is printed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from promptspark.plans import queries  # noqa: E402
from promptspark.session import get_spark  # noqa: E402

HEADLINE = [
    "library_summary", "token_histogram", "top_expensive", "exact_duplicates", "prompt_cost",
    "model_compare", "role_breakdown", "strip_markup", "sentences", "sentence_scores",
    "pattern_candidates", "extractive_compress", "quality", "incremental_rollup", "doc_expand",
    "request_summary", "latency_percentiles", "judge_parse", "vector_cosine", "semantic_scores",
    "benchmark_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = get_spark()
    qs = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
