"""Benchmark: one JSON line with seconds per headline query.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
After a short warm-up of the session every query runs once unmeasured and then
three times; its median counts.  Results are written to the ``noop`` sink, so
every row and column is computed.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cardloom.catalogue import registry  # noqa: E402
from cardloom.session import local_session  # noqa: E402

HEADLINE = (
    "hybrid_topk",
    "vector_topk_text",
    "lexical_topk",
    "vector_topk_dense",
    "vector_table",
    "token_counts",
    "denoise_stats",
    "chapter_split",
    "chunk_documents",
    "dedup_renumber",
    "upsert_cards",
    "validate_json",
    "progress_curve",
    "daily_rollup",
    "review_boxes",
    "review_stats",
    "chat_context",
    "session_list",
    "recall_by_tag",
    "time_anchors",
    "method_prompts",
    "extracted_cards",
)

RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.range(1000).repartition(8).mapInPandas(lambda frames: frames, "id bigint").count()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
