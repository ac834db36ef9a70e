"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftline.plans import catalog  # noqa: E402
from siftline.session import build_session  # noqa: E402
from siftline.sources import views  # noqa: E402

# Stages of the pipeline: ingest and clean, de-duplicate, split, text and tabular features,
# scoring, evaluation, review. Each writes its whole result.
HEADLINE = (
    "clean_text",
    "dedup_key",
    "stratified_split",
    "tabular_features",
    "ngrams",
    "vocabulary",
    "tfidf_weights",
    "score_batch",
    "contributions",
    "slice_metrics",
    "metrics_summary",
    "score_cumulative_events",
    "apply_feedback",
    "queue_gray",
    "latency_summary",
    "token_frequency",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    width = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": width,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    documents = views.table(spark, folder, "documents").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("score_batch")  # the JVM warms up outside the clock
    times = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "documents": documents,
                "score_rows_per_sec": round(documents / times["score_batch"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
