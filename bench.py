"""Benchmark: headline stages at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Every query is executed in full through the ``noop`` sink (all rows and
columns produced, nothing collected); each reports the median of
``$BENCH_RUNS`` runs (default 3) after one untimed warm-up run of the same
query. Times include building the plan.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stancekit.plans import queries as Q  # noqa: E402
from stancekit.session import build_session  # noqa: E402

HEADLINE = {
    "clean_documents": "clean_text",
    "clean_split_sentences": "explode_sentences",
    "rule_classify_stats": "classification_stats",
    "evaluation_metrics": "classification_report",
}
OTHERS = [
    "combine_classify", "accuracy_f1", "confusion_matrix", "error_counts", "news_article_extract",
    "news_union", "post_search_multi", "comments_for_posts", "tweets_union_dedupe", "dedupe_first",
    "labeling_sample", "clean_pages",
]


def run(spark, name, sf_dir):
    t0 = time.perf_counter()
    Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    # Local mode runs everything in the driver JVM: give it a real heap.
    mem = os.environ.get("BENCH_DRIVER_MEMORY", "8g")
    spark = build_session("stancekit-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra_conf={"spark.driver.memory": mem})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def warm_median(name):
        run(spark, name, sf_dir)  # warm-up: JIT, generated code, file metadata
        return round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)

    for key, name in HEADLINE.items():
        times[key] = warm_median(name)
    for name in OTHERS:
        times[name] = warm_median(name)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_wall_clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
