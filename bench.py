"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local threads,
BENCH_QUERIES optionally a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

import catalog
from catalog.registry import QUERIES
from catalog.views import lexicons
from postsift.session import local_session

HEADLINE = (
    "noise_report", "noise_filter", "clean_text", "clinical_report", "screen", "screen_and_split",
    "stratified_folds", "term_counts", "tfidf", "select_k_best", "tfidf_char", "emotion_features",
    "vad_features", "category_features", "sentiment_compound", "psych_features",
    "classification_report", "ranked_distribution",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    catalog.load()
    spark = local_session(cpus, "bench")
    lexicons(spark, sf_dir)  # input tables of the feature queries, not part of them
    QUERIES["noise_report"](spark, sf_dir).collect()  # starts the JVM's code paths
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
