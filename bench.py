"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line. Each query is fully executed into the ``noop``
sink (no driver collect), timed after one warm-up of the JVM."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from starlens.plans.registry import QUERIES  # noqa: E402
from starlens.session import get_spark  # noqa: E402

HEADLINE = [
    "g2_top_and_worst",        # flagship: join + aggregate + top-k/worst per cluster
    "f8_cluster_kpis",         # dashboard KPIs
    "f11_cluster_sentiment",   # pivot
    "b9_clean_reviews",        # cleaning chain
    "c3_lexicon_polarity",     # explode + broadcast join + aggregate
    "c8_sample_weight",        # full audit table with weights
    "f14_classification_metrics",
    "f16_roc_auc",             # distributed prefix sums
    "i1_stratified_split",
    "j3_tfidf",                # largest shuffle: (doc, term)
    "g5_longest_reviews",
    "k2_cluster_context",
    "b12_near_dedup",
    "b10_strip_markup",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g")})
    names = [q for q in HEADLINE if q in QUERIES]
    # warm-up: JIT, parquet footers, python workers
    QUERIES["f1_value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else None,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
