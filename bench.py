"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "j1_price_sentiment_relation",
    "j2_e20_subject_impact",
    "j3_e21_source_reliability_skip",
    "j4_e23_e24_direction_summary",
    "f4_f5_lag_sweep",
    "e9_cluster_profile",
    "g1_weekly_counts_wide",
    "h7_tfidf_vectors",
    "h7_tfidf_long",
    "c3_c5_c6_c7_annotate",
    "a12_exact_sample",
    "i1_kmeans",
    "i4_silhouette",
    "i6_dbscan",
    "i9_factor_losses",
    "i18_sentiment_clusters",
    "e27_a16_summary",
    "l3_daily_stream_counts",
]


def main() -> None:
    from headwind.plans.catalog import QUERIES
    from headwind.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE", cpus if cpus.isdigit() else "8"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the session before the clock
    only = sys.argv[1:]
    seconds = {}
    for name in [n for n in HEADLINE if not only or n in only]:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
