"""Time the headline queries at one scale factor and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 1),
BENCH_QUERIES (comma-separated names; default the headline set below).
Each query runs to completion through the ``noop`` sink (full execution, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staylens.plans.registry import load_all  # noqa: E402
from staylens.session import local_session  # noqa: E402

HEADLINE = [
    "i1_price_anomalies", "i2_value_gems", "i3_market_gaps", "i4_price_correlations", "i5_scarce_expensive",
    "i6_discovery", "a1_summary_report", "a6_top_district_boxes", "a12_price_distribution",
    "a14_district_comparison", "c10_clean_listings", "f7_price_category", "j1_profile_external",
    "j5_merge_external", "r2_review_polarity", "r8_language_tags", "v7_top_k_search", "v11_batch_search",
    "t1_daily_price_series", "t3_forecast", "g3_kmeans_segments", "g9_grid_rollup", "h5_audit_conversations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    reg = load_all()
    names = [n for n in (os.environ.get("BENCH_QUERIES") or ",".join(HEADLINE)).split(",") if n in reg]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="staylens-bench")
    # Warm-up: JVM, code generation and the parquet footers of the shared role tables.
    reg["a19_room_type_counts"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))


if __name__ == "__main__":
    main()
