"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.catalog import QUERIES, Tables  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

HEADLINE = (
    "p1_mask_pii", "a6_run_suite", "c10_exit_report", "a8_decide", "a9_compliance_report", "g8_last_decisions",
    "a11_lineage_audit_report", "g12_verify_integrity", "a12_combined_audit_report", "g1_lineage_chains",
    "g2_sigma_trend", "g3_sigma_monitor", "a13_quality_certificate", "j2_sla_breaches", "a27_flow_status",
    "q1_top_regions", "q2_flows_below", "q3_daily_revenue", "q6_top_products", "q7_quality_rollup",
    "a19_dedup_content", "j8_resolve_needs", "a21_catalogue_status", "q11_classify_batch", "u1_governance_timeline",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "headline queries, median of 3 warm runs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
