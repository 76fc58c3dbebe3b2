"""Time the headline queries: one JSON line, seconds per query (best of three runs, all rows produced).

Folder from BENCH_SF_DIR, cores from BENCH_CPUS. ``q5_stockouts`` reads the same number of sale lines as the
published stock-out timings; ``q5_stockouts_calendar`` is the calendar method on the same rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfline.plans.catalog import QUERIES  # noqa: E402
from shelfline.session import build_session  # noqa: E402

HEADLINE = [
    "q1_comp_sales", "q2_sqm_productivity", "q3_cohort_retention", "q4_gmroi", "q5_stockouts",
    "q5_stockouts_calendar", "q6_promo_uplift", "audit_header_vs_lines", "audit_uniqueness", "audit_sales_gaps",
    "audit_findings", "p1_weekly_gmv", "p2_pareto", "p3_cohort_matrix", "p4_low_rotation", "p5_payment_mix",
    "ab_ci", "fact_sales", "dim_customer", "gmv_reconciliation", "kpi1_comp_growth", "kpi8_oos_rate",
    "kpi9_store_score", "kpi_checks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "runs": 3,
        "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
