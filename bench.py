"""Benchmark: run the headline queries at $BENCH_SF_DIR (default sf0.1) on
local[$BENCH_CPUS] and print ONE JSON line with per-query seconds.

Each query is fully executed with the ``noop`` sink (every row computed, nothing
collected to the driver). A first pass over the same queries gives the ``cold`` times (with JIT and
class loading); ``queries`` and ``value`` are the second pass. ``extra`` holds queries outside the
headline total: a whole ingest run (six tables written, masters merged) and the warehouse build.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q1_overview_stats", "q2_chart_data_daily", "q2_chart_data_hourly", "q3_location_stats",
    "q4_purchase_tasks", "q5_cart_abandonment_tasks", "q6_search_analysis_tasks", "q7_repeat_visit_tasks",
    "q8_performance_bounced_sessions", "q9_performance_bounced_pages", "q10_performance_facets",
    "q11_user_history", "q12_session_history", "q13_locations_list", "q14_data_availability",
    "q15_ingestion_jobs_page", "q16_email_jobs_page", "q17_email_history_page", "q19_stuck_jobs",
    "q20_branch_mappings_list", "i8_extract_all_event_types", "r1_branch_report_summary",
]

EXTRA = ["ingest_run", "l2_deep_page", "r2_purchase_rollup"]


def timed(fn, spark, sf_dir: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from sessionscope.registry import QUERIES
    from sessionscope.session import build_session

    spark = build_session(f"local[{cpus}]", app="sessionscope-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    from sessionscope.sources.fixtures import PURCHASED, build_warehouse, load_tables
    times: dict[str, float] = {}
    # The warehouse build is the ingest step (derive + write the partitioned event
    # tables once); it is timed on its own line.
    from sessionscope.session import path_exists
    from sessionscope.sources.fixtures import warehouse_path
    reused = path_exists(spark, os.path.join(warehouse_path(spark, sf_dir), PURCHASED))
    t0 = time.perf_counter()
    build_warehouse(load_tables(spark, sf_dir))
    times["warehouse_build"] = round(time.perf_counter() - t0, 3)
    cold = {key: timed(QUERIES[key][0], spark, sf_dir) for key in (only or HEADLINE)}
    for key in (only or HEADLINE):
        times[key] = timed(QUERIES[key][0], spark, sf_dir)
    extra = {} if only else {key: timed(QUERIES[key][0], spark, sf_dir) for key in EXTRA}
    sf = os.path.basename(sf_dir).replace("sf", "")
    query_total = sum(v for k, v in times.items() if k != "warehouse_build")
    print(json.dumps({"metric": "headline_queries_total", "value": round(query_total, 3), "unit": "sec",
                      "queries": times, "cold": cold, "cold_total": round(sum(cold.values()), 3), "extra": extra, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "spark": spark.version, "warehouse_reused": reused}))
    spark.stop()


if __name__ == "__main__":
    main()
