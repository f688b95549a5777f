"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from traceworks.registry import QUERIES
from traceworks.session import build_session

HEADLINE = [
    "m01_stg_trace_events", "m02_int_request_timeline", "m03_int_session_summary", "m04_rpt_request_summary",
    "m06_rpt_sql_risk_summary", "m10_dim_ai_workspaces", "j01_star_join", "m20_request_replay",
    "m21_first_vs_corrected", "q01_column_profile", "q02_duplicate_rows", "u03_first_row_per_key",
    "c02_pii_scan_documents", "f10_mask_secrets", "f16_redact_pii", "l02_tool_performance",
    "l09_finalised_runs", "k02_budget_check", "v01_indicators", "g05_sql_audit", "g06_request_checks",
    "r03_knn_search", "n01_filing_list", "n05_chat_routing", "f45_html_text", "t01_ledger_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "traceworks-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM, the scan and the Python workers outside the timings.
    for name in ("m01_stg_trace_events", "x03_embedder"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
