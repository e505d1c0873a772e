"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query runs twice and
writes all its rows to nowhere; ``queries`` holds the second (warm) time, ``cold``
the first. BENCH_ALL=1 times every registered query, BENCH_QUERIES=a,b only these.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evenkeel.plans import QUERIES  # noqa: E402
from evenkeel.session import local_session  # noqa: E402

HEADLINE = (
    "row_diff_orders", "row_diff_unique_keys", "cell_diff_orders", "diff_summary_orders",
    "duplicate_keys_diff_lineitem", "hot_key_diff", "keyless_diff_supplier", "bucket_checksums_orders",
    "sync_plan_orders", "apply_sync_orders", "dedupe_last_lineitem", "latest_version_events",
    "current_orders_from_changes", "join_refresh_orders_customer", "land_changes_orders",
    "validate_rows_customer", "surrogate_row_number_lineitem", "document_numbers_orders",
    "resolve_recipients_orders", "flatten_items_events", "extract_params_events", "match_records_customer",
    "split_long_text_documents",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = local_session("bench", cores=cpus, memory=memory)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else names
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")),
        "cpus": int(cpus), "memory": memory}))
    spark.stop()


if __name__ == "__main__":
    main()
