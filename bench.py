"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Every query writes its whole
result to the no-op sink, once to warm up and then ``BENCH_RUNS`` times; the best run counts. Streams run once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tillpulse.queries import all_queries
from tillpulse.session import local_session

HEADLINE = [
    "first_startup", "exclude_seen", "dau_total", "dau_by_hour", "new_devices", "dau_hourly_compare",
    "order_clean", "order_amount_total", "order_amount_by_hour", "order_hourly_compare", "sales_by_province",
    "kpi_tiles", "sale_detail", "sale_detail_enriched", "latest_users", "sale_search_page", "sale_gender_facet",
    "sale_age_facet", "sale_search_document", "coupon_alerts", "coupon_alerts_per_minute", "stamp_ingest",
    "route_logs", "route_cdc", "parse_order_json", "parse_event_json",
]
# Jobs that write tables; each run starts with fresh ones.
STREAMS = [
    "stream_first_startup", "stream_first_seen", "stream_orders", "stream_order_changes", "stream_alerts_per_minute",
    "stream_sale_detail", "upsert_users", "upsert_restart",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE + STREAMS
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    known = all_queries()  # those over the shop tables; the corpus queries have the check tool
    seconds = {}
    for name in chosen:
        if name not in STREAMS:
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
        best = float("inf")
        for _ in range(1 if name in STREAMS else runs):
            started = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        # Streams are listed, not added: the total stays comparable between rounds.
        "value": round(sum(s for name, s in seconds.items() if name not in STREAMS), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
