from tillpulse.streaming.jobs import (
    alert_job,
    change_job,
    dau_job,
    ingest_job,
    order_job,
    reconcile_lines,
    reject_job,
    sale_job,
    start,
)
from tillpulse.streaming.progress import ProgressLog
from tillpulse.streaming.tables import (
    alert_table,
    dau_rollup,
    dau_table,
    device_table,
    minute_table,
    order_rollup,
    order_table,
    pane_table,
    sale_table,
    unmatched_table,
    user_table,
)
from tillpulse.streaming.transforms import (
    coupon_panes_stream,
    first_seen_stream,
    first_startup_stream,
    join_order_detail_stream,
)

__all__ = [
    "ProgressLog", "alert_job", "alert_table", "change_job", "coupon_panes_stream", "dau_job", "dau_rollup", "dau_table", "device_table", "first_seen_stream",
    "first_startup_stream", "ingest_job", "join_order_detail_stream", "minute_table", "order_job", "order_rollup", "order_table", "pane_table",
    "reconcile_lines", "reject_job", "sale_job", "sale_table", "start", "unmatched_table", "user_table",
]
