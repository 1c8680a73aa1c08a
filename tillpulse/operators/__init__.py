from tillpulse.operators.alerts import (
    alert_documents,
    alerts_per_minute,
    coupon_alerts,
    coupon_alerts_per_minute,
    event_list,
    pane_counts,
)
from tillpulse.operators.devices import (
    dau_by_hour,
    dau_total,
    device_totals,
    exclude_seen,
    first_day_changes,
    first_startup,
    new_devices,
    new_devices_known,
    observed,
    roster,
)
from tillpulse.operators.ingest import changed_rows, route_cdc, route_logs, stamp_ingest
from tillpulse.operators.latest import apply_changes, latest_rows
from tillpulse.operators.orders import (
    order_amount_by_hour,
    order_amount_total,
    order_clean,
    sales_by_province,
)
from tillpulse.operators.sales import enrich_user, join_order_detail, late_sales, latest_users, match_lines, waiting_lines, with_buyer

__all__ = [
    "alert_documents", "alerts_per_minute", "apply_changes", "changed_rows", "coupon_alerts", "coupon_alerts_per_minute", "dau_by_hour", "dau_total", "device_totals",
    "enrich_user", "event_list", "exclude_seen", "first_day_changes", "first_startup", "join_order_detail", "late_sales", "latest_rows", "latest_users", "match_lines",
    "new_devices", "new_devices_known", "observed", "order_amount_by_hour", "order_amount_total", "order_clean", "pane_counts",
    "roster", "route_cdc", "route_logs", "sales_by_province", "stamp_ingest", "waiting_lines", "with_buyer",
]
