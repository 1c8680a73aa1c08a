from tillpulse.functions.scalars import (
    age_bucket,
    age_years,
    mask_phone,
    match_all_terms,
    on_date,
    previous_day,
    to_money,
    trunc_pct,
    with_alert_id,
    with_create_time,
    with_log_time,
)

__all__ = [
    "age_bucket", "age_years", "mask_phone", "match_all_terms", "on_date", "previous_day",
    "to_money", "trunc_pct", "with_alert_id", "with_create_time", "with_log_time",
]
