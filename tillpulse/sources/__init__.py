from tillpulse.sources.records import (
    accepted,
    parse_change,
    parse_event,
    parse_order,
    parse_order_detail,
    parse_startup,
    parse_user,
    rejects,
)
from tillpulse.sources.topics import topic_source

__all__ = [
    "accepted", "parse_change", "parse_event", "parse_order", "parse_order_detail", "parse_startup", "parse_user",
    "rejects", "topic_source",
]
