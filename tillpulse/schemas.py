"""Record shapes. JSON records are read with every field as text and cast afterwards,
because producers send numbers both quoted and bare."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the incoming records.
STARTUP_FIELDS = ["mid", "uid", "appid", "area", "os", "ch", "type", "vs", "ts"]
EVENT_FIELDS = ["mid", "uid", "appid", "area", "os", "ch", "type", "evid", "pgid", "npgid", "itemid", "ts"]
ORDER_FIELDS = [
    "id", "province_id", "consignee", "order_comment", "consignee_tel", "order_status", "payment_way",
    "user_id", "img_url", "total_amount", "expire_time", "delivery_address", "create_time", "operate_time",
    "tracking_no", "parent_order_id", "out_trade_no", "trade_body",
]
ORDER_DETAIL_FIELDS = ["id", "order_id", "sku_name", "sku_id", "order_price", "img_url", "sku_num"]
USER_FIELDS = ["id", "login_name", "user_level", "birthday", "gender"]

# Columns of a sale detail, one row per order line.
SALE_DETAIL_FIELDS = [
    "order_detail_id", "order_id", "order_status", "create_time", "user_id", "sku_id",
    "user_gender", "user_age", "user_level", "sku_price", "sku_name", "dt",
]

MONEY = T.DecimalType(18, 2)

# One database change: the rows of an entry, each a list of (column, value) pairs.
CDC_SCHEMA = (
    "entry_type string, event_type string, table_name string, "
    "rows array<array<struct<name: string, value: string>>>"
)

# Keyed tables written by the streaming jobs.
DAU_TABLE = (
    "mid string, uid string, appid string, area string, os string, ch string, log_type string, vs string, "
    "log_hour string, ts bigint, log_date date"
)
DEVICE_TABLE = "mid string, first_day date, moved boolean"
ORDER_TABLE = (
    "id string, province_id string, consignee string, order_comment string, consignee_tel string, "
    "order_status string, payment_way string, user_id string, img_url string, total_amount decimal(18,2), "
    "expire_time string, delivery_address string, create_time string, operate_time string, tracking_no string, "
    "parent_order_id string, out_trade_no string, trade_body string, create_hour string, create_date date, "
    "arrival_ts timestamp"
)
USER_TABLE = "id string, login_name string, user_level string, birthday date, gender string, arrival_ts timestamp"
SALE_TABLE = (
    "order_detail_id string, order_id string, order_status string, create_time string, user_id string, "
    "sku_id string, user_gender string, user_age int, user_level string, sku_price double, sku_name string, dt date, "
    "arrival_ts timestamp, order_arrival_ts timestamp"
)
UNMATCHED_TABLE = (
    "order_detail_id string, order_id string, sku_id string, sku_name string, sku_price double, arrival_ts timestamp"
)
PANE_TABLE = "mid string, pane bigint, evid string, uid string, itemid string, n bigint"
ALERT_TABLE = (
    "mid string, window_end timestamp, uids array<string>, item_ids array<string>, "
    "events array<struct<evid: string, n: bigint>>, suppressed boolean, day date"
)
MINUTE_TABLE = (
    "alert_id string, mid string, window_end timestamp, uids array<string>, item_ids array<string>, "
    "events array<struct<evid: string, n: bigint>>, suppressed boolean, day date"
)


def text_struct(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in fields])
