"""Stamping and routing of incoming logs and database changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillpulse.functions.scalars import one_json_value
from tillpulse.sources import topics

# Source tables of the three business topics.
CDC_TOPICS = {
    "order_info": topics.ORDER_TOPIC,
    "user_info": topics.USER_TOPIC,
    "order_detail": topics.ORDER_DETAIL_TOPIC,
}


def stamp_ingest(df: DataFrame, ts_ms: Column | None = None) -> DataFrame:
    """Set the top-level ``ts`` of every JSON record to the server time in milliseconds.

    Fields keep their JSON types. For a replay pass the recorded arrival time. Text that is not one
    JSON object (also with a key twice, or more text behind it) stays as it is, for the parsers to reject.
    """
    now = F.unix_millis(F.current_timestamp()) if ts_ms is None else ts_ms
    stamp = F.create_map(F.lit("ts"), F.to_variant_object(F.create_map(F.lit("v"), now)))
    stamp = F.transform_values(stamp, lambda _, v: F.variant_get(v, "$.v", "variant"))
    fields = one_json_value(F.col("value"), "map<string, variant>")
    stamped = F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != "ts"), stamp))
    return df.withColumn("value", F.coalesce(stamped, F.col("value")))


def route_logs(
    df: DataFrame, startup_topic: str = topics.STARTUP_TOPIC, event_topic: str = topics.EVENT_TOPIC
) -> DataFrame:
    """Startup records to one topic, everything else (also without a type) to the other."""
    kind = F.get_json_object(F.col("value"), "$.type")
    topic = F.when(kind.eqNullSafe("startup"), startup_topic).otherwise(event_topic)
    return df.withColumn("topic", topic)


def route_cdc(
    changes: DataFrame,
    event_types: tuple[str, ...] = ("INSERT",),
    table_topics: dict[str, str] | None = None,
) -> DataFrame:
    """Row changes of the known tables as flat JSON records with text values, one per row.

    Other entry types, event types and tables are dropped before the rows are unpacked. A column named
    twice in a row keeps its last value.
    """
    topic: Column = F.lit(None).cast("string")
    for name, target in (table_topics or CDC_TOPICS).items():
        topic = F.when(F.col("table_name") == name, target).otherwise(topic)
    wanted = (F.col("entry_type") == "ROWDATA") & F.col("event_type").isin(*event_types)
    kept = [c for c in changes.columns if c not in ("entry_type", "event_type", "table_name", "rows")]
    rows = (
        changes.withColumn("topic", topic)
        .where(wanted & F.col("topic").isNotNull())
        .select("topic", *kept, F.explode("rows").alias("row"))
    )
    return rows.select("topic", F.to_json(_after_image(), {"ignoreNullFields": "false"}).alias("value"), *kept)


def _after_image() -> Column:
    """The columns of ``row`` as a map; of a column named twice the last value. Names are compared only where one repeats."""
    def is_last(entry: Column, i: Column) -> Column:
        return ~F.exists(F.slice("row", i + 2, F.size("row")), lambda other: other["name"] == entry["name"])

    repeats = F.size(F.array_distinct(F.transform("row", lambda e: e["name"]))) < F.size("row")
    return F.map_from_entries(F.when(repeats, F.filter("row", is_last)).otherwise(F.col("row")))


def changed_rows(changes: DataFrame, table_name: str, fields: list[str]) -> DataFrame:
    """The row changes of one table, whatever the operation: (event_type, fields as text, further columns of ``changes``)."""
    kept = [c for c in changes.columns if c not in ("entry_type", "event_type", "table_name", "rows")]
    wanted = (F.col("entry_type") == "ROWDATA") & (F.col("table_name") == table_name)
    rows = changes.where(wanted).select("event_type", *kept, F.explode("rows").alias("row"))
    image = rows.select("event_type", *kept, _after_image().alias("image"))
    return image.select("event_type", *[F.col("image")[f].alias(f) for f in fields], *kept)
