"""JSON text to typed records.

Each parser takes a frame with a ``value`` column (and optionally ``arrival_ts``) and adds
``reject_reason``: NULL for usable rows. ``accepted`` and ``rejects`` split on it, so one bad
record never fails a batch and is never lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillpulse import schemas
from tillpulse.functions.scalars import is_one_json_value, mask_phone, to_money, with_create_time, with_log_time

_BROKEN, _WHOLE = "_broken", "_whole"
# First and last millisecond a timestamp can show with a four-digit year.
_MIN_MS, _MAX_MS = -62135596800000, 253402300799999


def _epoch_ms(text: Column) -> Column:
    ms = text.try_cast("bigint")
    return F.when(ms.between(_MIN_MS, _MAX_MS), ms)


def _read_json(df: DataFrame, fields: list[str] | T.StructType) -> DataFrame:
    shape = fields if isinstance(fields, T.StructType) else schemas.text_struct(fields)
    parsed = F.from_json(
        F.col("value"), T.StructType([*shape.fields, T.StructField(_BROKEN, T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN},
    )
    kept = [c for c in ("arrival_ts",) if c in df.columns]
    # As a generator the parser runs once per record; as a plain column, later filters on the fields
    # would each be pushed down together with a parser of their own.
    return df.select("value", *kept, is_one_json_value(F.col("value")).alias(_WHOLE), F.inline(F.array(parsed)))


def _judge(df: DataFrame, required: list[str]) -> DataFrame:
    reason: Column = F.when(~F.col(_WHOLE) | F.col(_BROKEN).isNotNull(), "not a JSON record")
    for name in required:
        reason = reason.when(F.col(name).isNull(), f"missing or invalid {name}")
    return df.withColumn("reject_reason", reason).drop(_BROKEN, _WHOLE)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason", "value")


def rejects(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull()).select("value", "reject_reason")


def parse_change(df: DataFrame) -> DataFrame:
    """One database change per record: entry and event type, table, and the rows with their columns."""
    shape = T._parse_datatype_string(schemas.CDC_SCHEMA)
    return _judge(_read_json(df, shape), ["entry_type", "event_type", "table_name"])


def parse_startup(df: DataFrame) -> DataFrame:
    out = _read_json(df, schemas.STARTUP_FIELDS).withColumnRenamed("type", "log_type")
    out = with_log_time(out.withColumn("ts", _epoch_ms(F.col("ts"))))
    return _judge(out, ["mid", "ts"])


def parse_event(df: DataFrame) -> DataFrame:
    out = with_log_time(
        _read_json(df, schemas.EVENT_FIELDS).withColumn("ts", _epoch_ms(F.col("ts")))
    )
    return _judge(out, ["mid", "ts"])


def parse_order(df: DataFrame) -> DataFrame:
    out = _read_json(df, schemas.ORDER_FIELDS).withColumns(
        {"total_amount": to_money(F.col("total_amount")), "consignee_tel": mask_phone(F.col("consignee_tel"))}
    )
    return _judge(with_create_time(out), ["id", "create_date", "create_hour"])


def parse_order_detail(df: DataFrame) -> DataFrame:
    return _judge(_read_json(df, schemas.ORDER_DETAIL_FIELDS), ["order_id"])


def parse_user(df: DataFrame) -> DataFrame:
    out = _read_json(df, schemas.USER_FIELDS).withColumn("birthday", F.col("birthday").try_cast("date"))
    return _judge(out, ["id"])
