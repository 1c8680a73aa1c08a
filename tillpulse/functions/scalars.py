"""Column functions. All of them are built-in expressions that stay in generated code."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillpulse.schemas import MONEY

# Labels of the age groups; rows without a known user get the last one.
AGE_BUCKETS = ("<20", "20-29", ">=30")
UNKNOWN = "unknown"


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def previous_day(value: str | dt.date) -> dt.date:
    return as_date(value) - dt.timedelta(days=1)


def on_date(df: DataFrame, date: str | dt.date | None, column: str) -> DataFrame:
    """Rows of one day; ``None`` keeps all days. Prunes partitions of date-partitioned tables."""
    return df if date is None else df.where(F.col(column) == F.lit(as_date(date)))


def with_log_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Epoch milliseconds to ``event_ts``, ``log_date`` and two-digit ``log_hour``."""
    at = F.timestamp_millis(F.col(ts))
    return df.withColumns(
        {"event_ts": at, "log_date": F.to_date(at), "log_hour": F.date_format(at, "HH")}
    )


def with_create_time(df: DataFrame, column: str = "create_time") -> DataFrame:
    """Split ``yyyy-MM-dd HH:mm:ss`` text into ``create_date`` and two-digit ``create_hour``; NULL if out of range."""
    day = F.split_part(F.col(column), F.lit(" "), F.lit(1))
    clock = F.split_part(F.col(column), F.lit(" "), F.lit(2))
    hour = F.split_part(clock, F.lit(":"), F.lit(1))
    number = F.when(hour.rlike("^[0-9]{1,2}$"), hour.cast("int"))
    return df.withColumns(
        {"create_date": day.try_cast("date"), "create_hour": F.when(number < 24, F.lpad(hour, 2, "0"))}
    )


# Put behind a JSON value, to see whether anything else stands there.
_END = "end of this record"


def _beside_end(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def is_one_json_value(text: Column) -> Column:
    """True where the text is one JSON value: nothing behind it, and no key twice in an object."""
    def alone(parsed: Column) -> Column:
        ended = F.try_variant_get(parsed, "$[1]", "string") == _END
        return F.coalesce(ended & F.try_variant_get(parsed, "$[2]", "variant").isNull(), F.lit(False))

    # Within the lambda the parsed text is a value; written out, it would be parsed again wherever it is named.
    return F.transform(F.array(_beside_end(text)), alone)[0]


def one_json_value(text: Column, kind: str) -> Column:
    """The one JSON value that the text is, as ``kind``; NULL where it is none or not of the kind."""
    def alone(parts: Column) -> Column:
        return F.when((F.size(parts) == 2) & (parts[1].try_cast("string") == _END), parts[0].try_cast(kind))

    return F.transform(F.array(_beside_end(text).try_cast("array<variant>")), alone)[0]


def mask_phone(tel: Column) -> Column:
    """Star out the fourth to seventh character; numbers too short to mask become NULL."""
    return F.when(F.length(tel) >= 7, F.overlay(tel, F.lit("****"), F.lit(4)))


def to_money(amount: Column) -> Column:
    return amount.try_cast(MONEY)


def age_years(birthday: Column, as_of: Column | str | dt.date) -> Column:
    """Whole years of 365 days between birthday and ``as_of``."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_date(as_of))
    return (F.datediff(today, birthday) / F.lit(365)).cast("int")


def age_bucket(age: Column) -> Column:
    under, middle, over = AGE_BUCKETS
    return (
        F.when(age < 20, under).when(age < 30, middle).when(age >= 30, over).otherwise(UNKNOWN)
    )


def trunc_pct(count: Column, total: Column) -> Column:
    """Percentage with one decimal, cut rather than rounded; NULL for an empty total."""
    scaled = count.cast("bigint") * F.lit(1000)
    whole = F.when(total != 0, (scaled - F.pmod(scaled, total)) / total)
    return F.floor(whole) / F.lit(10.0)


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def match_all_terms(text: Column, keyword: str) -> Column:
    """True where every term of the keyword is a term of the text; no terms match everything."""
    wanted = _terms(F.lit(keyword or ""))
    missing = F.size(F.array_except(wanted, _terms(F.coalesce(text, F.lit("")))))
    return missing == 0


def with_alert_id(df: DataFrame, at: str = "window_end") -> DataFrame:
    """``alert_id`` = device and minute number, one id per device and minute."""
    minute = F.floor(F.unix_seconds(F.col(at)) / 60)
    return df.withColumn("alert_id", F.concat_ws("_", F.col("mid"), minute.cast("string")))
