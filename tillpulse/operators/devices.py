"""Daily active devices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tillpulse.functions.scalars import as_date, on_date

Day = str | dt.date


def first_startup(startups: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """The earliest startup of every device and day.

    Equal times are settled by ``tie_break`` and then by the remaining columns. The minimum is taken
    per task before the shuffle, so a device with very many startups sends one row per task.
    """
    keys = ["log_date", "mid"]
    ordered = ["ts", *(tie_break or [])]
    ordered += [c for c in startups.columns if c not in keys and c not in ordered]
    earliest = F.min(F.struct(*ordered)).alias("row")
    picked = startups.where(F.col("mid").isNotNull()).groupBy(*keys).agg(earliest)
    return picked.select(*keys, "row.*").select(*startups.columns)


def roster(startups: DataFrame) -> DataFrame:
    """Devices seen per day."""
    return startups.select("log_date", "mid").distinct()


def exclude_seen(startups: DataFrame, seen: DataFrame) -> DataFrame:
    """Startups of devices that are not on the roster of their own day."""
    return startups.join(seen, ["log_date", "mid"], "left_anti")


def dau_total(startups: DataFrame, date: Day | None = None) -> DataFrame:
    """Active devices of a day (one row, zero included), or of every day that has any."""
    dau = F.count_distinct("mid").alias("dau")
    if date is None:
        return startups.where(F.col("mid").isNotNull()).groupBy("log_date").agg(dau)
    return on_date(startups, date, "log_date").agg(dau).select(F.lit(as_date(date)).alias("log_date"), "dau")


def _first_times(startups: DataFrame) -> DataFrame:
    return (
        startups.where(F.col("mid").isNotNull())
        .groupBy("log_date", "mid")
        .agg(F.min("event_ts").alias("first_ts"))
    )


def dau_by_hour(startups: DataFrame, date: Day | None = None) -> DataFrame:
    """Active devices by the hour of their first startup. Only the time is aggregated, which keeps
    both steps in hash aggregates."""
    hour = F.date_format("first_ts", "HH").alias("log_hour")
    return _first_times(on_date(startups, date, "log_date")).groupBy("log_date", hour).agg(F.count(F.lit(1)).alias("dau"))


def device_totals(startups: DataFrame, date: Day) -> DataFrame:
    """Active and new devices of a day in one pass over the history up to that day."""
    day = F.lit(as_date(date))
    per_device = (
        startups.where((F.col("log_date") <= day) & F.col("mid").isNotNull())
        .groupBy("mid")
        .agg(F.min("log_date").alias("first_day"), F.max("log_date").alias("last_day"))
    )
    return per_device.agg(
        F.count_if(F.col("last_day") == day).alias("dau"), F.count_if(F.col("first_day") == day).alias("new_mid")
    ).select(day.alias("log_date"), "dau", "new_mid")


def new_devices(startups: DataFrame, date: Day | None = None) -> DataFrame:
    """Devices whose first day ever is the given day, or the count for every day that has any."""
    if date is not None:
        return device_totals(startups, date).select("log_date", "new_mid")
    first_day = (
        startups.where(F.col("mid").isNotNull()).groupBy("mid").agg(F.min("log_date").alias("log_date"))
    )
    return first_day.groupBy("log_date").agg(F.count(F.lit(1)).alias("new_mid"))


def first_day_changes(startups: DataFrame, known: DataFrame) -> DataFrame:
    """What startups change about the first days of devices: (mid, first_day, moved). ``known`` (mid, first_day, ...) has a row per
    device. Rows with ``moved`` take an entry back, where an earlier day turns up."""
    days = startups.where(F.col("mid").isNotNull()).groupBy("mid").agg(F.min("log_date").alias("first_day"))
    met = days.join(known.select("mid", F.col("first_day").alias("known_day")), "mid", "left")
    earlier = met.where(F.col("known_day").isNull() | (F.col("first_day") < F.col("known_day")))
    new = F.struct("first_day", F.lit(False).alias("moved"))
    old = F.when(F.col("known_day").isNotNull(), F.struct(F.col("known_day").alias("first_day"), F.lit(True).alias("moved")))
    return earlier.select("mid", F.explode(F.array_compact(F.array(new, old))).alias("c")).select("mid", "c.*")


def new_devices_known(devices: DataFrame, date: Day | None = None) -> DataFrame:
    """``new_devices`` from the table of first days: a day reads its own folder."""
    found = on_date(devices, date, "first_day")
    if date is not None:
        return found.agg(F.count(F.lit(1)).alias("new_mid")).select(F.lit(as_date(date)).alias("log_date"), "new_mid")
    return found.groupBy(F.col("first_day").alias("log_date")).agg(F.count(F.lit(1)).alias("new_mid"))


def observed(df: DataFrame, name: str) -> DataFrame:
    """Report the number of rows passing this point with the query's metrics, without another job."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
