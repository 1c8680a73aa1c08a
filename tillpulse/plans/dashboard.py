"""Figures of the start page: tiles, and today against yesterday by hour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillpulse.functions.scalars import as_date, previous_day, to_money
from tillpulse.operators.devices import device_totals
from tillpulse.operators.orders import order_amount_total

Day = str | dt.date

# Tile ids and names.
TILES = {"dau": "新增日活", "new_mid": "新增设备", "order_amount": "新增交易额"}


def kpi_tiles(startups: DataFrame, orders: DataFrame, date: Day) -> DataFrame:
    """Three rows (id, name, value) for a day; the value of a day without orders is NULL."""

    def tile(df: DataFrame, key: str, value: str) -> DataFrame:
        return df.select(F.lit(key).alias("id"), F.lit(TILES[key]).alias("name"), F.col(value).cast("double").alias("value"))

    devices = device_totals(startups, date)
    # Both device figures come from one pass: the single row is turned into two.
    pair = F.explode(
        F.array(
            F.struct(F.lit("dau").alias("id"), F.lit(TILES["dau"]).alias("name"), F.col("dau").cast("double").alias("value")),
            F.struct(
                F.lit("new_mid").alias("id"), F.lit(TILES["new_mid"]).alias("name"), F.col("new_mid").cast("double").alias("value")
            ),
        )
    )
    revenue = tile(order_amount_total(orders, date), "order_amount", "amount")
    return devices.select(pair.alias("t")).select("t.*").unionByName(revenue)


def kpi_document(tiles: DataFrame) -> DataFrame:
    """The tiles as one JSON array, in their fixed order."""
    place = F.array_position(F.lit(list(TILES)), F.col("id")).alias("place")
    rows = F.sort_array(F.collect_list(F.struct(place, "id", "name", "value")))
    entries = F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["name"].alias("name"), r["value"].alias("value")))
    return tiles.agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("document"))


def hourly_compare(df: DataFrame, metric: str, date: Day) -> DataFrame:
    """``hour, today, yesterday`` from one scan of the two days.

    ``dau`` takes startups, ``order_amount`` takes orders. Hours without rows on a day are NULL.
    """
    day, before = as_date(date), previous_day(date)
    if metric == "dau":
        two = df.where(F.col("log_date").isin(day, before) & F.col("mid").isNotNull())
        rows = (
            two.groupBy("log_date", "mid")
            .agg(F.min("event_ts").alias("first_ts"))
            .select(F.col("log_date").alias("d"), F.date_format("first_ts", "HH").alias("hour"))
        )

        def value(on: dt.date) -> Column:
            hits = F.count_if(F.col("d") == F.lit(on))
            return F.when(hits > 0, hits)

    elif metric == "order_amount":
        two = df.where(F.col("create_date").isin(day, before))
        rows = two.select(
            F.col("create_date").alias("d"), F.col("create_hour").alias("hour"), to_money(F.col("total_amount")).alias("v")
        )

        def value(on: dt.date) -> Column:
            return F.sum(F.when(F.col("d") == F.lit(on), F.col("v"))).cast("double")

    else:
        raise ValueError(f"unknown metric {metric!r}: use 'dau' or 'order_amount'")
    return rows.groupBy("hour").agg(value(day).alias("today"), value(before).alias("yesterday"))


def hourly_from_totals(totals: DataFrame, date: Day, day: str, hour: str, value: str) -> DataFrame:
    """``hourly_compare`` from sums that are kept per day and hour: a row per hour is read, not the records behind it."""
    today, before = as_date(date), previous_day(date)

    def of(on: dt.date) -> Column:
        return F.max(F.when(F.col(day) == F.lit(on), F.col(value).cast("double")))

    two = totals.where(F.col(day).isin(today, before) & (F.col(value) != 0))
    return two.groupBy(F.col(hour).alias("hour")).agg(of(today).alias("today"), of(before).alias("yesterday"))


def fill_hours(df: DataFrame, hour: str = "hour") -> DataFrame:
    """All 24 hours; missing values become 0."""
    names = [c for c in df.columns if c != hour]
    every = df.sparkSession.range(24).select(F.lpad(F.col("id").cast("string"), 2, "0").alias(hour))
    joined = every.join(df, hour, "left")
    return joined.select(hour, *[F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in names])


def as_hour_map(df: DataFrame, value: str, hour: str = "hour", name: str = "by_hour") -> DataFrame:
    """At most 24 hour rows as one map hour -> value; hours without a value are left out."""
    entry = F.when(F.col(value).isNotNull(), F.struct(F.col(hour), F.col(value)))
    return df.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))


def hourly_document(compare: DataFrame) -> DataFrame:
    """``{"today": {hour: value}, "yesterday": {hour: value}}`` from at most 24 compared hours."""

    def by_hour(name: str) -> Column:
        entry = F.when(F.col(name).isNotNull(), F.struct(F.col("hour"), F.col(name)))
        return F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name)

    maps = compare.agg(by_hour("today"), by_hour("yesterday"))
    return maps.select(F.to_json(F.struct("today", "yesterday")).alias("document"))
