"""Stateful stream operators. Every one carries a watermark, so its state is evicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillpulse.functions.scalars import to_money
from tillpulse.operators.alerts import COUPON, SLIDE_SECONDS
from tillpulse.operators.sales import sale_columns


def first_seen_stream(startups: DataFrame, lateness: str = "25 hours", salts: int = 4) -> DataFrame:
    """The first arriving startup of every device and day, emitted once (append sinks).

    State is one key per device and day. The watermark runs on whole days: less than 25 hours would
    drop yesterday's records right at midnight. A stream cannot reduce duplicates before the shuffle,
    and single devices may send a large share of all records: the records of a device are deduplicated
    in ``salts`` parts first, for as many more state keys. Use 1 where no device stands out.
    """
    day = F.date_trunc("day", F.col("event_ts")).alias("day")
    keyed = startups.where(F.col("mid").isNotNull()).select("*", day).withWatermark("day", lateness)
    if salts > 1:
        salt = F.pmod(F.xxhash64(*startups.columns), F.lit(salts))
        keyed = keyed.withColumn("salt", salt).dropDuplicates(["mid", "day", "salt"]).drop("salt")
    return keyed.dropDuplicates(["mid", "day"]).drop("day")


def first_startup_stream(
    startups: DataFrame, tie_break: list[str] | None = None, lateness: str = "25 hours"
) -> DataFrame:
    """The earliest startup of every device and day (update mode, for keyed sinks).

    Arrival order does not matter: when an earlier record comes in late, the row is emitted again and
    replaces the former one. Each task reduces its rows before the shuffle.
    """
    ordered = ["ts", *(tie_break or [])]
    ordered += [c for c in startups.columns if c not in ("mid", *ordered)]
    day = F.date_trunc("day", F.col("event_ts")).alias("day")
    keyed = startups.where(F.col("mid").isNotNull()).select("mid", F.struct(*ordered).alias("row"), day)
    first = keyed.withWatermark("day", lateness).groupBy("day", "mid").agg(F.min("row").alias("row"))
    return first.select("mid", "row.*").select(*startups.columns)


def coupon_panes_stream(events: DataFrame, lateness: str = "10 minutes", slide: int = SLIDE_SECONDS) -> DataFrame:
    """Running event counts per device and pane (update mode).

    State holds panes, not windows: one row where overlapping windows would hold thirty.
    """
    coupon = F.col("evid") == COUPON
    known = events.where(F.col("mid").isNotNull()).withWatermark("event_ts", lateness)
    counts = known.groupBy(
        F.window("event_ts", f"{slide} seconds").alias("w"),
        "mid",
        "evid",
        F.when(coupon, F.col("uid")).alias("uid"),
        F.when(coupon, F.col("itemid")).alias("itemid"),
    ).agg(F.count(F.lit(1)).alias("n"))
    start = F.col("w.start")
    return counts.select(
        "mid",
        F.floor(F.unix_seconds(start) / slide).alias("pane"),
        "evid",
        "uid",
        "itemid",
        "n",
        F.to_date(start).alias("day"),
    )


# What the join of orders and lines needs of them.
ORDER_SIDE = ["id", "order_status", "create_time", "user_id", "create_date", "arrival_ts"]
LINE_SIDE = ["id", "order_id", "sku_id", "sku_name", "order_price", "arrival_ts"]


def _within(early: str, horizon: str) -> Column:
    """An order ``o`` and a line ``d`` of it that has arrived within the bounds."""
    return (
        (F.col("o.id") == F.col("d.order_id"))
        & (F.col("d.arrival_ts") >= F.col("o.arrival_ts") - F.expr(f"interval {early}"))
        & (F.col("d.arrival_ts") <= F.col("o.arrival_ts") + F.expr(f"interval {horizon}"))
    )


def _arrival() -> list[Column]:
    return [F.greatest("o.arrival_ts", "d.arrival_ts").alias("arrival_ts"), F.col("o.arrival_ts").alias("order_arrival_ts")]


def join_order_detail_stream(
    orders: DataFrame,
    details: DataFrame,
    early: str = "10 minutes",
    horizon: str = "1 day",
    lateness: str = "10 minutes",
    salts: int = 4,
    unmatched: bool = False,
) -> DataFrame:
    """Every order line with its order, whichever arrives first (append mode).

    With ``unmatched`` also the lines for which no order came within the bounds, once the watermark has passed them:
    ``order_id`` is NULL there. ``line_order_id`` is the order that the line names.

    A line may arrive up to ``early`` before its order and up to ``horizon`` after it. Both bounds are
    on arrival time, because lines carry no time of their own; together with the watermarks they tell
    the join when state can go. Stateful joins are not re-planned at run time, so the lines of an order
    are dealt out to ``salts`` partitions beforehand and the order is kept in each of them.
    """
    dealt = F.pmod(F.xxhash64("id"), F.lit(salts))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    o = orders.withWatermark("arrival_ts", lateness).withColumn("salt", copies).alias("o")
    d = details.withWatermark("arrival_ts", lateness).withColumn("salt", dealt).alias("d")
    within = _within(early, horizon) & (F.col("o.salt") == F.col("d.salt"))
    if not unmatched:
        return o.join(d, within).select(*sale_columns(), *_arrival())
    named = F.col("d.order_id").alias("line_order_id")
    return d.join(o, within, "left_outer").select(*sale_columns(), *_arrival(), named)


def join_order_detail_within(orders: DataFrame, details: DataFrame, early: str = "10 minutes", horizon: str = "1 day") -> DataFrame:
    """The same pairs for rows that are all there. An order with very many lines is split at run time."""
    return orders.alias("o").join(details.alias("d"), _within(early, horizon)).select(*sale_columns(), *_arrival())


def unmatched_lines(orders: DataFrame, details: DataFrame, early: str = "10 minutes", horizon: str = "1 day") -> DataFrame:
    """The lines that have no order within the bounds."""
    alone = details.alias("d").join(orders.alias("o"), _within(early, horizon), "left_anti")
    return alone.select(
        F.col("id").alias("order_detail_id"), "order_id", "sku_id", "sku_name",
        to_money(F.col("order_price")).cast("double").alias("sku_price"), "arrival_ts",
    )
