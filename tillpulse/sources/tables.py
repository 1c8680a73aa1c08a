"""Shop records derived from the generic test tables (events, orders, lineitem, customer, part).

Each function is lazy and scans only the columns it needs. ``since``/``until`` are days; they become
range predicates on the stored timestamp column, so that the scan itself skips row groups.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillpulse.functions.scalars import as_date, to_money

Day = str | dt.date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _between(df: DataFrame, column: str, since: Day | None, until: Day | None) -> DataFrame:
    """Rows from the start of ``since`` to the end of ``until``."""
    if since is not None:
        df = df.where(F.col(column) >= F.lit(str(as_date(since))).cast("timestamp_ntz"))
    if until is not None:
        after = as_date(until) + dt.timedelta(days=1)
        df = df.where(F.col(column) < F.lit(str(after)).cast("timestamp_ntz"))
    return df


def _device_columns() -> dict[str, Column]:
    user = F.col("user_id")
    at = F.col("ts").cast("timestamp")
    return {
        "mid": F.concat(F.lit("mid_"), (user % 20).cast("string")),
        "uid": user.cast("string"),
        "os": F.when(user % 10 < 3, "ios").otherwise("android"),
        "area": F.concat(F.lit("area_"), (user % 10).cast("string")),
        "ts": F.unix_millis(at),
        "event_ts": at,
        "log_date": F.to_date(at),
        "log_hour": F.date_format(at, "HH"),
        "event_id": F.col("event_id"),
    }


def startup_log(events: DataFrame, since: Day | None = None, until: Day | None = None) -> DataFrame:
    rows = _between(events.where(F.col("event_type") == "signup"), "ts", since, until)
    return rows.select(*[c.alias(n) for n, c in _device_columns().items()])


def event_log(events: DataFrame, since: Day | None = None, until: Day | None = None) -> DataFrame:
    kind = F.col("event_type")
    evid = (
        F.when(kind == "purchase", "coupon")
        .when(kind == "click", "clickItem")
        .when(kind == "view", "addCart")
        .otherwise("addComment")
    )
    columns = _device_columns() | {"evid": evid, "itemid": (F.col("event_id") % 50).cast("string")}
    rows = _between(events.where(kind != "signup"), "ts", since, until)
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def order_info(
    orders: DataFrame, customer: DataFrame, since: Day | None = None, until: Day | None = None
) -> DataFrame:
    """Orders spread over the hours of their day. The hour shift is below one day, so one more day
    before ``since`` covers every order that can fall into the range."""
    first = None if since is None else as_date(since) - dt.timedelta(days=1)
    rows = _between(orders, "o_orderdate", first, until)
    hours = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    at = (F.col("o_orderdate") + hours).cast("timestamp")
    return rows.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("c_nationkey").cast("string").alias("province_id"),
        F.concat(F.lit("138"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("consignee_tel"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_custkey").cast("string").alias("user_id"),
        to_money(F.col("o_totalprice")).alias("total_amount"),
        at.alias("create_ts"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        F.to_date(at).alias("create_date"),
        F.date_format(at, "HH").alias("create_hour"),
    )


def user_info(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    shift = ((key * 37) % 15000).cast("int")
    return customer.where(key % 10 != 9).select(
        key.cast("string").alias("id"),
        F.col("c_name").alias("login_name"),
        F.col("c_mktsegment").alias("user_level"),
        F.date_add(F.lit(dt.date(1960, 1, 1)), shift).alias("birthday"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def order_detail(lineitem: DataFrame, part: DataFrame, values: tuple[str, ...] = ("order_price", "sku_num")) -> DataFrame:
    """Order lines. A line number that occurs again replaces the earlier line (last write wins);
    the repeats collapse in a partial aggregate before the shuffle and before the product join.

    ``values``: which of the two figures are wanted. Nothing can be pruned through the aggregate, so the
    others are not put in.
    """
    figures = {
        "order_price": ("l_extendedprice", to_money(F.col("l_extendedprice"))), "sku_num": ("l_quantity", F.col("l_quantity")),
    }
    last = F.max(F.struct("l_shipdate", "l_partkey", *[figures[v][0] for v in values])).alias("line")
    lines = lineitem.groupBy("l_orderkey", "l_linenumber").agg(last).select("l_orderkey", "l_linenumber", "line.*")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("p_name").alias("sku_name"),
        *[figures[v][1].alias(v) for v in values],
    )
