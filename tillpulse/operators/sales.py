"""Sale details: order x order line, then the buyer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillpulse.functions.scalars import age_years, to_money
from tillpulse.operators.latest import latest_rows
from tillpulse.schemas import SALE_DETAIL_FIELDS


def sale_columns(order: str = "o", line: str = "d") -> list[Column]:
    """The order and line part of a sale detail, from two aliased frames."""
    return [
        F.col(f"{line}.id").alias("order_detail_id"),
        F.col(f"{order}.id").alias("order_id"),
        F.col(f"{order}.order_status").alias("order_status"),
        F.col(f"{order}.create_time").alias("create_time"),
        F.col(f"{order}.user_id").alias("user_id"),
        F.col(f"{line}.sku_id").alias("sku_id"),
        to_money(F.col(f"{line}.order_price")).cast("double").alias("sku_price"),
        F.col(f"{line}.sku_name").alias("sku_name"),
        F.col(f"{order}.create_date").alias("dt"),
    ]


def join_order_detail(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Every order line with its order. An order with very many lines is split at run time. Without
    ``order_price`` in the lines the price is NULL."""
    if "order_price" not in details.columns:
        details = details.withColumn("order_price", F.lit(None).cast("string"))
    joined = orders.alias("o").join(details.alias("d"), F.col("o.id") == F.col("d.order_id"))
    return joined.select(*sale_columns())


def match_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Order lines (order_detail_id, order_id, sku_id, sku_name, sku_price, arrival_ts) that have waited, each with the other columns of its
    order as ``found``, NULL where the order has not come yet. ``orders`` has one row per id."""
    of_order = orders.select(F.col("id").alias("order_id"), F.struct(*[c for c in orders.columns if c != "id"]).alias("found"))
    return lines.join(of_order, "order_id", "left").select(*lines.columns, "found")


def late_sales(matched: DataFrame) -> DataFrame:
    """Sales of the lines whose order has come meanwhile; columns as from ``join_order_detail``, and the buyer's where the orders have them."""
    sold = matched.where(F.col("found").isNotNull())
    buyer = [F.col(f"found.{c}") for c in BUYER_FIELDS if c in matched.schema["found"].dataType.fieldNames()]
    return sold.select(
        "order_detail_id", "order_id", "found.order_status", "found.create_time", "found.user_id", "sku_id", "sku_price", "sku_name",
        F.col("found.create_date").alias("dt"), F.greatest("arrival_ts", "found.arrival_ts").alias("arrival_ts"),
        F.col("found.arrival_ts").alias("order_arrival_ts"), *buyer,
    )


def waiting_lines(matched: DataFrame) -> DataFrame:
    """The lines whose order has not come yet."""
    return matched.where(F.col("found").isNull()).drop("found")


def latest_users(users: DataFrame, order_cols: list[str]) -> DataFrame:
    """The last version of every user."""
    return latest_rows(users, ["id"], order_cols, null_is_value=True)


BUYER_FIELDS = ["user_gender", "user_age", "user_level"]


def with_buyer(rows: DataFrame, users: DataFrame, as_of: str | dt.date | Column) -> DataFrame:
    """Rows with a ``user_id``, and gender, age and level of that user; NULLs where there is no known user.

    ``users`` holds one row per id, so a user with very many rows makes only the other side heavy,
    which the adaptive join splits.
    """
    buyer = users.select(
        F.col("id").alias("user_id"),
        F.col("gender").alias("user_gender"),
        age_years(F.col("birthday"), as_of).alias("user_age"),
        F.col("user_level").alias("user_level"),
    )
    return rows.join(buyer, "user_id", "left")


def enrich_user(sales: DataFrame, users: DataFrame, as_of: str | dt.date | Column) -> DataFrame:
    """Add gender, age and level of the buyer; sales without a known user stay, with NULLs."""
    arrival = [c for c in ("arrival_ts", "order_arrival_ts") if c in sales.columns]
    return with_buyer(sales, users, as_of).select(*SALE_DETAIL_FIELDS, *arrival)
