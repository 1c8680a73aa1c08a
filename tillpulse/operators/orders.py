"""Order revenue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillpulse.functions.scalars import as_date, mask_phone, on_date, to_money, with_create_time

Day = str | dt.date

# The map legend has six bands of 100 sales each.
BAND_FROM, BAND_TO, BANDS = 0.0, 600.0, 6


def order_clean(orders: DataFrame) -> DataFrame:
    """Creation day and hour from the text column, phone masked."""
    return with_create_time(orders).withColumn("consignee_tel", mask_phone(F.col("consignee_tel")))


def _amount() -> Column:
    """Exact decimal sum, so that the order of addition does not matter."""
    return F.sum(to_money(F.col("total_amount"))).cast("double").alias("amount")


def order_amount_total(orders: DataFrame, date: Day | None = None) -> DataFrame:
    """Revenue of a day (one row, NULL without orders), or of every day with orders."""
    if date is None:
        return orders.groupBy("create_date").agg(_amount())
    total = on_date(orders, date, "create_date").agg(_amount())
    return total.select(F.lit(as_date(date)).alias("create_date"), "amount")


def order_amount_by_hour(orders: DataFrame, date: Day | None = None) -> DataFrame:
    return on_date(orders, date, "create_date").groupBy("create_date", "create_hour").agg(_amount())


def sales_by_province(orders: DataFrame, date: Day | None = None) -> DataFrame:
    """Orders and revenue per province with the legend band of the order count."""
    n = F.count(F.lit(1)).alias("n_orders")
    rows = on_date(orders, date, "create_date").groupBy("province_id").agg(n, _amount())
    band = F.width_bucket(F.col("n_orders").cast("double"), F.lit(BAND_FROM), F.lit(BAND_TO), F.lit(BANDS))
    return rows.withColumn("band", band.cast("int"))
