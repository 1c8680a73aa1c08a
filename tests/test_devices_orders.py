import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillpulse import functions as fn, operators as ops, plans

DAY = "2024-01-02"


def ms(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.fixture
def startups(spark):
    data = [
        ("a", "2024-01-01 23:59:59", 1),
        ("a", "2024-01-02 00:00:01", 2),
        ("a", "2024-01-02 09:00:00", 3),
        ("b", "2024-01-02 09:30:00", 5),
        ("b", "2024-01-02 09:30:00", 4),
        ("c", "2024-01-01 10:00:00", 6),
        (None, "2024-01-02 10:00:00", 7),
    ]
    df = spark.createDataFrame([(m, ms(at), i) for m, at, i in data], "mid string, ts bigint, record_id int")
    return fn.with_log_time(df)


def test_first_startup_per_device_and_day(startups):
    got = rows(ops.first_startup(startups, ["record_id"]).select("log_date", "mid", "record_id"), "record_id")
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    assert got == [(one, "a", 1), (two, "a", 2), (two, "b", 4), (one, "c", 6)]


def test_exclude_seen_looks_at_the_records_own_day(startups):
    seen = ops.roster(startups.where("mid = 'a' and log_hour = '23'"))
    left = rows(ops.exclude_seen(startups, seen).select("record_id"), "record_id")
    assert [r[0] for r in left] == [2, 3, 4, 5, 6, 7]


def test_daily_counts(startups):
    assert rows(ops.dau_total(startups, DAY).select("dau")) == [(2,)]
    assert rows(ops.dau_total(startups, "2030-01-01").select("dau")) == [(0,)]
    assert rows(ops.dau_total(startups), "log_date") == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 2), 2)]
    assert rows(ops.dau_by_hour(startups, DAY).select("log_hour", "dau"), "log_hour") == [("00", 1), ("09", 1)]
    assert rows(ops.new_devices(startups, DAY).select("new_mid")) == [(1,)]
    assert rows(ops.device_totals(startups, DAY).select("dau", "new_mid")) == [(2, 1)]


def test_observed_counts_come_with_the_query(spark, startups):
    from pyspark.sql import Observation

    before = Observation("before")
    df = startups.observe(before, F.count(F.lit(1)).alias("rows"))
    ops.observed(ops.first_startup(df), "after").collect()
    assert before.get == {"rows": 7}


@pytest.fixture
def orders(spark):
    data = [
        ("1", "11", "2024-01-01 10:00:00", Decimal("0.10")),
        ("2", "11", "2024-01-02 10:10:00", Decimal("0.20")),
        ("3", "12", "2024-01-02 10:20:00", Decimal("0.10")),
        ("4", "12", "2024-01-02 23:20:00", None),
    ]
    df = spark.createDataFrame(data, "id string, province_id string, create_time string, total_amount decimal(18,2)")
    return fn.with_create_time(df)


def test_revenue_is_exact_and_null_without_orders(orders):
    assert rows(ops.order_amount_total(orders, DAY).select("amount")) == [(0.3,)]
    assert rows(ops.order_amount_total(orders, "2030-01-01").select("amount")) == [(None,)]
    assert rows(ops.order_amount_by_hour(orders, DAY).select("create_hour", "amount"), "create_hour") == [
        ("10", 0.3),
        ("23", None),
    ]


def test_compare_and_fill_hours(startups, orders):
    dau = plans.hourly_compare(startups, "dau", DAY)
    assert rows(dau, "hour") == [("00", 1, None), ("09", 1, None), ("10", None, 1), ("23", None, 1)]
    filled = rows(plans.fill_hours(dau), "hour")
    assert len(filled) == 24 and filled[0] == ("00", 1, 0) and filled[23] == ("23", 0, 1) and filled[5] == ("05", 0, 0)
    money = plans.hourly_compare(orders, "order_amount", DAY)
    assert rows(money, "hour") == [("10", 0.3, 0.1), ("23", None, None)]
    assert rows(plans.hourly_document(money)) == [('{"today":{"10":0.3},"yesterday":{"10":0.1}}',)]
    assert rows(plans.as_hour_map(dau, "today")) == [({"00": 1, "09": 1},)]
    empty = plans.fill_hours(plans.hourly_compare(orders, "order_amount", "2030-01-01"))
    assert {r[1:] for r in rows(empty)} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        plans.hourly_compare(orders, "visits", DAY)


def test_tiles(startups, orders):
    tiles = plans.kpi_tiles(startups, orders, DAY)
    assert {(r.id, r.value) for r in tiles.collect()} == {("dau", 2.0), ("new_mid", 1.0), ("order_amount", 0.3)}
    text = plans.kpi_document(plans.kpi_tiles(startups, orders, "2030-01-01")).first()[0]
    assert text == (
        '[{"id":"dau","name":"新增日活","value":0.0},{"id":"new_mid","name":"新增设备","value":0.0},'
        '{"id":"order_amount","name":"新增交易额","value":null}]'
    )


def test_provinces_and_bands(spark, orders):
    assert rows(ops.sales_by_province(orders, DAY).select("province_id", "n_orders", "amount", "band"), "province_id") == [
        ("11", 1, 0.2, 1),
        ("12", 2, 0.1, 1),
    ]
    many = spark.range(700).selectExpr("'9' as province_id", "cast(1 as decimal(18,2)) as total_amount", "id")
    assert rows(ops.sales_by_province(many).select("n_orders", "band")) == [(700, 7)]
    some = many.where("id < 250")
    assert rows(ops.sales_by_province(some).select("band")) == [(3,)]


def test_clean_order(spark):
    df = spark.createDataFrame([("13812345678", "2024-01-02 03:04:05")], "consignee_tel string, create_time string")
    got = rows(ops.order_clean(df).select("consignee_tel", "create_date", "create_hour"))
    assert got == [("138****5678", dt.date(2024, 1, 2), "03")]
