import datetime as dt
import json

import pytest

from conftest import rows
from tillpulse import operators as ops, plans
from tillpulse.schemas import SALE_DETAIL_FIELDS

DAY = dt.date(2024, 1, 2)
AS_OF = dt.date(2024, 1, 1)


@pytest.fixture
def sales(spark):
    orders = spark.createDataFrame(
        [("o1", "paid", "2024-01-02 03:00:00", "u1", DAY), ("o2", "new", "2024-01-02 04:00:00", "u9", DAY),
         ("o3", "new", "2024-01-03 04:00:00", "u2", dt.date(2024, 1, 3)), ("o4", "new", "2024-01-02 04:00:00", None, DAY)],
        "id string, order_status string, create_time string, user_id string, create_date date",
    )
    details = spark.createDataFrame(
        [("d1", "o1", "s1", "small ring", "1.50"), ("d2", "o1", "s2", "big box", "dear"), ("d3", "o2", "s1", "small ring", "2"),
         ("d4", "o3", "s1", "small box", "3"), ("d5", "o7", "s1", "small ring", "3"), ("d6", "o4", "s9", None, "3")],
        "id string, order_id string, sku_id string, sku_name string, order_price string",
    )
    users = spark.createDataFrame(
        [("u1", "M", dt.date(2010, 1, 1), "1"), ("u2", "F", dt.date(1980, 1, 1), "2")],
        "id string, gender string, birthday date, user_level string",
    )
    return ops.enrich_user(ops.join_order_detail(orders, details), users, AS_OF)


def test_sale_detail(sales):
    assert sales.columns == SALE_DETAIL_FIELDS
    got = rows(sales.select("order_detail_id", "order_id", "user_gender", "user_age", "sku_price"), "order_detail_id")
    assert got == [
        ("d1", "o1", "M", 14, 1.5),
        ("d2", "o1", "M", 14, None),
        ("d3", "o2", None, None, 2.0),
        ("d4", "o3", "F", 44, 3.0),
        ("d6", "o4", None, None, 3.0),
    ]


def test_last_user_version_wins(spark):
    df = spark.createDataFrame([("u", "1", 1), ("u", "2", 2), ("v", "9", 1)], "id string, user_level string, at int")
    assert rows(ops.latest_users(df, ["at"]).select("id", "user_level"), "id") == [("u", "2"), ("v", "9")]


def test_rows_without_key_all_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("k", 1), ("k", 2)], "id string, at int")
    assert rows(ops.latest_rows(df, ["id"], ["at"]), "id") == [(None, 1), (None, 1), ("k", 2)]
    assert rows(ops.latest_rows(df, ["id"], ["at"], null_is_value=True), "id") == [(None, 1), ("k", 2)]


def ids(df):
    return [r.order_detail_id for r in df.orderBy("order_detail_id").collect()]


def test_search(sales):
    assert ids(plans.sale_search(sales, DAY)) == ["d1", "d2", "d3", "d6"]
    assert ids(plans.sale_search(sales, DAY, "RING")) == ["d1", "d3"]
    assert ids(plans.sale_search(sales, DAY, "small box")) == []
    assert ids(plans.sale_search(sales, None, "small box")) == ["d4"]
    assert plans.sale_search(sales).count() == 0
    assert rows(plans.total_hits(plans.sale_search(sales, DAY, "ring"))) == [(2,)]


def test_pages(sales):
    assert ids(plans.sale_page(sales, 1, 2)) == ["d1", "d2"]
    assert ids(plans.sale_page(sales, 3, 2)) == ["d6"]
    assert ids(plans.sale_page(sales, 4, 2)) == []
    assert ids(plans.sale_page(sales, size=2, after="d2")) == ["d3", "d4"]
    with pytest.raises(ValueError):
        plans.sale_page(sales, 0)


def test_facets(sales):
    assert rows(plans.gender_facet(sales).select("bucket", "count", "ratio"), "bucket") == [
        ("F", 1, 20.0), ("M", 2, 40.0), ("unknown", 2, 40.0),
    ]
    ages = {r.bucket: (r["count"], r.ratio) for r in plans.age_facet(sales).collect()}
    assert ages == {"<20": (2, 40.0), "20-29": (0, 0.0), ">=30": (1, 20.0), "unknown": (2, 40.0)}
    nothing = sales.where("false")
    assert {(r["count"], r.ratio) for r in plans.gender_facet(nothing).collect()} == {(0, None)}
    assert rows(plans.gender_terms(sales)) == [("M", 2), ("F", 1)]
    assert rows(plans.age_terms(sales, 1)) == [(14, 2)]


def test_document(sales):
    doc = json.loads(plans.sale_search_document(sales, DAY, "", page=2, size=3).first()[0])
    assert doc["total"] == 4
    assert [d["order_detail_id"] for d in doc["detail"]] == ["d6"]
    assert doc["stat"] == [
        {"title": "用户年龄占比", "options": [
            {"name": "20岁以下", "value": 50.0}, {"name": "20岁到30岁", "value": 0.0}, {"name": "30岁及以上", "value": 0.0},
            {"name": "未知", "value": 50.0}]},
        {"title": "用户性别占比", "options": [{"name": "男", "value": 50.0}, {"name": "女", "value": 0.0}, {"name": "未知", "value": 50.0}]},
    ]
    empty = json.loads(plans.sale_search_document(sales, "2030-01-01").first()[0])
    assert empty["total"] == 0 and empty["detail"] == []
