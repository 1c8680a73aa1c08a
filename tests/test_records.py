import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from tillpulse import operators as ops, sources


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_order_amount_quoted_bare_or_bad(spark):
    base = '"id":"%s","create_time":"2024-01-02 03:04:05","consignee_tel":"13812345678"'
    df = lines(
        spark,
        "{" + base % 1 + ',"total_amount":"12.50"}',
        "{" + base % 2 + ',"total_amount":12.5}',
        "{" + base % 3 + ',"total_amount":"twelve"}',
        "{" + base % 4 + "}",
    )
    got = rows(sources.accepted(sources.parse_order(df)).select("id", "total_amount", "consignee_tel", "create_hour"), "id")
    amounts = [Decimal("12.50"), Decimal("12.50"), None, None]
    assert got == [(str(i + 1), a, "138****5678", "03") for i, a in enumerate(amounts)]


def test_startup_fields_and_rejects(spark):
    df = lines(
        spark,
        '{"type":"startup","mid":"m1","uid":7,"ts":"1704067200000"}',
        '{"mid":"m2","ts":1704067200000}',
        '{"mid":"m3","ts":"soon"}',
        '{"mid":"m4","ts":9223372036854775807}',
        '{"ts":1}',
        "not json",
        '"text"',
        "[1]",
        None,
    )
    parsed = sources.parse_startup(df)
    good = rows(sources.accepted(parsed).select("mid", "uid", "log_type", "ts", "log_date"), "mid")
    day = dt.date(2024, 1, 1)
    assert good == [("m1", "7", "startup", 1704067200000, day), ("m2", None, None, 1704067200000, day)]
    reasons = [r[0] for r in rows(sources.rejects(parsed).select("reject_reason"), "reject_reason")]
    assert reasons == ["missing or invalid mid", *["missing or invalid ts"] * 2, *["not a JSON record"] * 4]


def test_event_numbers_become_text(spark):
    df = lines(spark, '{"mid":"m","evid":"coupon","itemid":12,"pgid":3,"npgid":4,"ts":1704067200000}')
    assert rows(sources.parse_event(df).select("itemid", "pgid", "npgid")) == [("12", "3", "4")]


def test_order_line_and_user(spark):
    detail = sources.parse_order_detail(lines(spark, '{"id":"1","order_id":"9","order_price":"1.5"}', '{"id":"2"}'))
    assert rows(sources.accepted(detail).select("id", "order_id", "order_price")) == [("1", "9", "1.5")]
    user = sources.parse_user(lines(spark, '{"id":"1","birthday":"1990-02-03"}', '{"id":"2","birthday":"?"}'))
    assert rows(sources.accepted(user).select("id", "birthday"), "id") == [("1", dt.date(1990, 2, 3)), ("2", None)]


def test_stamp_keeps_types_and_unreadable_lines(spark):
    df = lines(spark, '{"type":"event","n":5,"x":"5","o":{"a":[1]},"ts":"9"}', "no json", "[1]")
    got = [r[0] for r in rows(ops.stamp_ingest(df, F.lit(123).cast("bigint")))]
    assert got == ['{"n":5,"o":{"a":[1]},"type":"event","x":"5","ts":123}', "no json", "[1]"]
    now = rows(ops.stamp_ingest(df).select(F.get_json_object("value", "$.ts").cast("bigint")))[0][0]
    assert now > 1704067200000


def test_logs_without_type_are_events(spark):
    df = lines(spark, '{"type":"startup"}', '{"type":"event"}', '{"mid":"m"}', '{"type":null}', "broken")
    topics = [r[0] for r in rows(ops.route_logs(df, "s", "e").select("topic"))]
    assert topics == ["s", "e", "e", "e", "e"]


def test_changes_are_filtered_and_flattened(spark):
    def row(**columns):
        return [(k, v) for k, v in columns.items()]

    data = [
        ("ROWDATA", "INSERT", "order_info", [row(id="1", note=None), row(id="2", note="x")]),
        ("ROWDATA", "UPDATE", "order_info", [row(id="3")]),
        ("ROWDATA", "DELETE", "user_info", [row(id="4")]),
        ("ROWDATA", "INSERT", "user_info", [row(id="5")]),
        ("ROWDATA", "INSERT", "order_detail", [row(id="6")]),
        ("ROWDATA", "INSERT", "sku_info", [row(id="7")]),
        ("TRANSACTIONEND", "INSERT", "order_info", [row(id="8")]),
        ("ROWDATA", "INSERT", "order_info", []),
    ]
    from tillpulse.schemas import CDC_SCHEMA

    changes = spark.createDataFrame(data, CDC_SCHEMA)
    assert rows(ops.route_cdc(changes), "value") == [
        ("new_order", '{"id":"1","note":null}'),
        ("new_order", '{"id":"2","note":"x"}'),
        ("new_user", '{"id":"5"}'),
        ("new_order_detail", '{"id":"6"}'),
    ]
    assert ops.route_cdc(changes, ("INSERT", "UPDATE", "DELETE")).count() == 6
