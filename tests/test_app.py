"""From raw lines and recorded topics to the reports, through the command line."""

import json

import pytest

from test_streaming import BASE, Topics, at, event, line, order, user
from tillpulse import app, streaming


def test_jobs_and_reports(spark, tmp_path):
    topics = Topics(spark, str(tmp_path / "topics"))
    raw = [(at(i), {"type": "startup", "mid": m, "uid": "u"}) for i, m in enumerate("aab")] + [event("a", "coupon", at(1)), (at(2), "?")]
    topics.send(app.RAW_TOPIC, *raw)
    def inserted(table, when, record):
        pairs = [{"name": k, "value": v} for k, v in record.items()]
        return when, {"entry_type": "ROWDATA", "event_type": "INSERT", "table_name": table, "rows": [pairs]}

    for topic, rows in {
        app.CHANGE_TOPIC: [inserted("order_info", *order("o2", at(1), "u2")), inserted("sku_info", at(1), {"id": "1"})],
        "new_order": [order("o1", at(0))],
        "new_order_detail": [line("l1", "o1", at(0)), line("l2", "o2", at(1))],
        "new_user": [user("u1", at(-1), "1", "2000-01-01")],
    }.items():
        topics.send(topic, *rows)
    places = ["--tables", str(tmp_path / "tables"), "--checkpoints", str(tmp_path / "cp"), "--replay", topics.folder]
    for job in app.JOBS:
        app.main([job, *places, "--once"], spark)

    def report(*args):
        return json.loads(app.main([*args, "--tables", places[1], "--date", str(BASE.date())], spark))

    assert [(t["id"], t["value"]) for t in report("tiles")] == [("dau", 2.0), ("new_mid", 2.0), ("order_amount", 10.0)]
    assert report("hours") == {"today": {"12": 2}, "yesterday": {}}
    assert report("hours", "--metric", "order_amount") == {"today": {"12": 10.0}, "yesterday": {}}
    found = report("search", "--keyword", "ring", "--size", "1")
    assert found["total"] == 2 and [d["order_detail_id"] for d in found["detail"]] == ["l1"]
    for _ in range(2):
        minutes = [json.loads(d) for d in app.main(["alerts-of-day", *places[:2], "--date", str(BASE.date())], spark).split("\n")]
        assert len(minutes) == 6 and {m["mid"] for m in minutes} == {"a"} and all("_" in m["alert_id"] for m in minutes)
        provinces = report("provinces")
        assert (provinces["n_orders"], provinces["amount"]) == (2, 10.0)
        into = tmp_path / f"{places[1]}-2"
        app.main(["compact", *places[:2], "--into", str(into)], spark)
        places[1] = str(into)
    assert report("search", "--keyword", "ring", "--size", "1") == found
    app.main(["reconcile", *places[:2], "--into", str(tmp_path / "rest")], spark)
    assert report("search", "--keyword", "ring", "--size", "1") == found
    stamped = [json.loads(r[0])["ts"] for r in spark.read.text(str(tmp_path / "tables" / "raw_log")).collect() if r[0] != "?"]
    assert len(stamped) == 4 and all(isinstance(t, int) for t in stamped)
    alerts = streaming.alert_table(str(tmp_path / "tables" / "alerts")).latest(spark)
    assert alerts.where("mid = 'a'").count() == 30


def test_a_job_needs_checkpoints(tmp_path):
    for command in ("dau", "compact", "reconcile"):
        with pytest.raises(SystemExit):
            app.arguments([command, "--tables", str(tmp_path)])
