"""Streaming jobs on small topics, batch by batch."""

import datetime as dt
import json
from random import Random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillpulse import operators as ops, session, sources, streaming
from tillpulse.sinks import KeyedTable, archive_logs, topics as topic_files
from tillpulse.sources.topics import topic_source
from tillpulse.streaming import jobs

BASE = dt.datetime(2024, 1, 10, 12, 0, 0)


class Topics:
    """Topic folders; every ``send`` adds one file."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def send(self, topic, *records):
        """Records as (arrival, dict or text)."""
        data = [(r if isinstance(r, str) else json.dumps(r), at) for at, r in records]
        df = self.spark.createDataFrame(data, "value string, arrival_ts timestamp_ntz").coalesce(1)
        df.selectExpr("value", "cast(arrival_ts as timestamp) arrival_ts").write.mode("append").json(
            f"{self.folder}/test/topic={topic}"
        )

    def read(self, topic):
        path = f"{self.folder}/test/topic={topic}"
        self.spark.createDataFrame([], "value string").write.mode("append").json(path)
        return topic_source(self.spark, topic, replay_dir=self.folder)


@pytest.fixture
def topics(spark, tmp_path):
    return Topics(spark, str(tmp_path / "topics"))


def run(writer):
    query = streaming.start(writer, available_now=True)
    query.awaitTermination()
    return query


def at(minutes=0.0, **more):
    return BASE + dt.timedelta(minutes=minutes, **more)


def ms(when):
    return int(when.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def startup(mid, when, uid="u"):
    return when, {"type": "startup", "mid": mid, "uid": uid, "ts": str(ms(when))}


def test_dau_job_over_batches(spark, topics, tmp_path):
    table = streaming.dau_table(str(tmp_path / "dau"))

    def go():
        parsed = sources.accepted(sources.parse_startup(topics.read("s")))
        return run(streaming.dau_job(parsed, table, str(tmp_path / "cp"), counted=written.append))

    written = []
    midnight = dt.datetime(2024, 1, 11)
    topics.send("s", startup("a", at(10), "late"), startup("a", at(20), "later"), startup("b", at(5)), (at(0), "broken"))
    query = go()
    observed = [p["observedMetrics"] for p in query.recentProgress if p["observedMetrics"]]
    assert (observed[0]["startups_in"]["rows"], written[0]) == (3, 2)
    # The earlier record comes later; another device starts on both sides of midnight.
    topics.send("s", startup("a", at(0), "first"), startup("c", midnight - dt.timedelta(seconds=1)), startup("c", midnight))
    go()
    # A record of the previous day, and one days later; then an earlier one that is days late still counts.
    topics.send("s", startup("d", at(30)), startup("e", midnight + dt.timedelta(days=3)))
    go()
    topics.send("s", startup("a", at(-30), "very late"))
    go()
    got = rows(table.latest(spark).select("log_date", "mid", "uid"), "log_date", "mid")
    ten, eleven, fourteen = (dt.date(2024, 1, d) for d in (10, 11, 14))
    assert got == [
        (ten, "a", "very late"), (ten, "b", "u"), (ten, "c", "u"), (ten, "d", "u"), (eleven, "c", "u"), (fourteen, "e", "u"),
    ]


@pytest.mark.parametrize("salts", [1, 3])
def test_first_seen_emits_each_device_once(spark, topics, tmp_path, salts):
    def go():
        parsed = sources.accepted(sources.parse_startup(topics.read("s")))
        out = streaming.first_seen_stream(parsed, salts=salts).select("log_date", "mid").writeStream.format("parquet")
        run(out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))

    topics.send("s", *[startup("a", at(i)) for i in range(9)])
    go()
    topics.send("s", *[startup("a", at(i)) for i in range(20)], startup("b", at(3)), startup("a", at(days=1)))
    go()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "log_date", "mid")
    assert got == [(dt.date(2024, 1, 10), "a"), (dt.date(2024, 1, 10), "b"), (dt.date(2024, 1, 11), "a")]


def order(order_id, when, user="u1"):
    return when, {"id": order_id, "create_time": "2024-01-10 12:00:00", "consignee_tel": "13812345678",
                  "order_status": "new", "user_id": user, "total_amount": "5.00"}


def line(line_id, order_id, when):
    return when, {"id": line_id, "order_id": order_id, "sku_id": "s", "sku_name": "ring", "order_price": "5.00"}


def user(user_id, when, level, birthday="2000-01-01"):
    return when, {"id": user_id, "login_name": "n", "user_level": level, "birthday": birthday, "gender": "F"}


def test_sale_job(spark, topics, tmp_path):
    people = streaming.user_table(str(tmp_path / "users"))
    sales = streaming.sale_table(str(tmp_path / "sales"))
    alone = streaming.unmatched_table(str(tmp_path / "alone"))

    def go():
        run(streaming.sale_job(
            sources.accepted(sources.parse_order(topics.read("o"))),
            sources.accepted(sources.parse_order_detail(topics.read("d"))),
            sources.accepted(sources.parse_user(topics.read("u"))),
            people, sales, str(tmp_path / "cp"), dt.date(2024, 1, 1), unmatched_table=alone,
        ))

    # Lines 5 and 20 minutes before their order, an order without lines so far, a user of the same batch.
    topics.send("d", line("l5", "o1", at(-5)), line("l20", "o1", at(-20)), line("same", "o2", at(0)))
    topics.send("o", order("o1", at(0)), order("o2", at(0), "u2"), order("o3", at(0), "nobody"), order("o4", at(0)))
    topics.send("u", user("u1", at(-60), "1"), user("u1", at(-1), "2"))
    go()
    assert rows(sales.latest(spark).select("order_detail_id", "user_level", "user_age"), "order_detail_id") == [
        ("l5", "2", 24), ("same", None, None),
    ]
    # Later lines of known orders in two more batches, a new level for the user, a repeated line.
    topics.send("d", line("two", "o1", at(5)), line("x", "o3", at(6)), line("same", "o2", at(7)))
    topics.send("u", user("u1", at(5), "3"), user("u2", at(6), "9"))
    go()
    topics.send("d", line("three", "o1", at(9)), line("alone", "o9", at(9)))
    go()
    got = rows(sales.latest(spark).select("order_detail_id", "order_id", "user_id", "user_level", "dt"), "order_detail_id")
    day = dt.date(2024, 1, 10)
    assert got == [
        ("l5", "o1", "u1", "2", day),
        ("same", "o2", "u2", "9", day),
        ("three", "o1", "u1", "3", day),
        ("two", "o1", "u1", "3", day),
        ("x", "o3", "nobody", None, day),
    ]
    # Later arrivals tell that no order can come any more: one line was too early, one has no order.
    for days in (2, 4):
        topics.send("d", line(f"far{days}", f"f{days}", at(days=days)))
        topics.send("o", order(f"f{days}", at(days=days)))
        go()
    assert rows(alone.latest(spark).select("order_detail_id", "order_id"), "order_detail_id") == [("alone", "o9"), ("l20", "o1")]
    assert sales.latest(spark).count() == 7
    # The batch job finds the order of the line that was too early, and once it is there that of the other.
    orders, rest = streaming.order_table(str(tmp_path / "orders")), streaming.unmatched_table(str(tmp_path / "rest"))
    run(streaming.order_job(sources.accepted(sources.parse_order(topics.read("o"))), orders, str(tmp_path / "cp-orders")))
    streaming.reconcile_lines(spark, orders, alone, people, sales, rest, dt.date(2024, 1, 1))
    assert rows(rest.latest(spark).select("order_detail_id")) == [("alone",)] and sales.latest(spark).count() == 8
    assert sales.latest(spark).where("order_detail_id = 'l20'").select("order_id", "user_level").first() == ("o1", "3")


def test_sale_job_over_rounds_equals_all_pairs(spark, topics, tmp_path):
    """Orders and lines that meet within a batch, over batches and over rounds of two batches; no row by row state store."""
    people, sales = streaming.user_table(str(tmp_path / "users")), streaming.sale_table(str(tmp_path / "sales"))
    alone, random = streaming.unmatched_table(str(tmp_path / "alone")), Random(7)
    orders, lines, steps = {}, {}, 6
    topics.send("u", user("u1", at(-60), "1"))
    for step in range(steps):
        for i in range(12):
            orders[f"o{step}-{i}"] = 20 * step + random.uniform(0, 20)
            # A line of an order of this, an earlier or a later batch, or of none.
            lines[f"l{step}-{i}"] = (f"o{step + random.choice([-2, -1, 0, 0, 1])}-{i}", 20 * step + random.uniform(0, 20))
        topics.send("o", *[order(k, at(m), "u1") for k, m in orders.items() if k.startswith(f"o{step}-")])
        topics.send("d", *[line(k, o, at(m)) for k, (o, m) in lines.items() if k.startswith(f"l{step}-")])
        run(streaming.sale_job(
            sources.accepted(sources.parse_order(topics.read("o"))), sources.accepted(sources.parse_order_detail(topics.read("d"))),
            sources.accepted(sources.parse_user(topics.read("u"))), people, sales, str(tmp_path / "cp"), dt.date(2024, 1, 1),
            "10 minutes", "30 minutes", "0 minutes", alone, every=2,
        ))
    met = {k for k, (o, m) in lines.items() if o in orders and orders[o] - 10 <= m <= orders[o] + 30}
    come = min(max(orders.values()), max(m for _, m in lines.values()))
    beyond = {k for k, (_, m) in lines.items() if k not in met and m + 10 < come}
    assert len(met) > 30 and len(beyond) > 10
    assert sorted(r[0] for r in rows(sales.latest(spark).select("order_detail_id"))) == sorted(met)
    assert sorted(r[0] for r in rows(alone.latest(spark).select("order_detail_id"))) == sorted(beyond)
    assert sales.latest(spark).where("user_level = '1'").count() == len(met)
    written = spark.read.parquet(str(tmp_path / "sales" / "batches"))
    assert written.count() == len(met) and written.select("batch").distinct().count() == steps
    assert not (tmp_path / "cp" / "state").exists()


def event(mid, evid, when, uid="u", item=1):
    return when, {"mid": mid, "uid": uid, "evid": evid, "itemid": item, "ts": ms(when)}


def test_alert_job_equals_the_batch_form(spark, topics, tmp_path):
    panes, alerts = streaming.pane_table(str(tmp_path / "panes")), streaming.alert_table(str(tmp_path / "alerts"))
    edge = dt.datetime(2024, 1, 10, 23, 59, 50)
    slices = [
        [event("a", "coupon", at(0)), event("a", "addCart", at(1)), event("b", "coupon", at(0)), event("d", None, at(2))],
        # The click comes a batch later and clears windows already written; new counts for a pane.
        [event("b", "clickItem", at(4)), event("a", "coupon", at(0), "u2", 2), event("a", "coupon", at(3))],
        [event("a", "coupon", edge), event("c", "coupon", edge + dt.timedelta(seconds=15))],
    ]
    for part in slices:
        topics.send("e", *part)
        parsed = sources.accepted(sources.parse_event(topics.read("e")))
        run(streaming.alert_job(parsed, panes, alerts, str(tmp_path / "cp")))
    whole = spark.createDataFrame([(json.dumps(r),) for part in slices for _, r in part], "value string")
    want = ops.coupon_alerts(sources.accepted(sources.parse_event(whole)))
    columns = ["mid", "window_end", "uids", "item_ids", "events"]
    got = alerts.latest(spark).where(~F.col("suppressed")).select(*columns)
    assert rows(got, "mid", "window_end") == rows(want.select(*columns), "mid", "window_end")
    assert got.count() > 100


def test_ingest_archive_and_orders(spark, topics, tmp_path):
    raw = [(at(0), {"type": "startup", "mid": "a", "n": 1}), (at(days=1), {"mid": "b", "ts": 5}), (at(1), "broken")]
    topics.send("raw", *raw)
    run(streaming.ingest_job(topics.read("raw"), str(tmp_path / "cp1"), replay_dir=str(tmp_path / "routed")))
    sent = spark.read.json(str(tmp_path / "routed" / "ingest-0")).select("topic", "value")
    assert rows(sent, "topic", "value") == [
        ("event_log", "broken"),
        ("event_log", '{"mid":"b","ts":%d}' % ms(at(days=1))),
        ("startup_log", '{"mid":"a","n":1,"type":"startup","ts":%d}' % ms(at(0))),
    ]
    run(archive_logs(topics.read("raw"), str(tmp_path / "archive"), str(tmp_path / "cp2")))
    kept = spark.read.text(str(tmp_path / "archive")).groupBy("dt").count()
    assert rows(kept, "dt") == [(dt.date(2024, 1, 10), 2), (dt.date(2024, 1, 11), 1)]
    parsed = sources.parse_event(topics.read("raw"))
    run(streaming.reject_job(parsed, str(tmp_path / "rejects"), str(tmp_path / "cp4")))
    bad = spark.read.json(str(tmp_path / "rejects")).select("reject_reason")
    assert rows(bad, "reject_reason") == [("missing or invalid ts",), ("not a JSON record",)]
    table = streaming.order_table(str(tmp_path / "orders"))
    topics.send("o", order("o1", at(0)), order("o1", at(1), "u7"), (at(2), {"id": "o2"}))
    run(streaming.order_job(sources.accepted(sources.parse_order(topics.read("o"))), table, str(tmp_path / "cp3")))
    assert table.latest(spark).count() == 1


def test_recorded_topics_are_compressed_in_files_that_many_tasks_read(spark, topics, tmp_path, monkeypatch):
    monkeypatch.setattr(topic_files, "FILE_RECORDS", 2)
    topics.send("raw", *[(at(i), {"type": "startup", "mid": f"m{i}"}) for i in range(5)])
    run(streaming.ingest_job(topics.read("raw"), str(tmp_path / "cp"), replay_dir=str(tmp_path / "routed")))
    files = [f for f in (tmp_path / "routed" / "ingest-0").rglob("part-*") if not f.name.endswith(".crc")]
    assert len(files) == 3 and all(f.name.endswith(".json.gz") for f in files)
    seen = topic_source(spark, "startup_log", replay_dir=str(tmp_path / "routed"))
    out = seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp2"))
    run(out)
    mids = spark.read.parquet(str(tmp_path / "out")).select(F.get_json_object("value", "$.mid").alias("mid"), "arrival_ts")
    assert rows(mids.select("mid"), "mid") == [(f"m{i}",) for i in range(5)] and mids.where("arrival_ts is null").count() == 0


def test_progress_of_two_batches(spark, topics, tmp_path):
    log, table, written = streaming.ProgressLog(), streaming.dau_table(str(tmp_path / "dau")), []
    spark.streams.addListener(log)
    try:
        for part in ([startup("a", at(1)), startup("a", at(2))], [startup("b", at(3))]):
            topics.send("s", *part)
            parsed = sources.accepted(sources.parse_startup(topics.read("s")))
            run(streaming.dau_job(parsed, table, str(tmp_path / "cp"), counted=written.append))
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(log)
    assert written == [1, 1]
    assert log.write(spark, str(tmp_path / "progress")) == 2 and log.write(spark, str(tmp_path / "progress")) == 0
    got = spark.read.parquet(str(tmp_path / "progress")).orderBy("batch").collect()
    assert [(r["batch"], r["rows_in"], json.loads(r["observed"]["startups_in"])["rows"]) for r in got] == [(0, 2, 2), (1, 1, 1)]
    assert all(r["batch_ms"] >= r["write_ms"] > 0 for r in got)


def test_every_stateful_operator_evicts(spark, topics):
    parsed = sources.accepted(sources.parse_event(topics.read("e")))
    startups = sources.accepted(sources.parse_startup(topics.read("s")))
    orders = sources.accepted(sources.parse_order(topics.read("o")))
    details = sources.accepted(sources.parse_order_detail(topics.read("d")))
    for stream in (
        streaming.first_startup_stream(startups),
        streaming.first_seen_stream(startups),
        streaming.coupon_panes_stream(parsed),
        streaming.join_order_detail_stream(orders, details),
    ):
        assert stream.isStreaming and "EventTimeWatermark" in stream._jdf.queryExecution().analyzed().toString()


def test_broker_or_folder(spark):
    with pytest.raises(ValueError):
        topic_source(spark, "t")
    with pytest.raises(ValueError):
        topic_source(spark, "t", brokers="b:9092", replay_dir="/x")


def test_buyers_are_never_sent_whole(spark, topics, tmp_path, monkeypatch):
    """The files of a user table are a fiftieth of its rows, so a broadcast must not be chosen by their size."""
    people, sales = streaming.user_table(str(tmp_path / "users")), streaming.sale_table(str(tmp_path / "sales"))
    orders, lines = streaming.order_table(str(tmp_path / "orders")), streaming.unmatched_table(str(tmp_path / "lines"))
    plans, upsert = [], KeyedTable.upsert

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(KeyedTable, "upsert", lambda table, df, *a: upsert(table, noted(df) if table is sales else df, *a))
    monkeypatch.setattr(jobs, "written", lambda df, purpose: session.written(noted(df), purpose))
    topics.send("u", user("u1", at(-60), "1"))
    topics.send("o", order("o1", at(0)), order("o2", at(0), "nobody"))
    topics.send("d", line("a", "o1", at(1)), line("b", "o2", at(1)))
    run(streaming.sale_job(
        sources.accepted(sources.parse_order(topics.read("o"))), sources.accepted(sources.parse_order_detail(topics.read("d"))),
        sources.accepted(sources.parse_user(topics.read("u"))), people, sales, str(tmp_path / "cp"), dt.date(2024, 1, 1),
    ))
    run(streaming.order_job(sources.accepted(sources.parse_order(topics.read("o"))), orders, str(tmp_path / "cp-orders")))
    late = [(line, of, "s", "ring", 5.0, at(days=3)) for line, of in (("c", "o1"), ("d", "o2"), ("e", "o9"))]
    lines.upsert(spark.createDataFrame(late, lines.schema), 0)
    streaming.reconcile_lines(spark, orders, lines, people, sales, streaming.unmatched_table(str(tmp_path / "rest")), dt.date(2024, 1, 1))
    # The batch of the stream and the match of the late lines; the last one only writes what has matched.
    assert len(plans) == 3 and all("SortMergeJoin [user_id" in p and "BroadcastHashJoin [user_id" not in p for p in plans[:2])
    got = rows(sales.latest(spark).select("order_detail_id", "user_level"), "order_detail_id")
    assert got == [("a", "1"), ("b", None), ("c", "1"), ("d", None)]
