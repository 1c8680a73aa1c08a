"""Streaming jobs replayed over the test tables.

Each query writes the table's records as topic folders in two slices of time and runs the job after each
slice, the second time from the checkpoint of the first. The result is the table the job has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillpulse import operators as ops, plans, queries as q, sources, streaming
from tillpulse.operators import stamp_ingest
from tillpulse.queries import query
from tillpulse.session import shared_dir
from tillpulse.sinks import archive_logs, record_topics
from tillpulse.sources import tables as t, topics

# Between the two slices of the event table.
EVENT_SPLIT = "2024-01-16"
# Slices are replayed as a whole, so time order inside a slice is not kept.
REPLAY_LATENESS = "40 days"


def _publish(rows: DataFrame, topic: str, replay_dir: str) -> None:
    """Append records (value, arrival_ts) to a topic folder."""
    record_topics(rows.select("value", "arrival_ts").write.mode("append"), f"{replay_dir}/published/topic={topic}")


def _source(spark: SparkSession, topic: str, replay_dir: str) -> DataFrame:
    return topics.topic_source(spark, topic, replay_dir=replay_dir)


def _recorded(spark: SparkSession, replay_dir: str) -> DataFrame:
    """Everything sent so far, with its topic."""
    every = spark.read.schema(topics.REPLAY_SCHEMA).json(f"{replay_dir}/*/topic=*")
    topic = F.regexp_extract(F.input_file_name(), "/topic=([^/]+)/", 1)
    return every.select(topic.alias("topic"), "value", "arrival_ts")


def _json_rows(df: DataFrame, arrival: Column, fields: list[str]) -> DataFrame:
    record = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    return df.select(F.to_json(record).alias("value"), arrival.alias("arrival_ts"))


def _run(spark: SparkSession, writer_of: Callable[[], object]) -> None:
    """Run a job over what is there. State is kept in no more partitions than there are cores: a stream
    fixes their number when it first starts, and each one costs a store of its own in every batch."""
    name = "spark.sql.shuffle.partitions"
    configured = spark.conf.get(name)
    spark.conf.set(name, str(min(int(configured), spark.sparkContext.defaultParallelism)))
    try:
        streaming.start(writer_of(), available_now=True).awaitTermination()
    finally:
        spark.conf.set(name, configured)


def _event_slices(df: DataFrame) -> list[DataFrame]:
    split = F.lit(EVENT_SPLIT).cast("timestamp")
    return [df.where(F.col("arrival_ts") < split), df.where(F.col("arrival_ts") >= split)]


STARTUP_COLUMNS = ["mid", "uid", "os", "area", "ts"]


def _startup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    startups = t.startup_log(t.table(spark, sf_dir, "events"))
    return _json_rows(startups, F.col("event_ts"), STARTUP_COLUMNS)


def _parsed_startups(spark: SparkSession, replay: str) -> DataFrame:
    return sources.accepted(sources.parse_startup(_source(spark, topics.STARTUP_TOPIC, replay)))


@query
def stream_first_startup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_dir(spark, "first-startup")
    table = streaming.dau_table(f"{work}/dau")
    for part in _event_slices(_startup_rows(spark, sf_dir)):
        _publish(part, topics.STARTUP_TOPIC, f"{work}/topics")
        _run(spark, lambda: streaming.dau_job(
            _parsed_startups(spark, f"{work}/topics"), table, f"{work}/checkpoint"
        ))
    return table.latest(spark).select("mid", "uid", "os", "area", "ts", "log_date", "log_hour")


def _startup_tables(spark: SparkSession, sf_dir: str, purpose: str, late: bool = False, **tables) -> None:
    """The device job over the two slices, the later one first if ``late``."""
    work = shared_dir(spark, purpose)
    parts = _event_slices(_startup_rows(spark, sf_dir))
    for part in parts[::-1] if late else parts:
        _publish(part, topics.STARTUP_TOPIC, f"{work}/topics")
        _run(spark, lambda: streaming.dau_job(
            _parsed_startups(spark, f"{work}/topics"), streaming.dau_table(f"{work}/dau"), f"{work}/checkpoint", **tables
        ))


@query
def dau_hourly_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices by hour of two days, from the sums that the stream keeps. The first startups of half of the days come late."""
    rollup = streaming.dau_rollup(shared_dir(spark, "dau-rollup"))
    _startup_tables(spark, sf_dir, "dau-rollup-job", late=True, rollup=rollup)
    kept = rollup.compact(spark, shared_dir(spark, "dau-rollup-compacted")).totals(spark)
    return plans.fill_hours(plans.hourly_from_totals(kept, q.DEVICE_DAY, "log_date", "log_hour", "dau")).withColumns(
        {c: F.col(c).cast("bigint") for c in ("today", "yesterday")}
    )


@query
def new_devices_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New devices per day from the table of first days, which learns of the earlier half of the days last."""
    devices = streaming.device_table(shared_dir(spark, "devices"))
    _startup_tables(spark, sf_dir, "devices-job", late=True, devices=devices)
    return ops.new_devices_known(devices.compact(spark, shared_dir(spark, "devices-compacted")).latest(spark))


@query
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplicating form: which devices were seen on which day, each emitted once."""
    work = shared_dir(spark, "first-seen")
    for part in _event_slices(_startup_rows(spark, sf_dir)):
        _publish(part, topics.STARTUP_TOPIC, f"{work}/topics")
        _run(spark, lambda: streaming.first_seen_stream(_parsed_startups(spark, f"{work}/topics"), REPLAY_LATENESS)
             .select("log_date", "mid").writeStream.format("parquet").option("path", f"{work}/seen")
             .option("checkpointLocation", f"{work}/checkpoint").outputMode("append"))
    return spark.read.schema("log_date date, mid string").parquet(f"{work}/seen")


def _raw_slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return _event_slices(q.log_lines(spark, sf_dir))


@query
def stream_log_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_dir(spark, "archive")
    for part in _raw_slices(spark, sf_dir):
        _publish(part, "raw", f"{work}/topics")
        _run(spark, lambda: archive_logs(
            stamp_ingest(_source(spark, "raw", f"{work}/topics"), F.unix_millis("arrival_ts")), f"{work}/archive", f"{work}/checkpoint"
        ))
    lines = spark.read.text(f"{work}/archive")
    r = F.from_json("value", "event_id bigint, type string, mid string, ts bigint")
    return lines.select(F.to_date("dt").alias("dt"), r.alias("r")).select("dt", "r.*")


@query
def stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines stamped, routed and sent to two topics."""
    work = shared_dir(spark, "topics")
    for part in _raw_slices(spark, sf_dir):
        _publish(part, "raw", f"{work}/raw")
        _run(spark, lambda: streaming.ingest_job(
            _source(spark, "raw", f"{work}/raw"), f"{work}/checkpoint", replay_dir=f"{work}/topics"
        ))
    sent = _recorded(spark, f"{work}/topics")
    r = F.from_json("value", "event_id bigint, ts bigint")
    return sent.select("topic", r.alias("r")).select("topic", "r.*")


@query
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database changes as records of one topic, routed to the topics of their tables."""
    work = shared_dir(spark, "changes")
    entries = q.change_entries(spark, sf_dir)
    record = F.struct("entry_type", "event_type", "table_name", "rows")
    sent = entries.select(F.to_json(record).alias("value"), F.current_timestamp().alias("arrival_ts"), "table_name")
    for part in (sent.where("table_name = 'order_info'"), sent.where("table_name != 'order_info'")):
        _publish(part, "changes", f"{work}/raw")
        _run(spark, lambda: streaming.change_job(
            sources.accepted(sources.parse_change(_source(spark, "changes", f"{work}/raw"))),
            f"{work}/checkpoint", replay_dir=f"{work}/topics",
        ))
    routed = _recorded(spark, f"{work}/topics")
    return routed.select("topic", *[F.get_json_object("value", f"$.{f}").alias(f) for f in q.CHANGE_FIELDS])


ORDER_COLUMNS = ["id", "province_id", "consignee_tel", "order_status", "user_id", "total_amount", "create_time"]


def _arrival(key: Column) -> Column:
    """Even keys arrive in the first hour of one day, odd keys in the first hour of the next."""
    seconds = (key % 2) * 86400 + key % 3600 + F.lit(1704067200)
    return F.timestamp_seconds(seconds)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.order_info(t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "customer"))
    return _json_rows(orders, _arrival(F.col("id").cast("bigint")), ORDER_COLUMNS)


def _two_days(df: DataFrame) -> list[DataFrame]:
    next_day = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return [df.where(F.col("arrival_ts") < next_day), df.where(F.col("arrival_ts") >= next_day)]


def _parsed_orders(spark: SparkSession, replay: str) -> DataFrame:
    return sources.accepted(sources.parse_order(_source(spark, topics.ORDER_TOPIC, replay)))


def _order_columns(df: DataFrame) -> DataFrame:
    return df.select(*ORDER_COLUMNS, "create_date", "create_hour").withColumn(
        "total_amount", F.col("total_amount").cast("double")
    )


@query
def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_dir(spark, "orders")
    table = streaming.order_table(f"{work}/orders")
    for part in _two_days(_order_rows(spark, sf_dir)):
        _publish(part, topics.ORDER_TOPIC, f"{work}/topics")
        _run(spark, lambda: streaming.order_job(_parsed_orders(spark, f"{work}/topics"), table, f"{work}/checkpoint"))
    return _order_columns(table.latest(spark))


@query
def order_hourly_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by hour of two days, from the sums that the order job keeps. Every order comes twice, first with twice its amount;
    half of the first versions come after the second ones and count for nothing."""
    work = shared_dir(spark, "order-rollup")
    rollup, table = streaming.order_rollup(f"{work}/sums"), streaming.order_table(f"{work}/orders")
    orders = t.order_info(t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "customer"))

    def version(rows: DataFrame, seconds: int) -> DataFrame:
        return _json_rows(rows, F.timestamp_seconds(F.lit(1704067200 + seconds)), ORDER_COLUMNS)

    doubled = version(orders.withColumn("total_amount", F.col("total_amount") * 2), 0)
    final, key = version(orders, 60), F.get_json_object("value", "$.id").cast("bigint")
    for wanted in (key % 2 == 0, key % 2 == 1):
        part = doubled.where(wanted).unionByName(final.where(~wanted))
        _publish(part, topics.ORDER_TOPIC, f"{work}/topics")
        _run(spark, lambda: streaming.order_job(
            _parsed_orders(spark, f"{work}/topics"), table, f"{work}/checkpoint", rollup
        ))
    return plans.fill_hours(plans.hourly_from_totals(rollup.totals(spark), q.ORDER_DAY, "create_date", "create_hour", "amount"))


def _run_alerts(spark: SparkSession, sf_dir: str, work: str, alerts, minutes=None) -> None:
    panes = streaming.pane_table(f"{work}/panes")
    events = t.event_log(t.table(spark, sf_dir, "events"))
    rows = _json_rows(events, F.col("event_ts"), ["mid", "uid", "evid", "itemid", "ts"])
    for part in _event_slices(rows):
        _publish(part, topics.EVENT_TOPIC, f"{work}/topics")
        _run(spark, lambda: streaming.alert_job(
            sources.accepted(sources.parse_event(_source(spark, topics.EVENT_TOPIC, f"{work}/topics"))),
            panes, alerts, f"{work}/checkpoint", minutes,
        ))


@query
def stream_coupon_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_dir(spark, "alerts")
    alerts = streaming.alert_table(f"{work}/alerts")
    _run_alerts(spark, sf_dir, work, alerts)
    return q._alert_text(alerts.latest(spark).where(~F.col("suppressed")))


@query
def stream_alerts_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_dir(spark, "minutes")
    minutes = streaming.minute_table(f"{work}/minutes")
    _run_alerts(spark, sf_dir, work, streaming.alert_table(f"{work}/alerts"), minutes)
    return q._alert_text(minutes.latest(spark).where(~F.col("suppressed")), "alert_id")


@query
def stream_sale_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines arrive from four minutes before to three minutes after their order."""
    work = shared_dir(spark, "sales")
    replay = f"{work}/topics"
    users_table, sales_table = streaming.user_table(f"{work}/users"), streaming.sale_table(f"{work}/sales")
    details = t.order_detail(t.table(spark, sf_dir, "lineitem"), t.table(spark, sf_dir, "part"), ("order_price",))
    key = F.col("order_id").cast("bigint")
    line = F.split_part("id", F.lit("-"), F.lit(2)).cast("bigint")
    at = F.timestamp_seconds(F.unix_seconds(_arrival(key)) + line * 60 - 300)
    line_rows = _json_rows(details, at, ["id", "order_id", "sku_id", "sku_name", "order_price"])
    users = t.user_info(t.table(spark, sf_dir, "customer"))
    user_fields = ["id", "login_name", "user_level", "birthday", "gender"]
    _publish(_json_rows(users, F.lit("2023-12-31").cast("timestamp"), user_fields), topics.USER_TOPIC, replay)
    for orders_part, lines_part in zip(_two_days(_order_rows(spark, sf_dir)), _two_days(line_rows), strict=True):
        _publish(orders_part, topics.ORDER_TOPIC, replay)
        _publish(lines_part, topics.ORDER_DETAIL_TOPIC, replay)
        _run(spark, lambda: streaming.sale_job(
            _parsed_orders(spark, replay),
            sources.accepted(sources.parse_order_detail(_source(spark, topics.ORDER_DETAIL_TOPIC, replay))),
            sources.accepted(sources.parse_user(_source(spark, topics.USER_TOPIC, replay))),
            users_table, sales_table, f"{work}/checkpoint", q.AS_OF,
        ))
    return q._age_as_double(sales_table.latest(spark).drop("arrival_ts", "order_arrival_ts"))


@query
def upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, a replay of the second one, a compaction, and a last batch on top of it."""
    work = shared_dir(spark, "upsert")
    table = streaming.user_table(f"{work}/users")
    users = t.user_info(t.table(spark, sf_dir, "customer")).withColumn("arrival_ts", F.lit("2024-01-01").cast("timestamp"))
    odd = users.where(F.col("id").cast("bigint") % 2 == 1)
    table.upsert(users, 0)
    table.upsert(odd.withColumn("user_level", F.lit("1")), 1)
    table.upsert(odd.withColumn("user_level", F.lit("1")), 1)
    table = table.compact(spark, f"{work}/compacted")
    table.upsert(odd.where(F.col("id").cast("bigint") % 3 == 1).withColumn("user_level", F.lit("2")), 2)
    return table.latest(spark).drop("arrival_ts")


def _restarted(spark: SparkSession, sf_dir: str, compact: bool) -> DataFrame:
    """Two batches of a stream, then a stream with a fresh checkpoint whose batches have the same numbers: users that
    are new or have changed. Half of the users come with the first stream."""
    work = shared_dir(spark, "restart")
    table = streaming.user_table(f"{work}/users")
    users = t.user_info(t.table(spark, sf_dir, "customer")).withColumn("arrival_ts", F.lit("2024-01-01").cast("timestamp"))
    key = F.col("id").cast("bigint") % 4
    table.upsert(users.where(key == 0), 0, "first")
    table.upsert(users.where(key == 1), 1, "first")
    if compact:
        table = table.compact(spark, f"{work}/compacted")
    table.upsert(users.where(key.isin(0, 2)).withColumn("user_level", F.lit("new")), 0, "second")
    table.upsert(users.where(key == 3), 1, "second")
    return table.latest(spark).drop("arrival_ts")


@query
def upsert_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restarted(spark, sf_dir, compact=True)


@query
def upsert_restart_uncompacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restarted(spark, sf_dir, compact=False)


@query
def stream_order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of every order, two in the first batch and one in the second; the later ones are smaller as text."""
    work = shared_dir(spark, "order-changes")
    table = streaming.order_table(f"{work}/orders")
    orders = t.order_info(t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "customer"))

    def version(status: str, seconds: int) -> DataFrame:
        at = F.timestamp_seconds(F.lit(1704067200 + seconds))
        return _json_rows(orders.withColumn("order_status", F.lit(status)), at, ORDER_COLUMNS)

    third = version("1", 60).where(F.get_json_object("value", "$.id").cast("bigint") % 2 == 0)
    for part in (version("9", 0).unionByName(version("5", 1)), third):
        _publish(part, topics.ORDER_TOPIC, f"{work}/topics")
        _run(spark, lambda: streaming.order_job(_parsed_orders(spark, f"{work}/topics"), table, f"{work}/checkpoint"))
    return _order_columns(table.latest(spark)).select("id", "order_status", "create_date", "create_hour")


@query
def sale_late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that come two days after their order. The stream has given them up; orders divisible by seven are not there
    even now, so their lines go on waiting."""
    work = shared_dir(spark, "late-lines")
    orders = streaming.order_table(f"{work}/orders")
    lines, rest = streaming.unmatched_table(f"{work}/unmatched"), streaming.unmatched_table(f"{work}/rest")
    users, sales = streaming.user_table(f"{work}/users"), streaming.sale_table(f"{work}/sales")
    day = F.lit("2024-01-01").cast("timestamp")
    key = F.col("id").cast("bigint")
    empty = [F.lit(None).cast("string").alias(f) for f in orders.columns()]
    known = t.order_info(t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "customer")).where(key % 7 != 0)
    known = known.withColumn("arrival_ts", day)
    missing = [c for f, c in zip(orders.columns(), empty) if f not in known.columns]
    orders.upsert(known.select("*", *missing), 0)
    people = t.user_info(t.table(spark, sf_dir, "customer")).withColumn("arrival_ts", day)
    users.upsert(people, 0)
    details = t.order_detail(t.table(spark, sf_dir, "lineitem"), t.table(spark, sf_dir, "part"), ("order_price",))
    late = details.withColumnRenamed("id", "order_detail_id").withColumns({
        "sku_price": F.col("order_price").cast("double"), "arrival_ts": day + F.expr("interval 2 days"),
    })
    lines.upsert(late, 0)
    for run in (0, 0):
        streaming.reconcile_lines(spark, orders, lines, users, sales, rest, q.AS_OF, run)
    sold = q._age_as_double(sales.latest(spark).drop("arrival_ts", "order_arrival_ts")).withColumn("waiting", F.lit(False))
    waiting = rest.latest(spark).select("order_detail_id", "order_id", "sku_id", "sku_name", "sku_price").withColumn("waiting", F.lit(True))
    return sold.unionByName(waiting, allowMissingColumns=True)
