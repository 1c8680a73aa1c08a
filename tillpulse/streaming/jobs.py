"""The streaming jobs. Each takes parsed streams and keyed tables and gives a writer to start.

Output happens in ``foreachBatch``; tables are keyed and a replayed batch overwrites its own folder, so a
restart from the checkpoint repeats no effect. Batches are named by the stream's own id, so that a stream
with a fresh checkpoint adds to a table. First startups and pane counts keep no state in the stream: every
batch writes its own, and they are put together when read, however late they come.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tillpulse.operators.alerts import (
    CHUNK_SECONDS,
    CONTENT,
    SIZE_SECONDS,
    SLIDE_SECONDS,
    alerts_per_minute,
    pane_counts,
    windows_from_panes,
)
from tillpulse.operators.devices import first_day_changes, first_startup, observed
from tillpulse.operators.ingest import route_cdc, route_logs, stamp_ingest
from tillpulse.operators.sales import enrich_user, late_sales, match_lines, waiting_lines, with_buyer
from tillpulse.session import written
from tillpulse.sinks.keyed import KeyedTable
from tillpulse.sinks.panes import PaneStore, hour_of
from tillpulse.sinks.rollup import Rollup, net_change
from tillpulse.sinks.topics import topic_sink
from tillpulse.sinks.waiting import LINE, ORDER, WaitingRows
from tillpulse.sources.records import rejects
from tillpulse.streaming.transforms import LINE_SIDE, ORDER_SIDE, join_order_detail_within, unmatched_lines

TRIGGER = "5 seconds"


def start(writer: DataStreamWriter, available_now: bool = False, every: str = TRIGGER) -> StreamingQuery:
    """Start a job: a micro-batch every five seconds, or all that is there and stop."""
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def _into(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int, str], object]) -> DataStreamWriter:
    """Write with ``each(batch, batch id, stream id)``."""
    source: list[str] = []

    def named(batch: DataFrame, batch_id: int) -> None:
        if not source:
            # Written when the stream first starts, and the same whenever it starts again from this checkpoint.
            source.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        each(batch, batch_id, source[0])

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(named)


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of a keyed table as a side of a join that sorts both sides. The planner takes the size of a table's compressed files for
    that of its rows, and adaptive execution does not take back a broadcast that was chosen by it: 4.86 million users, 15 MB
    of files, are 805 MB in the driver and in every executor."""
    return rows.hint("merge")


def ingest_job(
    raw: DataFrame, checkpoint: str, *, brokers: str | None = None, replay_dir: str | None = None
) -> DataStreamWriter:
    """Raw log lines (value, arrival_ts): stamp with the arrival time, route, send."""
    stamped = stamp_ingest(raw, F.unix_millis("arrival_ts"))
    return topic_sink(route_logs(stamped), checkpoint, producer="ingest", brokers=brokers, replay_dir=replay_dir)


def change_job(
    changes: DataFrame, checkpoint: str, *, brokers: str | None = None, replay_dir: str | None = None
) -> DataStreamWriter:
    """Database changes (parsed entries with arrival_ts): filter, flatten, send to the topic of their table."""
    return topic_sink(route_cdc(changes), checkpoint, producer="changes", brokers=brokers, replay_dir=replay_dir)


def reject_job(parsed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Records a parser could not use, with the reason."""
    writer = rejects(parsed).writeStream.format("json").option("path", path)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")


def dau_job(
    startups: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    tie_break: list[str] | None = None,
    counted: Callable[[int], object] = lambda rows: None,
    rollup: Rollup | None = None,
    devices: KeyedTable | None = None,
) -> DataStreamWriter:
    """First startups per device and day into the DAU table.

    The rows of a batch are observed as ``startups_in``; ``counted`` gets the number of first startups that
    it writes, seen by the write itself. A batch writes the earliest of its own; the table keeps the earliest of all.
    ``rollup`` gets the change that a batch makes to the active devices per day and hour, ``devices`` the first day of every device.
    """

    def each(batch: DataFrame, batch_id: int, source: str) -> None:
        seen, spark = Observation(), batch.sparkSession
        folder = table.upsert(first_startup(batch, tie_break).observe(seen, F.count(F.lit(1)).alias("rows")), batch_id, source)
        counted(seen.get["rows"])
        first = spark.read.schema(table.schema).parquet(folder)
        if rollup:
            change = net_change(*table.effect(first, batch_id, source), ["log_date", "log_hour"], {"dau": F.lit(1)})
            rollup.add(change, batch_id, source)
        if devices:
            devices.upsert(first_day_changes(first, devices.latest(spark, (source, batch_id))), batch_id, source)

    return _into(observed(startups, "startups_in"), "append", checkpoint, each)


def order_job(orders: DataFrame, table: KeyedTable, checkpoint: str, rollup: Rollup | None = None) -> DataStreamWriter:
    """Parsed orders into the order table. ``rollup`` gets the change that a batch makes to revenue and orders per day and hour: what a
    new version of an order adds, less what the version before it had added."""

    def each(batch: DataFrame, batch_id: int, source: str) -> None:
        folder = table.upsert(batch, batch_id, source)
        if rollup:
            rows = batch.sparkSession.read.schema(table.schema).parquet(folder)
            sums = {"amount": F.coalesce("total_amount", F.lit(0)), "orders": F.lit(1)}
            rollup.add(net_change(*table.effect(rows, batch_id, source), ["create_date", "create_hour"], sums), batch_id, source)

    return _into(orders, "append", checkpoint, each)


def alert_job(
    events: DataFrame, panes: PaneStore, alerts: KeyedTable, checkpoint: str, minutes: KeyedTable | None = None
) -> DataStreamWriter:
    """Pane counts into one store, the windows they touch into a table, and the alert of each minute into another.

    A window is written again whenever one of its panes changes, with ``suppressed`` telling whether a click has cleared
    the device meanwhile; readers keep the rows that are not suppressed. So is the alert of a minute, once per
    device and minute. All windows of a touched minute are worked out, so its alert comes from what the batch has written itself:
    a batch reads the hours of its own panes and windows and its own devices in them, and no table.
    """
    per_window, per_minute = SIZE_SECONDS // SLIDE_SECONDS, 60 // SLIDE_SECONDS

    def each(batch: DataFrame, batch_id: int, source: str) -> None:
        spark = batch.sparkSession
        counts = pane_counts(batch).persist()
        try:
            panes.add(counts, batch_id, source)
            of_minute = F.sequence(F.floor((F.col("pane") + 1) / per_minute), F.floor((F.col("pane") + per_window) / per_minute))
            touched = counts.select("mid", "pane").distinct().select("mid", F.explode(of_minute).alias("minute")).distinct().persist()
            first = F.col("minute") * per_minute - per_window
            inside = F.sequence(hour_of(first), hour_of(F.col("minute") * per_minute + per_minute - 2))
            device_hours = touched.select("mid", F.explode(inside).alias("hour")).distinct()
            hours = sorted(r["hour"] for r in device_hours.select("hour").distinct().collect())
            near = panes.read(spark, hours).join(device_hours, ["mid", "hour"], "left_semi").drop("hour", "source", "batch")
            windows = windows_from_panes(near, chunk=CHUNK_SECONDS).withColumn("minute", _minute())
            windows = windows.join(touched, ["mid", "minute"], "left_semi").withColumn("day", F.to_date("window_end"))
            folder = alerts.upsert(windows, batch_id, source)
            if minutes:
                rows = spark.read.schema(alerts.schema).parquet(folder)
                minutes.upsert(_minutes(rows, touched), batch_id, source)
            touched.unpersist()
        finally:
            counts.unpersist()

    return _into(events, "append", checkpoint, each)


def _minute() -> Column:
    return F.floor(F.unix_seconds("window_end") / 60)


def _minutes(windows: DataFrame, touched: DataFrame) -> DataFrame:
    """The alert of every device and minute of ``touched``; where a click has cleared all its windows, a row that says so."""
    found = alerts_per_minute(windows.where(~F.col("suppressed"))).withColumn("minute", _minute()).drop("alert_id")
    start = F.timestamp_seconds(F.col("minute") * 60)
    return touched.join(found, ["mid", "minute"], "left").select(
        F.concat_ws("_", "mid", F.col("minute").cast("string")).alias("alert_id"),
        "mid", "window_end", *CONTENT,
        F.col("window_end").isNull().alias("suppressed"),
        F.to_date(start).alias("day"),
    )


def sale_job(
    orders: DataFrame,
    details: DataFrame,
    users: DataFrame,
    user_table: KeyedTable,
    sale_table: KeyedTable,
    checkpoint: str,
    as_of: Column | str | dt.date,
    early: str = "10 minutes",
    horizon: str = "1 day",
    lateness: str = "10 minutes",
    unmatched_table: KeyedTable | None = None,
    every: int = 60,
) -> DataStreamWriter:
    """Orders, order lines and user changes into the sale table; lines whose order does not come in time into
    another, if one is given.

    One query for all three, so that users of a batch are stored before the sales of the same batch look them up. A line may arrive
    up to ``early`` before its order and up to ``horizon`` after it. What may still meet is kept in folders below the checkpoint
    and joined by the batch join, whose work is sorted and re-planned at run time: a store that looks up, counts and evicts row by row
    cannot take in a backlog of hundreds of millions of lines. No record is dropped as late; how long rows
    are kept follows from the older of the newest arrivals of orders and lines, less ``lateness``.
    """
    columns = {ORDER: ORDER_SIDE, LINE: LINE_SIDE, "user": user_table.columns()}
    tagged = [rows.select(F.lit(kind).alias("kind"), *columns[kind]) for kind, rows in zip(columns, (orders, details, users))]
    every_kind = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    waiting = WaitingRows(f"{checkpoint}/waiting", every_kind.schema, early, horizon, lateness, every)

    def each(batch: DataFrame, batch_id: int, source: str) -> None:
        spark = batch.sparkSession
        come = waiting.come(spark, batch_id)
        rows, ends = waiting.add(batch, batch_id)
        before = waiting.before(spark, batch_id, come)
        now = waiting.advance(spark, batch_id, ends)

        def of(kind: str, some: DataFrame) -> DataFrame:
            return some.where(F.col("kind") == kind).select(*columns[kind])

        user_table.upsert(of("user", rows), batch_id, source)
        new_orders, new_lines = of(ORDER, rows), of(LINE, rows)
        if unmatched_table:
            # Lines that no order to come can reach. Of earlier batches only those are left that the last batch could not tell.
            known, lines = (of(kind, before).unionByName(of(kind, rows)) for kind in (ORDER, LINE))
            beyond = lines.where(waiting.beyond(now))
            unmatched_table.upsert(unmatched_lines(known, beyond, early, horizon), batch_id, source)
        # Every pair once, when the later of the two comes.
        met = of(ORDER, before.where(waiting.near(ORDER, ends))).unionByName(new_orders)
        sales = join_order_detail_within(met, new_lines, early, horizon).unionByName(
            join_order_detail_within(new_orders, of(LINE, before.where(waiting.near(LINE, ends))), early, horizon)
        )
        # Buyers by the orders: the join is then needed once.
        buyers = _sorted(user_table.lookup(spark, met.select(F.col("user_id").alias("id"))))
        sale_table.upsert(enrich_user(sales, buyers, as_of), batch_id, source)

    return _into(every_kind, "append", checkpoint, each)


def reconcile_lines(
    spark: SparkSession,
    order_table: KeyedTable,
    unmatched_table: KeyedTable,
    user_table: KeyedTable,
    sale_table: KeyedTable,
    rest: KeyedTable,
    as_of: Column | str | dt.date,
    run: int = 0,
) -> None:
    """Order lines that have waited for their order: those whose order has come meanwhile become sales, however late; the others go
    to ``rest``, the unmatched table of the next run. A batch job, to be run every now and then; a repeated ``run``
    overwrites what it has written."""
    lines = unmatched_table.latest(spark)
    # Buyers join the orders, of which there are fewer than sales.
    needed = order_table.latest(spark).select("id", "order_status", "create_time", "user_id", "create_date", "arrival_ts")
    orders = with_buyer(needed, _sorted(user_table.latest(spark)), as_of)
    matched = written(match_lines(orders, lines), "late-lines-matched")
    sale_table.upsert(late_sales(matched), run, "late lines")
    rest.upsert(waiting_lines(matched), run, "late lines")
