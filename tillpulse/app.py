"""Start a streaming job, or print a report from the tables the jobs write.

    spark-submit tillpulse/app.py dau --brokers host:9092 --tables /shop/tables --checkpoints /shop/cp
    spark-submit tillpulse/app.py hours --metric dau --date 2024-01-15 --tables /shop/tables
    spark-submit tillpulse/app.py compact --tables /shop/tables --into /shop/tables-2
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillpulse import operators as ops, plans, sources, streaming
from tillpulse.operators import stamp_ingest
from tillpulse.plans.search import DEFAULT_DATE, PAGE_SIZE
from tillpulse.session import configure
from tillpulse.sinks import archive_logs
from tillpulse.sources import topics

RAW_TOPIC, CHANGE_TOPIC = "raw_log", "row_changes"
JOBS = ["ingest", "archive", "changes", "dau", "orders", "alerts", "sales"]
REPORTS = ["tiles", "hours", "search", "alerts-of-day", "provinces"]
UPKEEP = ["compact", "reconcile"]
TABLES = {
    "dau": streaming.dau_table, "orders": streaming.order_table, "users": streaming.user_table, "sales": streaming.sale_table,
    "alerts": streaming.alert_table, "alert_minutes": streaming.minute_table,
    "unmatched_lines": streaming.unmatched_table,
}


def job_writers(job: str, spark: SparkSession, args: argparse.Namespace) -> list:
    """The writers of a job: its own and, where it parses records, one for what could not be used."""
    where = {"brokers": args.brokers, "replay_dir": args.replay}
    checkpoint = f"{args.checkpoints}/{job}"

    def read(topic: str) -> DataFrame:
        return topics.topic_source(spark, topic, **where, options=dict(o.split("=", 1) for o in args.option))

    def with_rejects(writer, *parsed: DataFrame) -> list:
        rejected = [
            streaming.reject_job(p, f"{args.tables}/rejects/{job}-{i}", f"{checkpoint}-rejects-{i}")
            for i, p in enumerate(parsed)
        ]
        return [writer, *rejected]

    if job == "ingest":
        return [streaming.ingest_job(read(RAW_TOPIC), checkpoint, **where)]
    if job == "archive":
        stamped = stamp_ingest(read(RAW_TOPIC), F.unix_millis("arrival_ts"))
        return [archive_logs(stamped, f"{args.tables}/raw_log", checkpoint)]
    if job == "changes":
        parsed = sources.parse_change(read(CHANGE_TOPIC))
        return with_rejects(streaming.change_job(sources.accepted(parsed), checkpoint, **where), parsed)
    if job == "dau":
        parsed = sources.parse_startup(read(topics.STARTUP_TOPIC))
        table = streaming.dau_table(f"{args.tables}/dau")
        return with_rejects(streaming.dau_job(sources.accepted(parsed), table, checkpoint), parsed)
    if job == "alerts":
        parsed = sources.parse_event(read(topics.EVENT_TOPIC))
        panes = streaming.pane_table(f"{args.tables}/panes")
        alerts, minutes = (TABLES[t](f"{args.tables}/{t}") for t in ("alerts", "alert_minutes"))
        return with_rejects(streaming.alert_job(sources.accepted(parsed), panes, alerts, checkpoint, minutes), parsed)
    orders = sources.parse_order(read(topics.ORDER_TOPIC))
    if job == "orders":
        table = streaming.order_table(f"{args.tables}/orders")
        return with_rejects(streaming.order_job(sources.accepted(orders), table, checkpoint), orders)
    details, users = sources.parse_order_detail(read(topics.ORDER_DETAIL_TOPIC)), sources.parse_user(read(topics.USER_TOPIC))
    writer = streaming.sale_job(
        *[sources.accepted(p) for p in (orders, details, users)],
        streaming.user_table(f"{args.tables}/users"),
        streaming.sale_table(f"{args.tables}/sales"),
        checkpoint,
        F.current_date(),
        args.early,
        args.horizon,
        args.lateness,
        streaming.unmatched_table(f"{args.tables}/unmatched_lines"),
    )
    return with_rejects(writer, orders, details, users)


def report(name: str, spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The JSON documents of a report, one per row."""
    if name == "search":
        sales = streaming.sale_table(f"{args.tables}/sales").latest(spark)
        return plans.sale_search_document(sales, args.date or DEFAULT_DATE, args.keyword, args.page, args.size)
    day = args.date or str(dt.datetime.now(dt.timezone.utc).date())
    if name == "alerts-of-day":
        alerts = streaming.minute_table(f"{args.tables}/alert_minutes").latest(spark)
        found = alerts.where((F.col("day") == F.lit(day).cast("date")) & ~F.col("suppressed"))
        return ops.alert_documents(found).orderBy("alert_id").select(F.to_json(F.struct("*")))
    # The stored day stays as it is: a filter on it skips folders.
    startups = streaming.dau_table(f"{args.tables}/dau").latest(spark).withColumn("event_ts", F.timestamp_millis("ts"))
    orders = streaming.order_table(f"{args.tables}/orders").latest(spark)
    if name == "provinces":
        return ops.sales_by_province(orders, day).orderBy("province_id").select(F.to_json(F.struct("*")))
    if name == "tiles":
        return plans.kpi_document(plans.kpi_tiles(startups, orders, day))
    return plans.hourly_document(plans.hourly_compare(startups if args.metric == "dau" else orders, args.metric, day))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=JOBS + REPORTS + UPKEEP)
    parser.add_argument("--tables", required=True, help="folder of the keyed tables")
    parser.add_argument("--checkpoints", help="folder of the job checkpoints")
    parser.add_argument("--into", help="folder that compact or reconcile writes; the jobs go on with it")
    parser.add_argument("--brokers", help="Kafka brokers")
    parser.add_argument("--replay", help="folder of recorded topics, instead of brokers")
    parser.add_argument("--option", action="append", default=[], help="name=value for the topic source; may be repeated")
    parser.add_argument("--early", default="10 minutes", help="how long a line may come before its order")
    parser.add_argument("--horizon", default="1 day", help="how long a line may come after its order")
    parser.add_argument("--lateness", default="10 minutes", help="how far behind the newest arrival orders and lines are kept to be joined")
    parser.add_argument("--once", action="store_true", help="process what is there and stop")
    parser.add_argument("--date", help="day of a report")
    parser.add_argument("--metric", default="dau", choices=["dau", "order_amount"])
    parser.add_argument("--keyword", default="")
    parser.add_argument("--page", type=int, default=1)
    parser.add_argument("--size", type=int, default=PAGE_SIZE)
    args = parser.parse_args(argv)
    if args.command in JOBS and not args.checkpoints:
        parser.error("a job needs --checkpoints")
    if args.command in UPKEEP and not args.into:
        parser.error(f"{args.command} needs --into")
    return args


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str | None:
    args = arguments(argv)
    spark = configure(spark or SparkSession.builder.appName(f"tillpulse-{args.command}").getOrCreate())
    if args.command in REPORTS:
        documents = [row[0] for row in report(args.command, spark, args).toLocalIterator()]
        print(*documents, sep="\n")
        return "\n".join(documents)
    if args.command == "compact":
        for name, table in TABLES.items():
            table(f"{args.tables}/{name}").compact(spark, f"{args.into}/{name}")
        return None
    if args.command == "reconcile":
        orders, lines, users, sales = (TABLES[t](f"{args.tables}/{t}") for t in ("orders", "unmatched_lines", "users", "sales"))
        run = int(dt.datetime.now(dt.timezone.utc).timestamp())
        streaming.reconcile_lines(spark, orders, lines, users, sales, streaming.unmatched_table(args.into), F.current_date(), run)
        return None
    running = [streaming.start(w, available_now=args.once) for w in job_writers(args.command, spark, args)]
    if not args.once:
        spark.streams.awaitAnyTermination()
    for query in running:
        query.awaitTermination()
    return None


if __name__ == "__main__":
    main()
