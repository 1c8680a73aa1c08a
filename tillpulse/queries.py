"""Queries over the test tables, by name. Each takes (spark, folder of the tables)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillpulse import operators as ops, plans, sources
from tillpulse.functions.scalars import age_bucket, age_years
from tillpulse.session import configure
from tillpulse.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]

DEVICE_DAY = "2024-01-15"
ORDER_DAY = "1998-06-15"
AS_OF = dt.date(2024, 1, 1)
KEYWORD = "small ring"

_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _registry[fn.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    import tillpulse.stream_queries  # noqa: F401  registers the streaming ones

    return dict(_registry)


# --- inputs -----------------------------------------------------------------


def _startups(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    return t.startup_log(t.table(spark, sf_dir, "events"), since, until)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.event_log(t.table(spark, sf_dir, "events"))


def _orders(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    return t.order_info(t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "customer"), since, until)


def _details(spark: SparkSession, sf_dir: str, values: tuple[str, ...] = ("order_price", "sku_num")) -> DataFrame:
    return t.order_detail(t.table(spark, sf_dir, "lineitem"), t.table(spark, sf_dir, "part"), values)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.user_info(t.table(spark, sf_dir, "customer"))


def _sales(
    spark: SparkSession, sf_dir: str, day: str | None = None, values: tuple[str, ...] = ("order_price",)
) -> DataFrame:
    sales = ops.join_order_detail(_orders(spark, sf_dir, day, day), _details(spark, sf_dir, values))
    return ops.enrich_user(sales, _users(spark, sf_dir), AS_OF)


def _age_as_double(sales: DataFrame) -> DataFrame:
    """For comparing results: an integer column with NULLs turns into floats in some clients only."""
    return sales.withColumn("user_age", F.col("user_age").cast("double"))


def _day_before(day: str) -> str:
    return str(dt.date.fromisoformat(day) - dt.timedelta(days=1))


# --- devices ----------------------------------------------------------------


@query
def first_startup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_startup(_startups(spark, sf_dir), ["event_id"]).drop("event_ts")


@query
def exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Startups of devices that were not on the roster by noon of their day."""
    startups = _startups(spark, sf_dir)
    seen = ops.roster(startups.where(F.col("log_hour") < "12"))
    return ops.exclude_seen(startups, seen).drop("event_ts")


@query
def device_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.roster(_startups(spark, sf_dir))


@query
def dau_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dau_total(_startups(spark, sf_dir))


@query
def dau_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dau_by_hour(_startups(spark, sf_dir))


@query
def new_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.new_devices(_startups(spark, sf_dir))


@query
def observed_startups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First startups with the row counts before and after deduplication observed."""
    before = ops.observed(_startups(spark, sf_dir), "startups_in")
    first = ops.observed(ops.first_startup(before, ["event_id"]), "first_startups_out")
    return first.select("log_date", "mid", "event_id")


@query
def dau_hourly_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    startups = _startups(spark, sf_dir, _day_before(DEVICE_DAY), DEVICE_DAY)
    return plans.fill_hours(plans.hourly_compare(startups, "dau", DEVICE_DAY))


@query
def dau_hourly_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    startups = _startups(spark, sf_dir, _day_before(DEVICE_DAY), DEVICE_DAY)
    return plans.hourly_document(plans.hourly_compare(startups, "dau", DEVICE_DAY))


# --- orders -----------------------------------------------------------------


@query
def order_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).drop("create_date", "create_hour", "create_ts")
    return ops.order_clean(orders).withColumn("total_amount", F.col("total_amount").cast("double"))


@query
def order_amount_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.order_amount_total(_orders(spark, sf_dir))


@query
def order_amount_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.order_amount_by_hour(_orders(spark, sf_dir))


@query
def order_amount_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.order_amount_total(_orders(spark, sf_dir, ORDER_DAY, ORDER_DAY), ORDER_DAY)


@query
def order_hourly_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir, _day_before(ORDER_DAY), ORDER_DAY)
    return plans.fill_hours(plans.hourly_compare(orders, "order_amount", ORDER_DAY))


@query
def order_hour_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue in cents by hour of the day over all days, as one map; shown as text."""
    by_hour = _orders(spark, sf_dir).groupBy("create_hour")
    total = by_hour.agg((F.sum("total_amount") * 100).cast("bigint").alias("amount"))
    as_map = plans.as_hour_map(total, "amount", "create_hour")
    return as_map.select(F.to_json("by_hour").alias("by_hour"))


@query
def sales_by_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sales_by_province(_orders(spark, sf_dir))


@query
def kpi_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    startups = _startups(spark, sf_dir, until=DEVICE_DAY)
    # The order table ends before the event table starts: shift orders so that both share a day.
    shift = (dt.date.fromisoformat(DEVICE_DAY) - dt.date.fromisoformat(ORDER_DAY)).days
    orders = _orders(spark, sf_dir, ORDER_DAY, ORDER_DAY)
    return plans.kpi_tiles(startups, orders.withColumn("create_date", F.date_add("create_date", shift)), DEVICE_DAY)


@query
def kpi_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles' JSON document, read back into columns."""
    document = plans.kpi_document(kpi_tiles(spark, sf_dir))
    tiles = F.from_json("document", "array<struct<id string, name string, value double>>")
    return document.select(tiles.alias("t")).select(
        F.array_join("t.id", ",").alias("ids"),
        *[F.col("t")[i]["value"].alias(name) for i, name in enumerate(plans.TILES)],
    )


# --- sales ------------------------------------------------------------------


@query
def sale_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.join_order_detail(_orders(spark, sf_dir), _details(spark, sf_dir, ("order_price",)))


@query
def sale_detail_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _age_as_double(_sales(spark, sf_dir))


@query
def user_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = age_years(F.col("birthday"), AS_OF)
    return _users(spark, sf_dir).select("id", age.alias("age"), age_bucket(age).alias("age_group"))


@query
def latest_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order counts as a change of its buyer's record; the last one stays."""
    changes = t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("user_level"),
        F.col("o_orderdate").alias("changed"),
        F.col("o_orderkey").alias("change_id"),
    )
    return ops.latest_users(changes, ["changed", "change_id"]).select("id", "user_level", "change_id")


@query
def sale_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.sale_search(_sales(spark, sf_dir, values=()), None, KEYWORD).select("order_detail_id", "sku_name", "dt")


@query
def sale_search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.total_hits(plans.sale_search(_sales(spark, sf_dir, values=()), None, KEYWORD))


@query
def sale_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of all hits."""
    return _age_as_double(plans.sale_page(plans.sale_search(_sales(spark, sf_dir), None, KEYWORD), page=2))


@query
def sale_gender_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.gender_facet(plans.sale_search(_sales(spark, sf_dir, values=()), None, KEYWORD))


@query
def sale_age_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.age_facet(plans.sale_search(_sales(spark, sf_dir, values=()), None, KEYWORD))


@query
def sale_gender_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.gender_terms(_sales(spark, sf_dir, values=()))


@query
def sale_age_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.age_terms(_sales(spark, sf_dir, values=()))


@query
def sale_search_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of one day without keyword, read back into columns."""
    document = plans.sale_search_document(_sales(spark, sf_dir, ORDER_DAY), ORDER_DAY)
    shape = (
        "struct<total bigint, stat array<struct<title string, options array<struct<name string, value double>>>>, "
        "detail array<struct<order_detail_id string>>>"
    )
    d = document.select(F.from_json("document", shape).alias("d"))
    return d.select(
        F.col("d.total").alias("total"),
        F.col("d.stat")[0]["options"][0]["value"].alias("under_20"),
        F.col("d.stat")[0]["options"][1]["value"].alias("from_20_to_29"),
        F.col("d.stat")[0]["options"][2]["value"].alias("over_29"),
        F.col("d.stat")[0]["options"][3]["value"].alias("age_unknown"),
        F.col("d.stat")[1]["options"][2]["value"].alias("gender_unknown"),
        F.col("d.stat")[1]["options"][0]["value"].alias("male"),
        F.col("d.stat")[1]["options"][1]["value"].alias("female"),
        F.array_join(F.col("d.detail.order_detail_id"), ",").alias("detail_ids"),
    )


# --- alerts -----------------------------------------------------------------


def _alert_text(alerts: DataFrame, *extra: str) -> DataFrame:
    counts = F.transform("events", lambda e: F.concat_ws(":", e["evid"], e["n"].cast("string")))
    return alerts.select(
        *extra,
        "mid",
        F.unix_seconds("window_end").alias("window_end_s"),
        F.array_join("uids", ",").alias("uids"),
        F.array_join("item_ids", ",").alias("item_ids"),
        F.array_join(counts, ",").alias("events"),
    )


@query
def coupon_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pane_counts(_events(spark, sf_dir))


@query
def coupon_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_text(ops.coupon_alerts(_events(spark, sf_dir)))


@query
def coupon_alerts_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_text(ops.coupon_alerts_per_minute(_events(spark, sf_dir)), "alert_id")


@query
def coupon_alerts_three_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows sliding by ten minutes, with at least three coupon users."""
    return _alert_text(ops.coupon_alerts(_events(spark, sf_dir), size=7200, slide=600, min_uids=3))


@query
def alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = ops.alert_documents(ops.alerts_per_minute(ops.coupon_alerts(_events(spark, sf_dir))))
    return documents.select(
        "alert_id",
        "mid",
        F.array_join("uids", ",").alias("uids"),
        F.array_join("itemIds", ",").alias("item_ids"),
        F.array_join("events", ",").alias("events"),
        "ts",
    )


# --- ingest -----------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines as devices send them: bare numbers, quoted text, no usable time."""
    events = t.table(spark, sf_dir, "events")
    startups = t.startup_log(events).withColumn("type", F.lit("startup"))
    others = t.event_log(events).withColumns({"type": F.lit("event"), "itemid": F.col("itemid").cast("int")})
    common = ["type", "mid", "uid", "os", "area", "event_id"]

    def lines(df: DataFrame, fields: list[str]) -> DataFrame:
        record = F.struct(*fields, F.lit("0").alias("ts"))
        return df.select(F.to_json(record).alias("value"), F.col("event_ts").alias("arrival_ts"))

    return lines(startups, common).unionByName(lines(others, [*common, "evid", "itemid"]))


@query
def stamp_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = ops.stamp_ingest(log_lines(spark, sf_dir), F.unix_millis("arrival_ts"))
    fields = "event_id bigint, type string, mid string, uid string, os string, area string, evid string, itemid bigint, ts bigint"
    r = stamped.select(F.from_json("value", fields).alias("r")).select("r.*")
    return r.withColumn("itemid", F.col("itemid").cast("double"))


@query
def route_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = ops.route_logs(log_lines(spark, sf_dir))
    return routed.select("topic", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


def change_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change entries of orders, lines, users and one table nobody listens to; odd keys are updates."""

    def entries(df: DataFrame, table_name: str, key: str, fields: list[str]) -> DataFrame:
        pairs = [F.struct(F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for f in fields]
        odd = F.pmod(F.regexp_extract(key, r"\d+", 0).cast("bigint"), F.lit(2)) == 1
        return df.select(
            F.lit("ROWDATA").alias("entry_type"),
            F.when(odd, "UPDATE").otherwise("INSERT").alias("event_type"),
            F.lit(table_name).alias("table_name"),
            F.array(F.array(*pairs)).alias("rows"),
        )

    orders, details, users = _orders(spark, sf_dir), _details(spark, sf_dir), _users(spark, sf_dir)
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    return (
        entries(orders, "order_info", "id", ["id", "user_id", "total_amount", "create_time"])
        .unionByName(entries(details, "order_detail", "order_id", ["id", "order_id", "sku_id", "order_price"]))
        .unionByName(entries(users, "user_info", "id", ["id", "birthday", "gender"]))
        .unionByName(entries(parts, "sku_info", "id", ["id", "p_name"]))
    )


CHANGE_FIELDS = ["id", "order_id", "user_id", "total_amount", "order_price", "birthday", "gender"]


@query
def route_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = ops.route_cdc(change_entries(spark, sf_dir))
    return routed.select("topic", *[F.get_json_object("value", f"$.{f}").alias(f) for f in CHANGE_FIELDS])


def _as_json(df: DataFrame, fields: list[str]) -> DataFrame:
    """Records the way the change feed sends them: every value quoted."""
    return df.select(F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields])).alias("value"))


@query
def parse_startup_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _startups(spark, sf_dir).withColumn("type", F.lit("startup"))
    parsed = sources.parse_startup(_as_json(lines, ["type", "mid", "uid", "os", "area", "ts"]))
    return sources.accepted(parsed).select("log_type", "mid", "uid", "os", "area", "ts", "log_date", "log_hour")


@query
def parse_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = sources.parse_event(_as_json(_events(spark, sf_dir), ["mid", "uid", "evid", "itemid", "ts"]))
    return sources.accepted(parsed).select("mid", "uid", "evid", "itemid", "ts", "log_date", "log_hour")


@query
def parse_order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["id", "province_id", "consignee_tel", "order_status", "user_id", "total_amount", "create_time"]
    parsed = sources.accepted(sources.parse_order(_as_json(_orders(spark, sf_dir), fields)))
    return parsed.select(*fields, "create_date", "create_hour").withColumn(
        "total_amount", F.col("total_amount").cast("double")
    )


@query
def parse_order_detail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["id", "order_id", "sku_id", "sku_name", "order_price"]
    return sources.accepted(sources.parse_order_detail(_as_json(_details(spark, sf_dir), fields))).select(*fields)


@query
def parse_user_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["id", "login_name", "user_level", "birthday", "gender"]
    return sources.accepted(sources.parse_user(_as_json(_users(spark, sf_dir), fields))).select(*fields)


@query
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Startup records of which one third is cut off, another third has no device, and of the rest one has text
    behind it and one has a key twice."""
    lines = _as_json(_startups(spark, sf_dir), ["mid", "event_id", "ts"])
    part = F.get_json_object("value", "$.event_id").cast("bigint") % 9
    damaged = (
        F.when(part % 3 == 0, F.expr("left(value, length(value) - 1)"))
        .when(part % 3 == 1, F.regexp_replace("value", '"mid":"[^"]*",', ""))
        .when(part == 2, F.concat("value", F.lit('{"mid":"more"}')))
        .when(part == 5, F.regexp_replace("value", "^.", '{"ts":"1",'))
        .otherwise(F.col("value"))
    )
    return sources.rejects(sources.parse_startup(lines.withColumn("value", damaged)))


@query
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after inserts, updates, deletions and new inserts, the change entries in no order: every third user is updated, every
    fifth deleted, every tenth inserted again; every seventh is updated and deleted at the same moment."""
    users = _users(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in ("id", "login_name", "user_level", "gender")])
    key = F.col("id").cast("bigint")

    def change(rows: DataFrame, operation: str, minute: int) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in users.columns]
        at = F.timestamp_seconds(F.lit(1704067200 + 60 * minute))
        return rows.select(
            F.lit("ROWDATA").alias("entry_type"), F.lit(operation).alias("event_type"), F.lit("user_info").alias("table_name"),
            F.array(F.array(*pairs)).alias("rows"), at.alias("arrival_ts"),
        )

    def level(value: str) -> DataFrame:
        return users.withColumn("user_level", F.lit(value))

    entries = (
        change(level("again").where(key % 10 == 0), "INSERT", 3)
        .unionByName(change(users.where(key % 5 == 0), "DELETE", 2))
        .unionByName(change(users.where(key % 7 == 0), "DELETE", 1))
        .unionByName(change(level("changed").where(key % 3 == 0), "UPDATE", 1))
        .unionByName(change(users, "INSERT", 0))
    )
    rows = ops.changed_rows(entries, "user_info", users.columns)
    return ops.apply_changes(rows, ["id"], ["arrival_ts"]).drop("arrival_ts")
