"""Properties of the plans that matter on large tables."""

import pytest
from pyspark.sql import functions as F

from tillpulse import operators as ops, plans
from tillpulse.queries import all_queries
from tillpulse.sources import tables as t

FOLDER = "/root/testdata/sf0.001"
BATCH = [n for n in all_queries() if not n.startswith(("stream_", "upsert_"))]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return physical(df).count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cross_join_no_single_task_sort(spark, name):
    plan = physical(all_queries()[name](spark, FOLDER))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "RowDataSourceScan"):
        assert word not in plan
    # Only aggregates of one row and pages may come together in one partition.
    if "Exchange SinglePartition" in plan:
        assert "partial_" in plan


def test_filters_and_columns_reach_the_scan(spark, settings):
    settings(spark__sql__maxMetadataStringLength="10000")
    plan = physical(all_queries()["dau_hourly_compare"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,2024-01-14T00:00)" in plan and "LessThan(ts,2024-01-16T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert plan.count("FileScan") == 1
    plan = physical(all_queries()["order_amount_on_day"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate,1998-06-14T00:00)" in plan
    assert "o_orderpriority" not in plan


def test_device_figures_come_from_one_scan(spark):
    startups = t.startup_log(t.table(spark, FOLDER, "events"))
    assert physical(ops.device_totals(startups, "2024-01-15")).count("FileScan") == 1


def test_hot_devices_are_reduced_before_the_shuffle(spark):
    startups = t.startup_log(t.table(spark, FOLDER, "events"))
    assert "partial_min" in physical(ops.first_startup(startups))
    assert "SortAggregate" not in physical(ops.dau_by_hour(startups))
    assert "partial_max_by" in physical(ops.latest_rows(startups, ["mid"], ["ts"]))


def test_alert_rows_cross_the_network_twice_at_most(spark):
    events = t.event_log(t.table(spark, FOLDER, "events"))
    assert exchanges(ops.coupon_alerts(events)) == 2
    assert exchanges(ops.coupon_alerts_per_minute(events)) == 2


def test_facets_take_one_pass(spark):
    sales = spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr(
        "'F' as user_gender", "l_linenumber as user_age", "'x' as sku_name"
    )
    assert physical(plans.age_facet(sales)).count("FileScan") == 1


@pytest.mark.parametrize("how", ["enrich", "join", "exclude"])
def test_hot_key_is_split_in_joins(spark, settings, how):
    """A third of all rows on one key: the adaptive join takes its partition apart."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB",
        spark__sql__shuffle__partitions="16",
    )
    n = 60000
    hot = spark.range(0, n, 1, 8).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    keys = spark.range(0, n, 1, 4).select(F.col("id").cast("string").alias("id")).union(spark.sql("select 'hot'"))
    if how == "enrich":
        sales = hot.selectExpr(
            "cast(id as string) order_detail_id", "k user_id", "'o' order_id", "'s' order_status", "'t' create_time",
            "'i' sku_id", "1.0D sku_price", "'n' sku_name", "current_date() dt",
        )
        users = keys.selectExpr("id", "'F' gender", "date '2000-01-01' birthday", "'1' user_level")
        df, want = ops.enrich_user(sales, users, "2024-01-01"), n
    elif how == "join":
        orders = keys.selectExpr("id", "'s' order_status", "'t' create_time", "'u' user_id", "current_date() create_date")
        details = hot.selectExpr("cast(id as string) id", "k order_id", "'s' sku_id", "'n' sku_name", "'1' order_price")
        df, want = ops.join_order_detail(orders, details), n
    else:
        startups = hot.selectExpr("k mid", "date '2024-01-01' log_date", "id ts")
        seen = keys.where("id != 'hot'").selectExpr("id mid", "date '2024-01-01' log_date")
        df, want = ops.exclude_seen(startups, seen), n // 3
    assert len(df.toPandas()) == want
    assert "skew=true" in physical(df)


def test_searches_read_what_they_need_once(spark, settings):
    settings(spark__sql__maxMetadataStringLength="10000")
    document = physical(all_queries()["sale_search_document"](spark, FOLDER))
    assert document.count("FileScan") <= 5
    total = physical(all_queries()["sale_search_total"](spark, FOLDER))
    assert "l_extendedprice" not in total and "l_quantity" not in total
    assert "l_quantity" not in physical(all_queries()["sale_detail_enriched"](spark, FOLDER))
