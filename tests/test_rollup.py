import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from tillpulse import operators as ops, plans, streaming
from tillpulse.sinks.rollup import net_change

D1, D2, D3 = (dt.date(2024, 1, d) for d in (1, 2, 3))


def versions(spark, *data):
    table = streaming.order_table("/nowhere")
    frame = spark.createDataFrame(data, "id string, total_amount double, create_date date, create_hour string, at int")
    missing = [c for c in table.columns() if c not in frame.columns]
    at = F.timestamp_seconds("at").alias("arrival_ts")
    return frame.select(
        *[c for c in frame.columns if c != "at"], at, *[F.lit(None).cast("string").alias(c) for c in missing if c != "arrival_ts"]
    ).withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))


def test_sums_follow_versions_replays_and_late_rows(spark, tmp_path):
    table, rollup = streaming.order_table(str(tmp_path / "o")), streaming.order_rollup(str(tmp_path / "s"))
    assert rollup.totals(spark).count() == 0
    batches = [
        [("a", 5.0, D1, "01", 1), ("a", 6.0, D1, "02", 2), ("b", 1.5, D1, "01", 1)],
        [("a", 6.0, D1, "02", 3), ("b", None, D1, "01", 0), ("c", 2.0, D2, "09", 1)],  # nothing new; too old; new
        [("b", 2.5, D1, "03", 5)],
    ]
    for number, data in enumerate(batches):
        for _ in range(2):  # the second time as a replay
            df = versions(spark, *data)
            table.upsert(df, number, "s")
            sums = {"amount": F.coalesce("total_amount", F.lit(0)), "orders": F.lit(1)}
            rollup.add(net_change(*table.effect(df, number, "s"), ["create_date", "create_hour"], sums), number, "s")
        want = table.latest(spark).groupBy("create_date", "create_hour").agg(F.sum("total_amount").alias("amount"), F.count("*").alias("orders"))
        got = rollup.totals(spark).where("orders <> 0")
        assert rows(got, "create_date", "create_hour") == rows(want, "create_date", "create_hour")
    assert rows(rollup.totals(spark).where("create_hour = '01'").select("amount", "orders")) == [(Decimal("0.00"), 0)]
    compacted = rollup.compact(spark, str(tmp_path / "s2"))
    assert rows(compacted.totals(spark), "create_date", "create_hour") == rows(rollup.totals(spark), "create_date", "create_hour")
    compacted.add(spark.createDataFrame([(D1, "03", 1, 0)], "create_date date, create_hour string, amount int, orders int"), 3, "s")
    again = compacted.compact(spark, str(tmp_path / "s3"))
    two = plans.hourly_from_totals(again.totals(spark), D2, "create_date", "create_hour", "amount")
    assert rows(two, "hour") == [("02", None, 6.0), ("03", None, 3.5), ("09", 2.0, None)]


def test_first_days_of_devices(spark, tmp_path):
    devices = streaming.device_table(str(tmp_path / "d"))
    batches = [[("a", D2), ("a", D3), ("b", D3), (None, D1)], [("b", D2), ("c", D3), ("a", D3)], [("b", D1)]]
    seen = []
    for number, data in enumerate(batches):
        seen += data
        for _ in range(2):
            startups = spark.createDataFrame(data, "mid string, log_date date")
            devices.upsert(ops.first_day_changes(startups, devices.latest(spark, ("s", number))), number, "s")
        every = spark.createDataFrame(seen, "mid string, log_date date")
        assert rows(ops.new_devices_known(devices.latest(spark)), "log_date") == rows(ops.new_devices(every), "log_date")
    compacted = devices.compact(spark, str(tmp_path / "d2"))
    for day, n in ((D1, 1), (D2, 1), (D3, 1), (dt.date(2024, 1, 4), 0)):
        assert rows(ops.new_devices_known(compacted.latest(spark), day)) == [(day, n)]
    plan = ops.new_devices_known(compacted.latest(spark), D2)._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in line and "(first_day#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines())
