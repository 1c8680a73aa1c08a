import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillpulse.operators import latest
from tillpulse.sinks import KeyedTable, PaneStore

SCHEMA = "id string, v int, day date"
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


@pytest.fixture
def table(tmp_path):
    return KeyedTable(str(tmp_path / "t"), SCHEMA, ["day", "id"], order=["v"], partition_by=["day"])


def frame(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


def test_greatest_order_wins_then_the_last_write(spark, tmp_path, table):
    assert rows(table.latest(spark)) == []
    table.upsert(frame(spark, ("a", 1, D1), ("b", 1, D1), ("a", 3, D1), ("a", 2, D1)), 0)
    assert rows(table.latest(spark), "id") == [("a", 3, D1), ("b", 1, D1)]
    # Which batch comes first makes no difference.
    table.upsert(frame(spark, ("a", 1, D1), ("a", 7, D2)), 1)
    assert rows(table.latest(spark), "id", "day") == [("a", 3, D1), ("a", 7, D2), ("b", 1, D1)]
    plain = KeyedTable(str(tmp_path / "p"), SCHEMA, ["id"])
    for batch, v in enumerate((5, 2)):
        plain.upsert(frame(spark, ("a", v, D1)), batch)
    assert rows(plain.latest(spark)) == [("a", 2, D1)]


def test_replay_and_empty_batch_change_nothing(spark, table):
    table.upsert(frame(spark, ("a", 1, D1)), 0)
    table.upsert(frame(spark, ("a", 2, D1)), 1)
    table.upsert(frame(spark), 2)
    for batch in (1, 1, 0):
        table.upsert(frame(spark, ("a", batch + 1, D1)), batch)
    assert rows(table.latest(spark)) == [("a", 2, D1)]


def test_compaction(spark, table, tmp_path):
    assert rows(table.compact(spark, str(tmp_path / "empty")).latest(spark)) == []
    table.upsert(frame(spark, ("a", 1, D1), ("b", 1, D2), ("c", 1, D2)), 0)
    table.upsert(frame(spark, ("a", 2, D1)), 1)
    table.upsert(frame(spark, ("c", 0, D2), ("d", 4, D1)), 2)
    want = [("a", 2, D1), ("b", 1, D2), ("c", 1, D2), ("d", 4, D1)]
    again = table.compact(spark, str(tmp_path / "t2"))
    assert rows(again.latest(spark), "id") == want == rows(table.latest(spark), "id")
    # The stream goes on with the new folder: it replays its last batch, then adds another.
    again.upsert(frame(spark, ("c", 0, D2), ("d", 4, D1)), 2)
    assert rows(again.latest(spark), "id") == want
    again.upsert(frame(spark, ("a", 1, D1), ("c", 5, D2)), 3)
    want[2] = ("c", 5, D2)
    assert rows(again.latest(spark), "id") == want
    assert rows(again.compact(spark, str(tmp_path / "t3")).latest(spark), "id") == want
    # Equal order values: batches were written after the base.
    again.upsert(frame(spark, ("b", 1, D2)).withColumn("v", F.lit(1)), 4)
    assert rows(again.latest(spark), "id") == want


def test_rows_without_key(spark, tmp_path):
    keyless = KeyedTable(str(tmp_path / "k"), SCHEMA, ["id"])
    keyless.upsert(frame(spark, (None, 1, D1), (None, 1, D1), ("a", 1, D1)), 0)
    keyless.upsert(frame(spark, (None, 1, D1), ("a", 2, D1)), 1)
    for found in (keyless, keyless.compact(spark, str(tmp_path / "k2"))):
        assert rows(found.latest(spark), "id") == [(None, 1, D1)] * 3 + [("a", 2, D1)]
    valued = KeyedTable(str(tmp_path / "v"), SCHEMA, ["id"], null_is_value=True)
    valued.upsert(frame(spark, (None, 1, D1), ("a", 1, D1)), 0)
    valued.upsert(frame(spark, (None, 2, D1)), 1)
    assert rows(valued.latest(spark), "id") == [(None, 2, D1), ("a", 1, D1)]


def test_day_filter_reaches_both_layouts(spark, table, tmp_path):
    table.upsert(frame(spark, ("a", 1, D1), ("b", 1, D2)), 0)
    table.upsert(frame(spark, ("a", 2, D1)), 1)
    day = table.compact(spark, str(tmp_path / "t2")).latest(spark).where("day = date '2024-01-01'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    # Folders of the compacted part are skipped by name, row groups of the batch by their statistics.
    assert plan.count("isnotnull(day#") >= 2 and "EqualTo(day,2024-01-01)" in plan
    assert any("PartitionFilters: [" in line and "(day#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines())
    assert rows(day) == [("a", 2, D1)]


def test_a_fresh_source_adds_to_the_table(spark, table):
    """A stream with a new checkpoint counts its batches from 0 again."""
    table.upsert(frame(spark, ("a", 1, D1)), 0, "one")
    table.upsert(frame(spark, ("b", 1, D1)), 1, "one")
    table.upsert(frame(spark, ("b", 2, D1), ("c", 2, D2)), 0, "two / ü=%")
    assert rows(table.latest(spark), "id") == [("a", 1, D1), ("b", 2, D1), ("c", 2, D2)]
    # The same pair again is the same batch.
    table.upsert(frame(spark, ("b", 1, D1)), 0, "two / ü=%")
    assert rows(table.latest(spark), "id") == [("a", 1, D1), ("b", 1, D1)]


def test_first_stays_whenever_it_is_written(spark, tmp_path):
    own = KeyedTable(str(tmp_path / "m"), "id string, n int", ["id"], ["n"], null_is_value=True, first=True)
    for i, part in enumerate([[("a", 5), (None, 3)], [("a", 2), ("b", 1)], [("a", 4), (None, 7)]]):
        own.upsert(spark.createDataFrame(part, "id string, n int"), i)
    want = [(None, 3), ("a", 2), ("b", 1)]
    assert rows(own.latest(spark), "id") == want
    again = own.compact(spark, str(tmp_path / "m2"))
    again.upsert(spark.createDataFrame([("b", 0), ("a", 9)], "id string, n int"), 9)
    assert rows(again.latest(spark), "id") == [(None, 3), ("a", 2), ("b", 0)]


def test_deleted_keys(spark, tmp_path):
    own = KeyedTable(str(tmp_path / "d"), "id string, n int, gone boolean", ["id"], ["n"], tombstone="gone")
    data = [("a", 1, False), ("b", 1, None), ("a", 2, True), ("c", 1, True), ("c", 2, False)]
    for i, row in enumerate(data):
        own.upsert(spark.createDataFrame([row], "id string, n int, gone boolean"), i)
    for found in (own, own.compact(spark, str(tmp_path / "d2"))):
        assert rows(found.latest(spark).select("id", "n"), "id") == [("b", 1), ("c", 2)]
        # An older change that comes late does not bring a deleted key back.
        found.upsert(spark.createDataFrame([("a", 1, False)], "id string, n int, gone boolean"), 9)
        assert rows(found.latest(spark).select("id", "n"), "id") == [("b", 1), ("c", 2)]
        wanted = spark.createDataFrame([("a",), ("c",)], "id string")
        assert rows(found.lookup(spark, wanted).select("id", "n"), "id") == [("c", 2)]


def test_compacted_rows_are_read_as_they_are(spark, table, tmp_path):
    table.upsert(frame(spark, ("a", 1, D1), ("b", 1, D2)), 0)
    table.upsert(frame(spark, ("a", 2, D1)), 1)
    again = table.compact(spark, str(tmp_path / "t2"))
    kept = again.latest(spark)._jdf.queryExecution().executedPlan().toString().split("Union")[1]
    assert "LeftAnti" in kept and rows(again.latest(spark), "id") == [("a", 2, D1), ("b", 1, D2)]


def test_panes_of_an_hour_are_read_alone(spark, tmp_path):
    panes = PaneStore(str(tmp_path / "p"))
    kind = "mid string, pane bigint, evid string, uid string, itemid string, n bigint"
    assert panes.read(spark, [0]).count() == 0
    data = [("a", 5, "coupon", "u", "1", 2), ("a", 400, "coupon", "u", "1", 1), ("b", -1, None, None, None, 1)]
    for _ in range(2):
        panes.add(spark.createDataFrame(data, kind), 0, "s")
    panes.add(spark.createDataFrame(data[:1], kind), 1, "s")
    assert panes.read(spark, []).count() == 0 and panes.read(spark, [7]).count() == 0
    assert rows(panes.read(spark, [0, 7]).select("mid", "pane", "n", "batch"), "batch") == [("a", 5, 2, 0), ("a", 5, 2, 1)]
    assert rows(panes.read(spark, [-1, 1]).select("pane"), "pane") == [(-1,), (400,)]
    files = panes.read(spark, [0]).inputFiles()
    assert len(files) == 2 and all("slot=0/" in f for f in files)


def test_reading_settles_only_keys_that_occur_several_times(spark, tmp_path, monkeypatch):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    plain = KeyedTable(str(tmp_path / "p"), SCHEMA, ["id"], order=["v"])
    plain.upsert(frame(spark, ("a", 1, D1), ("b", 1, D1), (None, 1, D1), (None, 1, D1)), 0)
    assert "Exchange" not in plan(plain.latest(spark)) and plain.latest(spark).count() == 4
    plain.upsert(frame(spark, ("a", 2, D1), ("c", 1, D1), (None, 0, D2)), 1)
    want = [("a", 2, D1), ("b", 1, D1), ("c", 1, D1)]
    for few in (10, 0):
        monkeypatch.setattr(latest, "FEW_KEYS", few)
        got = plain.latest(spark)
        assert rows(got.where("id is not null"), "id") == want and got.where("id is null").count() == 3
    valued = KeyedTable(str(tmp_path / "v"), SCHEMA, ["id"], order=["v"], null_is_value=True)
    valued.upsert(frame(spark, (None, 1, D1), (None, 3, D1), ("a", 1, D1)), 0)
    for few in (10, 0):
        monkeypatch.setattr(latest, "FEW_KEYS", few)
        assert rows(valued.latest(spark), "v") == [("a", 1, D1), (None, 3, D1)]
