"""Alerts against a direct evaluation of every window."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillpulse import operators as ops
from tillpulse.operators.alerts import _stretches, windows_from_panes

BASE = 1704067200  # a full hour


def frame(spark, events):
    df = spark.createDataFrame(events, "mid string, uid string, evid string, itemid string, at double")
    return df.selectExpr("mid", "uid", "evid", "itemid", "cast(at as timestamp) as event_ts")


def brute_force(events, size, slide, min_uids=0):
    """{(mid, end): (uids, items, counts)} of the windows without a click."""
    windows = defaultdict(list)
    for mid, uid, evid, itemid, at in events:
        if mid is None:
            continue
        first = int(at // slide) * slide + slide
        for end in range(first, first + size, slide):
            windows[mid, end].append((uid, evid, itemid))
    out = {}
    for key, content in windows.items():
        if any(e == "clickItem" for _, e, _ in content):
            continue
        uids = {u for u, e, _ in content if e == "coupon"}
        items = {i for _, e, i in content if e == "coupon"}
        if len(uids) >= min_uids:
            out[key] = (uids, items, Counter(e for _, e, _ in content))
    return out


def got(df):
    out = {}
    for r in df.collect():
        key = (r.mid, int(r.window_end.replace(tzinfo=dt.timezone.utc).timestamp()))
        assert key not in out
        assert len(set(r.uids)) == len(r.uids) and len(set(r.item_ids)) == len(r.item_ids)
        out[key] = (set(r.uids), set(r.item_ids), Counter({e.evid: e.n for e in r.events}))
    return out


@pytest.fixture(autouse=True)
def utc(monkeypatch):
    import os
    import time

    monkeypatch.setitem(os.environ, "TZ", "UTC")
    time.tzset()


def random_events(seed, n, span):
    r = random.Random(seed)
    kinds = ["coupon", "coupon", "addCart", "addComment", None] + (["clickItem"] if seed % 2 else [])
    return [
        (
            r.choice(["a", "a", "a", "b", "c", None]),
            r.choice(["u1", "u2", "u3", None]),
            r.choice(kinds) if r.random() > 0.02 else "clickItem",
            r.choice(["i1", "i2", None]),
            BASE + float(r.choice([r.uniform(0, span), r.randrange(0, int(span), 10), 3600 + r.randrange(-40, 40)])),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [0, 2, 3])
@pytest.mark.parametrize("size, slide", [(300, 10), (120, 60), (60, 60)])
def test_windows_equal_brute_force(spark, seed, size, slide):
    events = random_events(seed, [40, 300][seed // 2], 7200)
    df = frame(spark, events)
    assert got(ops.coupon_alerts(df, size, slide)) == brute_force(events, size, slide)
    assert got(ops.coupon_alerts(df, size, slide, 2)) == brute_force(events, size, slide, 2)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("size, slide", [(300, 10), (120, 60), (360, 90)])
def test_last_window_of_a_minute(spark, seed, size, slide):
    events = random_events(seed, 200, 7200)
    want = {}
    for (mid, end), content in brute_force(events, size, slide).items():
        if end >= want.get((mid, end // 60), (0,))[0]:
            want[mid, end // 60] = (end, content)
    want = {(mid, end): content for (mid, _), (end, content) in want.items()}
    df = frame(spark, events)
    assert got(ops.coupon_alerts_per_minute(df, size, slide)) == want
    assert got(ops.alerts_per_minute(ops.coupon_alerts(df, size, slide))) == want


def test_a_hot_device_is_spread_over_tasks(spark, settings):
    """One device with a third of all events: no partition gets more than a fraction of them."""
    settings(spark__sql__shuffle__partitions="16")
    events = spark.range(30000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('m', id % 997)) mid", "concat('u', id % 50) uid", "'coupon' evid", "'i' itemid",
        f"timestamp_seconds({BASE} + (id * 37) % 86400) event_ts",
    )
    changes = _stretches(ops.pane_counts(events), 300, 10, 3600)
    counts = changes.where("mid = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in counts) < 0.35 * sum(r["count"] for r in counts)
    # Events of one pane that are alike arrive as one row.
    alike = events.where("mid = 'hot'").withColumn("event_ts", F.timestamp_seconds(F.lit(BASE)))
    assert ops.pane_counts(alike).count() == 50


def test_windows_tell_which_are_suppressed(spark):
    df = frame(spark, [("a", "u", "coupon", "i", BASE + 0.0), ("a", "u", "clickItem", "i", BASE + 295.0)])
    flags = windows_from_panes(ops.pane_counts(df)).selectExpr("count_if(suppressed) s", "count(*) n").first()
    # 29 ends see the first event only, one sees both, 29 see the click only.
    assert (flags.s, flags.n) == (30, 59)


def test_a_device_without_coupons_alerts_as_well(spark):
    alerts = ops.coupon_alerts(frame(spark, [("a", "u", "addCart", "i", BASE + 0.0)]))
    assert alerts.count() == 30 and alerts.first().uids == []
    assert ops.coupon_alerts(frame(spark, [("a", "u", "addCart", "i", BASE + 0.0)]), min_uids=1).count() == 0


def test_document_lists_every_event(spark):
    events = [("a", u, "coupon", "i", BASE + 0.0) for u in ("u1", "u2", "u2")] + [("a", "u1", None, None, BASE + 1.0)]
    last = ops.alert_documents(ops.coupon_alerts_per_minute(frame(spark, events))).orderBy("ts").first()
    assert last.alert_id == f"a_{last.ts // 60000}"
    assert (last.uids, last.itemIds) == (["u1", "u2"], ["i"])
    assert Counter(last.events) == Counter({"coupon": 3, None: 1})


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        ops.coupon_alerts(frame(spark, [("a", "u", "coupon", "i", BASE + 0.0)]), size=25, slide=10)
