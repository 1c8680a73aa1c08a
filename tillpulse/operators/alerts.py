"""Coupon alerts: a sliding window per device.

Events are first counted per device and pane (one slide, 10 s). A pane belongs to 30 windows, but rows are
not multiplied by 30: they travel once to the (device, hour) that evaluates them - twice near the end of an
hour. There the content of the window is worked out only where it changes, which is when a pane enters or
leaves, and the stretch up to the next change is written out as windows at the end. The hour also splits a
device that holds a large share of all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tillpulse.functions.scalars import with_alert_id

# The event that is watched and the event that clears a device.
COUPON = "coupon"
CLICK = "clickItem"
SIZE_SECONDS, SLIDE_SECONDS = 300, 10
CHUNK_SECONDS = 3600


def pane_of(ts: Column, slide: int = SLIDE_SECONDS) -> Column:
    return F.floor(F.unix_seconds(ts) / slide)


def pane_keys(slide: int = SLIDE_SECONDS) -> list[Column]:
    """What tells events of a pane apart. User and item only matter on coupon events; dropping them
    elsewhere lets the partial aggregate collapse the rest."""
    coupon = F.col("evid") == COUPON
    return [
        F.col("mid"),
        pane_of(F.col("event_ts"), slide).alias("pane"),
        F.col("evid"),
        F.when(coupon, F.col("uid")).alias("uid"),
        F.when(coupon, F.col("itemid")).alias("itemid"),
    ]


def pane_counts(events: DataFrame, slide: int = SLIDE_SECONDS) -> DataFrame:
    """Events per device, pane, kind and (for coupons) user and item."""
    return events.where(F.col("mid").isNotNull()).groupBy(*pane_keys(slide)).agg(F.count(F.lit(1)).alias("n"))


def _sum_by_kind(counts: Column) -> Column:
    """Add up ``(evid, n)`` entries per kind, sorted by kind; NULL is a kind of its own.

    Pass a plain column: the entries are looked through once per kind.
    """
    kinds = F.array_sort(F.array_distinct(F.transform(counts, lambda c: c["evid"])))

    def entry(kind: Column) -> Column:
        same = F.filter(counts, lambda c: c["evid"].eqNullSafe(kind))
        total = F.aggregate(same, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
        return F.struct(kind.alias("evid"), total.alias("n"))

    return F.transform(kinds, entry)


def _pane_content(rows: Column) -> Column:
    """Users, items and counts of one pane."""
    coupons = F.filter(rows, lambda r: r["evid"] == COUPON)
    return F.struct(
        F.array_distinct(F.transform(coupons, lambda r: r["uid"])).alias("uids"),
        F.array_distinct(F.transform(coupons, lambda r: r["itemid"])).alias("item_ids"),
        _sum_by_kind(rows).alias("events"),
        F.exists(rows, lambda r: r["evid"].eqNullSafe(CLICK)).alias("clicked"),
    )


def _check(size: int, slide: int, chunk: int) -> None:
    if size % slide or chunk % slide or chunk % 60:
        raise ValueError("size and chunk must be multiples of the slide, chunk of a minute")


def _in_order() -> WindowSpec:
    """The changes of a device within one chunk, by time."""
    return Window.partitionBy("mid", "chunk").orderBy("at")


def _stretches(panes: DataFrame, size: int, slide: int, chunk: int) -> DataFrame:
    """Per device, the ranges ``lo..hi`` of window ends (in slides) over which nothing changes, with the
    panes ``inside`` those windows. Suppressed windows are included, empty ones are not."""
    _check(size, slide, chunk)
    per_window, per_chunk = size // slide, chunk // slide
    # A pane is inside the windows ending 1 to per_window slides after its start.
    enter, leave = F.col("pane") + 1, F.col("pane") + 1 + per_window
    chunks = F.sequence(F.floor(enter / per_chunk), F.floor((leave - 1) / per_chunk))
    # A fixed number of partitions: what follows costs far more than its input size suggests, so the
    # adaptive merging of small partitions would leave cores idle.
    width = int(panes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_pane = (
        panes.withColumn("chunk", F.explode(chunks))
        .repartition(width, "mid", "chunk")
        .groupBy("mid", "chunk", "pane")
        .agg(F.collect_list(F.struct("evid", "uid", "itemid", "n")).alias("rows"))
        .select("mid", "chunk", "pane", _pane_content(F.col("rows")).alias("content"))
    )
    changes = per_pane.select(
        "mid",
        "chunk",
        F.explode(
            F.array(
                F.struct(enter.alias("at"), F.col("content").alias("content")),
                F.struct(leave.alias("at"), F.lit(None).cast(per_pane.schema["content"].dataType).alias("content")),
            )
        ).alias("c"),
    ).select("mid", "chunk", "c.*")
    inside = _in_order().rangeBetween(-(per_window - 1), Window.currentRow)
    start = F.col("chunk") * per_chunk
    return (
        changes.select(
            "mid",
            "chunk",
            "at",
            F.lead("at").over(_in_order()).alias("next"),
            F.collect_list("content").over(inside).alias("inside"),
        )
        .where((F.col("next") > F.col("at")) & (F.size("inside") > 0))
        .select(
            "mid",
            "chunk",
            "at",
            F.greatest("at", start).alias("lo"),
            F.least(F.col("next") - 1, start + per_chunk - 1).alias("hi"),
            "inside",
            F.exists("inside", lambda c: c["clicked"]).alias("suppressed"),
        )
        .where(F.col("lo") <= F.col("hi"))
    )


CONTENT = ["uids", "item_ids", "events"]


def _merged(name: str) -> Column:
    return F.flatten(F.transform("inside", lambda c: c[name]))


def _with_content(stretches: DataFrame) -> DataFrame:
    """Replace the panes of every stretch by the users, items and event counts of its windows."""
    kept = [c for c in stretches.columns if c != "inside"]
    sets = stretches.select(
        *kept,
        F.sort_array(F.array_distinct(_merged("uids"))).alias("uids"),
        F.sort_array(F.array_distinct(_merged("item_ids"))).alias("item_ids"),
        _merged("events").alias("entries"),
    )
    return sets.select(*kept, "uids", "item_ids", _sum_by_kind(F.col("entries")).alias("events"))


def _surviving(stretches: DataFrame, min_uids: int) -> DataFrame:
    kept = stretches.where(~F.col("suppressed")).drop("suppressed")
    if min_uids > 0:
        kept = kept.where(F.size(F.array_distinct(_merged("uids"))) >= min_uids)
    return kept


def _every_window(stretches: DataFrame, slide: int) -> DataFrame:
    ends = _with_content(stretches).withColumn("w", F.explode(F.sequence("lo", "hi")))
    flags = [c for c in ("suppressed",) if c in ends.columns]
    return ends.select("mid", F.timestamp_seconds(F.col("w") * slide).alias("window_end"), *CONTENT, *flags)


def windows_from_panes(
    panes: DataFrame, size: int = SIZE_SECONDS, slide: int = SLIDE_SECONDS, chunk: int = CHUNK_SECONDS
) -> DataFrame:
    """Every non-empty window of every device, with a flag for the suppressed ones."""
    return _every_window(_stretches(panes, size, slide, chunk), slide)


def coupon_alerts(
    events: DataFrame, size: int = SIZE_SECONDS, slide: int = SLIDE_SECONDS, min_uids: int = 0
) -> DataFrame:
    """Alerts per device and window: coupon users, coupon items and how often each event occurred.

    A device is cleared for a window in which it clicked an item.
    """
    stretches = _stretches(pane_counts(events, slide), size, slide, CHUNK_SECONDS)
    return _every_window(_surviving(stretches, min_uids), slide)


def alerts_per_minute(alerts: DataFrame) -> DataFrame:
    """The last surviving window of every device and minute, with its alert id."""
    minute = F.floor(F.unix_seconds("window_end") / 60).alias("minute")
    row = F.max_by(F.struct("window_end", *CONTENT), F.col("window_end")).alias("row")
    picked = alerts.groupBy("mid", minute).agg(row).select("mid", "row.*")
    return with_alert_id(picked).select("alert_id", *picked.columns)


def coupon_alerts_per_minute(
    events: DataFrame, size: int = SIZE_SECONDS, slide: int = SLIDE_SECONDS, min_uids: int = 0
) -> DataFrame:
    """``alerts_per_minute`` of ``coupon_alerts`` without writing out every window.

    A surviving stretch gives its last window in each minute it touches, unless the next surviving one
    begins in the same minute. All windows of a minute lie in one chunk, and the stretches are in order
    already, so this takes neither a shuffle nor a sort.
    """
    if 60 % slide:
        return alerts_per_minute(coupon_alerts(events, size, slide, min_uids))
    per_minute = 60 // slide
    kept = _surviving(_stretches(pane_counts(events, slide), size, slide, CHUNK_SECONDS), min_uids)
    first, last = F.floor(F.col("lo") / per_minute), F.floor(F.col("hi") / per_minute)
    following = F.floor(F.lead("lo").over(_in_order()) / per_minute)
    own = kept.withColumn("until", F.least(last, F.coalesce(following - 1, last))).where(F.col("until") >= first)
    minutes = _with_content(own).withColumn("minute", F.explode(F.sequence(first, F.col("until"))))
    w = F.least(F.col("hi"), F.col("minute") * per_minute + per_minute - 1)
    ends = minutes.select("mid", F.timestamp_seconds(w * slide).alias("window_end"), *CONTENT)
    return with_alert_id(ends).select("alert_id", *ends.columns)


def event_list(events: Column) -> Column:
    """Event counts written out as the list of event ids."""
    return F.flatten(F.transform(events, lambda e: F.array_repeat(e["evid"], e["n"].cast("int"))))


def alert_documents(alerts: DataFrame) -> DataFrame:
    """Alerts in document form: sets as arrays, every event of the window listed, time in ms."""
    return with_alert_id(alerts).select(
        "alert_id",
        "mid",
        "uids",
        F.col("item_ids").alias("itemIds"),
        event_list(F.col("events")).alias("events"),
        F.unix_millis("window_end").alias("ts"),
    )
