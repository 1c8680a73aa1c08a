"""The keyed tables the jobs write, with their keys and partitioning.

Where parsing has made sure of the key, NULL is declared an ordinary value: that saves the table a second
scan for rows without a key. Only order lines may come without an id; those rows all stay.
"""

from __future__ import annotations

from tillpulse import schemas
from tillpulse.sinks.keyed import KeyedTable
from tillpulse.sinks.panes import PaneStore
from tillpulse.sinks.rollup import Rollup


def dau_table(path: str) -> KeyedTable:
    """First startups: the earliest of a device and day stays, whenever it is written."""
    return KeyedTable(
        path, schemas.DAU_TABLE, ["log_date", "mid"], ["ts"], partition_by=["log_date"], null_is_value=True, first=True
    )


def order_table(path: str) -> KeyedTable:
    """Creation day is part of the key: it never changes for an order, and readers may prune by it."""
    return KeyedTable(
        path, schemas.ORDER_TABLE, ["create_date", "id"], ["arrival_ts"], partition_by=["create_date"], null_is_value=True
    )


def device_table(path: str) -> KeyedTable:
    """The first day of every device. The day is part of the key, so that the new devices of a day are one folder; a device whose
    first day turns out to be an earlier one leaves a row that says so."""
    return KeyedTable(
        path, schemas.DEVICE_TABLE, ["first_day", "mid"], partition_by=["first_day"], null_is_value=True, tombstone="moved"
    )


def order_rollup(path: str) -> Rollup:
    """Revenue and orders per day and hour."""
    return Rollup(path, "create_date date, create_hour string", "amount decimal(28,2), orders bigint")


def dau_rollup(path: str) -> Rollup:
    """Active devices per day and hour of their first startup."""
    return Rollup(path, "log_date date, log_hour string", "dau bigint")


def user_table(path: str) -> KeyedTable:
    return KeyedTable(path, schemas.USER_TABLE, ["id"], order=["arrival_ts"], null_is_value=True)


def sale_table(path: str) -> KeyedTable:
    order = ["arrival_ts", "order_arrival_ts"]
    return KeyedTable(path, schemas.SALE_TABLE, ["dt", "order_detail_id"], order, partition_by=["dt"])


def unmatched_table(path: str) -> KeyedTable:
    """Order lines whose order did not come in time."""
    return KeyedTable(path, schemas.UNMATCHED_TABLE, ["order_detail_id"], ["arrival_ts"])


def pane_table(path: str) -> PaneStore:
    """Event counts: every batch adds its own."""
    return PaneStore(path)


def alert_table(path: str) -> KeyedTable:
    return KeyedTable(
        path, schemas.ALERT_TABLE, ["day", "mid", "window_end"], partition_by=["day"], null_is_value=True
    )


def minute_table(path: str) -> KeyedTable:
    """One alert per device and minute; rows with ``suppressed`` take an earlier alert back."""
    return KeyedTable(path, schemas.MINUTE_TABLE, ["day", "alert_id"], partition_by=["day"], null_is_value=True)
