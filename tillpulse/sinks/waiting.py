"""Orders and order lines that may still meet, kept in plain folders between the batches of a stream.

Every batch is one folder and is read back from it, so its records are parsed once. Every ``every`` batches a round ends: what
can still meet is written to one folder, and the next round starts from that. Two rounds take turns, so folders are used again
and neither their number nor the disk grows with the age of the stream. A repeated batch overwrites what it has
written and reads only what earlier batches have.

``seen`` holds the newest arrival of both kinds up to a batch. The older of the two is as far as both have come: what
cannot meet anything that arrives after that, less the lateness, is not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillpulse.sinks.keyed import read_folder

ORDER, LINE = "order", "line"
_SEEN = "order_max bigint, line_max bigint"


def _at(us: int, *less: str) -> Column:
    """A moment in microseconds, less some intervals."""
    at = F.timestamp_micros(F.lit(us).cast("bigint"))
    for interval in less:
        at = at - F.expr(f"interval {interval}")
    return at


@dataclass(frozen=True)
class WaitingRows:
    """Rows have ``kind``, ``arrival_ts`` and the columns of all kinds; other kinds than orders and lines are not kept."""

    path: str
    schema: T.StructType
    early: str
    horizon: str
    lateness: str
    every: int = 60

    def add(self, rows: DataFrame, batch: int) -> tuple[DataFrame, dict]:
        """Write a batch; gives its rows, and the oldest and newest arrivals of its orders and lines."""
        folder = f"{self.path}/round={self._round(batch) % 2}/batch={batch % self.every}"
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(folder)
        written, us = rows.sparkSession.read.schema(self.schema).parquet(folder), F.unix_micros("arrival_ts")
        of = {kind: F.when(F.col("kind") == kind, us) for kind in (ORDER, LINE)}
        ends = [f(of[kind]).alias(f"{kind}_{n}") for kind in of for n, f in (("min", F.min), ("max", F.max))]
        return written, written.agg(*ends).first().asDict()

    def come(self, spark: SparkSession, batch: int) -> int | None:
        """How far both kinds have come before a batch; None while one has not sent anything."""
        return self._come(self._seen(spark, batch - 1))

    def advance(self, spark: SparkSession, batch: int, ends: dict) -> int | None:
        """The same after the batch, whose ``ends`` are written down."""
        before = self._seen(spark, batch - 1)
        newest = {f"{k}_max": max((v for v in (before[f"{k}_max"], ends[f"{k}_max"]) if v is not None), default=None) for k in (ORDER, LINE)}
        spark.createDataFrame([(newest["order_max"], newest["line_max"])], _SEEN).coalesce(1).write.mode("overwrite").json(f"{self.path}/seen/{batch % 2}")
        return self._come(newest)

    def before(self, spark: SparkSession, batch: int, come: int | None) -> DataFrame:
        """What earlier batches, which have ``come`` so far, have left that may still meet something."""
        if batch and batch % self.every == 0:
            # The round that has ended, put together for this one.
            last = self._kept(spark, batch - 1, self.every)
            last.where(self._may_meet(come)).sortWithinPartitions("kind", "arrival_ts").write.mode("overwrite").parquet(
                self._start(self._round(batch))
            )
        return self._kept(spark, batch, batch % self.every).where(self._may_meet(come))

    def beyond(self, come: int | None) -> Column:
        """Lines that no order to come can reach."""
        return F.lit(False) if come is None else F.col("arrival_ts") < _at(come, self.lateness, self.early)

    def near(self, kind: str, ends: dict) -> Column:
        """Rows of a kind that rows of the other kind, which lie within ``ends``, may meet: the others need not be read."""
        other, back, ahead = (LINE, self.horizon, self.early) if kind == ORDER else (ORDER, self.early, self.horizon)
        if ends[f"{other}_min"] is None:
            return F.lit(False)
        return F.col("arrival_ts").between(_at(ends[f"{other}_min"], back), _at(ends[f"{other}_max"]) + F.expr(f"interval {ahead}"))

    def _kept(self, spark: SparkSession, batch: int, below: int) -> DataFrame:
        """The start of the round of ``batch`` and its batches with a number in the round under ``below``."""
        number = self._round(batch)
        found = spark.createDataFrame([], self.schema)
        if number:
            found = found.unionByName(spark.read.schema(self.schema).parquet(self._start(number)))
        if below:
            named = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
            path = f"{self.path}/round={number % 2}"
            found = found.unionByName(read_folder(spark, named, path).where(F.col("batch") < below).drop("batch"))
        return found.where(F.col("kind").isin(ORDER, LINE))

    def _may_meet(self, come: int | None) -> Column:
        """Lines that an order to come may still reach, and every order that such a line has met or may meet."""
        if come is None:
            return F.lit(True)
        far = F.when(F.col("kind") == LINE, _at(come, self.lateness, self.early)).otherwise(_at(come, self.lateness, self.early, self.horizon))
        return F.col("arrival_ts") >= far

    def _seen(self, spark: SparkSession, batch: int) -> dict:
        if batch < 0:
            return dict.fromkeys(("order_max", "line_max"))
        return spark.read.schema(_SEEN).json(f"{self.path}/seen/{batch % 2}").first().asDict()

    def _come(self, seen: dict) -> int | None:
        ends = (seen["order_max"], seen["line_max"])
        return None if None in ends else min(ends)

    def _round(self, batch: int) -> int:
        return batch // self.every

    def _start(self, number: int) -> str:
        return f"{self.path}/start={number % 2}"
