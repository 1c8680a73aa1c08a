"""Event counts of the alert windows, in a folder for every six hours.

``slot=<number>/source=<stream>/batch=<number>``: a replayed batch overwrites its own folders. Whoever needs a few hours lists and
reads their slots only, however long the history is. A batch that catches up on weeks writes a folder per slot; one per
hour would cost it more than all its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillpulse import schemas
from tillpulse.operators.alerts import CHUNK_SECONDS, SLIDE_SECONDS
from tillpulse.sinks.keyed import read_folder

PANES_PER_HOUR = CHUNK_SECONDS // SLIDE_SECONDS
SLOT_HOURS = 6


def hour_of(pane: Column) -> Column:
    return F.floor(pane / PANES_PER_HOUR)


@dataclass(frozen=True)
class PaneStore:
    path: str

    def add(self, panes: DataFrame, batch: int, source: str) -> None:
        slot = F.floor(hour_of(F.col("pane")) / SLOT_HOURS)
        named = panes.withColumns({"slot": slot, "source": F.lit(source), "batch": F.lit(batch).cast("bigint")})
        # Rows of a slot together: few files a slot, several tasks where a slot is large.
        spread = named.select(*self._schema().fieldNames()).hint("rebalance", "slot")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "source", "batch").parquet(self.path)

    def read(self, spark: SparkSession, hours: list[int]) -> DataFrame:
        """All counts of these hours, with ``hour``; several rows of a key, from several batches, are to be added up."""
        slots = sorted({h // SLOT_HOURS for h in hours})
        found = read_folder(spark, self._schema(), f"{self.path}/slot={{{','.join(map(str, slots))}}}", self.path) if slots else None
        if found is None:
            found = spark.createDataFrame([], self._schema())
        return found.withColumn("hour", hour_of(F.col("pane"))).where(F.col("hour").isin(hours)).drop("slot")

    @staticmethod
    def _schema() -> T.StructType:
        return T._parse_datatype_string(f"{schemas.PANE_TABLE}, slot bigint, source string, batch bigint")
