"""Keyed table on Parquet: one row per key, settled when the table is read.

A micro-batch is one plain folder, ``batches/source=<stream>/batch=<number>``. Writing costs what the batch holds; a replayed
batch overwrites its own folder, and a stream with a fresh checkpoint is another source. Of the rows of a key the one with
the greatest ``order`` stays, of equal ones the one written last; with ``first`` the smallest ``order``, whenever it was
written. So it makes no difference in which order batches are written or how often.

``compact`` reads, aggregates and writes a new table folder: all rows but those of each stream's last batch, settled, in
``base``, with a sub-folder per day. The last batch stays a batch, because a stream may still replay it. Streams then go on with the new
folder. Reading takes the base as it is and settles only keys that batches hold; to read a whole table, keys are counted first, and
where few occur several times only their rows are shuffled.

Batches are flat files sorted by the partition columns: a batch of a few seconds must not become a file per day and task. A
filter on the day skips sub-folders of the base and row groups of the batches.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tillpulse.operators.latest import first_rows, last_rows, last_rows_of_few

_WRITTEN = T.StructField("written_at", T.TimestampType())


def read_folder(spark: SparkSession, schema: T.StructType, path: str, base: str | None = None) -> DataFrame | None:
    """The rows below ``path``; nothing if there is no such folder yet."""
    try:
        return spark.read.schema(schema).option("basePath", base or path).parquet(path).select(*schema.fieldNames())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class KeyedTable:
    path: str
    schema: str | T.StructType
    keys: list[str]
    order: list[str] = field(default_factory=list)
    # Put partition columns into ``keys``: only then may a filter on them skip data.
    partition_by: list[str] = field(default_factory=list)
    # Whether NULL in a key column is a value; otherwise such rows have no key and all stay.
    null_is_value: bool = False
    first: bool = False
    # A boolean column: where it is true in the row that stays, the key is deleted.
    tombstone: str | None = None

    def columns(self) -> list[str]:
        return self._fields().fieldNames()

    def upsert(self, df: DataFrame, batch: int, source: str = "load") -> str:
        """Write one batch and give its folder; several rows of a key are settled when reading."""
        rows = df.select(*self.columns(), F.lit(dt.datetime.now(dt.timezone.utc)).alias("written_at"))
        if self.partition_by:
            rows = rows.sortWithinPartitions(*self.partition_by)
        target = f"{self.path}/batches/source={quote(source, safe='')}/batch={batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(target)
        return target

    def latest(self, spark: SparkSession, but: tuple[str, int] | None = None) -> DataFrame:
        """One row per key; deleted keys have none. ``but``: as if this batch (source, number) had not been written."""
        return self._alive(self._latest(spark, self._base(spark), self._batches(spark, but), whole=True))

    def lookup(self, spark: SparkSession, wanted: DataFrame, but: tuple[str, int] | None = None) -> DataFrame:
        """The latest rows of the keys in ``wanted`` only: other rows are dropped before they are settled."""
        keys = wanted.select(*self.keys).distinct()
        base, batches = (
            rows if rows is None else rows.join(keys, self.keys, "left_semi") for rows in (self._base(spark), self._batches(spark, but))
        )
        return self._alive(self._latest(spark, base, batches))

    def effect(self, rows: DataFrame, batch: int, source: str) -> tuple[DataFrame, DataFrame]:
        """The latest rows of the keys of a batch without it and with it, whether it has been written already or not."""
        before = self.lookup(rows.sparkSession, rows, (source, batch))
        own = rows.select(*self.columns(), F.current_timestamp().alias("written_at"))
        both = own.unionByName(before.withColumn("written_at", F.lit(None).cast("timestamp")))
        return before, self._alive(self._settled(both))

    def compact(self, spark: SparkSession, path: str) -> KeyedTable:
        """The same table in a new folder, all but the last batch of each source settled. Run it while no stream writes."""
        target = replace(self, path=path)
        batches = self._batches(spark)
        older = None
        if batches is not None:
            newest = batches.groupBy("source").agg(F.max("batch").alias("batch"))  # a row per stream
            batches.join(newest, ["source", "batch"], "left_semi").write.partitionBy("source", "batch").parquet(f"{path}/batches")
            older = batches.join(newest, ["source", "batch"], "left_anti")
        merged = self._latest(spark, self._base(spark), older, whole=True)
        if not self.partition_by:
            merged.write.parquet(f"{path}/base")
            return target
        # Ranges over day and key: a task writes few days, and a day with much data has many tasks.
        by_range = merged.repartitionByRange(*self.partition_by, *[k for k in self.keys if k not in self.partition_by])
        by_range.sortWithinPartitions(*self.partition_by).write.partitionBy(*self.partition_by).parquet(f"{path}/base")
        return target

    def _latest(self, spark: SparkSession, base: DataFrame | None, batches: DataFrame | None, whole: bool = False) -> DataFrame:
        if batches is None:
            return spark.createDataFrame([], self._fields()) if base is None else base
        batches = batches.drop("source", "batch")
        if base is None:
            return self._settled(batches, whole)
        changed = batches.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        same = reduce(and_, (
            base[k].eqNullSafe(F.col(f"_{k}")) if self.null_is_value else base[k] == F.col(f"_{k}") for k in self.keys
        ))
        # Whatever its order value, a row of the base was written before those of the batches.
        earlier = base.join(changed, same, "left_semi").withColumn("written_at", F.lit(None).cast("timestamp"))
        return base.join(changed, same, "left_anti").unionByName(self._settled(batches.unionByName(earlier), whole))

    def _settled(self, rows: DataFrame, whole: bool = False) -> DataFrame:
        if self.first:
            return first_rows(rows.drop("written_at"), self.keys, self.order)
        settle = last_rows_of_few if whole else last_rows
        return settle(rows, self.keys, [*self.order, "written_at"], self.null_is_value).drop("written_at")

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(F.col(self.tombstone), F.lit(False))) if self.tombstone else rows

    def _fields(self) -> T.StructType:
        return self.schema if isinstance(self.schema, T.StructType) else T._parse_datatype_string(self.schema)

    def _base(self, spark: SparkSession) -> DataFrame | None:
        return read_folder(spark, self._fields(), f"{self.path}/base")

    def _batches(self, spark: SparkSession, but: tuple[str, int] | None = None) -> DataFrame | None:
        named = [_WRITTEN, T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())]
        found = read_folder(spark, T.StructType([*self._fields().fields, *named]), f"{self.path}/batches")
        if found is None or but is None:
            return found
        return found.where((F.col("source") != but[0]) | (F.col("batch") != but[1]))
