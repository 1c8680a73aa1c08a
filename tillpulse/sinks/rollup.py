"""Sums kept as mergeable parts: every batch adds the change that it makes, reading adds the parts up.

``parts/source=<stream>/batch=<number>``: a replayed batch overwrites its own part. ``compact`` writes the sums of all parts but each
stream's last one to a new folder, like that of a keyed table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillpulse.sinks.keyed import read_folder


_COMPACTED = "compacted"


def net_change(before: DataFrame, after: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``by`` and the change of every sum between two states of some rows; groups in which nothing changes are left out."""
    added = after.select(*by, *[c.alias(name) for name, c in sums.items()])
    taken = before.select(*by, *[(-c).alias(name) for name, c in sums.items()])
    change = added.unionByName(taken).groupBy(*by).agg(*[F.sum(name).alias(name) for name in sums])
    return change.where(reduce(or_, (F.col(name) != 0 for name in sums)))


@dataclass(frozen=True)
class Rollup:
    path: str
    by: str  # as a schema
    sums: str

    def add(self, change: DataFrame, batch: int, source: str = "load") -> None:
        fields = self._schema(self.by, self.sums)
        rows = change.select(*[F.col(f.name).cast(f.dataType) for f in fields])
        rows.write.mode("overwrite").parquet(f"{self.path}/parts/source={quote(source, safe='')}/batch={batch}")

    def totals(self, spark: SparkSession) -> DataFrame:
        """A row per group."""
        parts = self._parts(spark)
        if parts is None:
            return spark.createDataFrame([], self._schema(self.by, self.sums))
        return self._added(parts)

    def compact(self, spark: SparkSession, path: str) -> Rollup:
        """The same sums in a new folder. Run it while no stream writes."""
        parts = self._parts(spark)
        if parts is not None:
            # A row per stream; sums of an earlier compaction are no stream and can be added up.
            newest = parts.where(~F.col("source").startswith(_COMPACTED)).groupBy("source").agg(F.max("batch").alias("batch"))
            parts.join(newest, ["source", "batch"], "left_semi").write.partitionBy("source", "batch").parquet(f"{path}/parts")
            older = self._added(parts.join(newest, ["source", "batch"], "left_anti"))
            older.write.parquet(f"{path}/parts/source={_COMPACTED}/batch=0")
        return replace(self, path=path)

    def _added(self, parts: DataFrame) -> DataFrame:
        sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in self._schema(self.sums)]
        return parts.groupBy(*self._schema(self.by).fieldNames()).agg(*sums)

    def _parts(self, spark: SparkSession) -> DataFrame | None:
        return read_folder(spark, self._schema(self.by, self.sums, "source string, batch bigint"), f"{self.path}/parts")

    @staticmethod
    def _schema(*parts: str) -> T.StructType:
        return T._parse_datatype_string(", ".join(parts))
