"""Running sums over a whole table, in a stated order within groups of any size.

Rows are dealt to ranges of (groups, order), sorted there and written once. Sums inside a range, sums of the ranges ahead of it
(one row per range and group) and group totals then give every row its place. No group is gathered in one task: a group with
most of the rows spans most of the ranges, and rows equal in all columns are told apart by their place in the input, so that
they too are spread. Which of them gets which place makes no difference to the result.

Cases: null is a value like any other in ``groups`` and comes first in ``order``; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpulse.llm.common import stored


def running_sums(rows: DataFrame, groups: list[str], order: list[str], weights: dict[str, Column]) -> DataFrame:
    """``rows`` with, for every name in ``weights``, ``<name>_before`` (the sum over the rows ahead in its group) and
    ``<name>_total`` (over the group). ``rows`` must be a written table: it is read more than once."""
    names = list(weights)
    keyed = rows.withColumns({**weights, "_spread": F.monotonically_increasing_id()})
    ends = [*groups, *order, "_spread"]
    ranged = keyed.repartitionByRange(*ends).sortWithinPartitions(*ends).drop("_spread")
    ranged = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")

    ahead = Window.partitionBy("_part", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({f"_in_{n}": F.coalesce(F.sum(n).over(ahead), F.lit(0)) for n in names})

    parts = ranged.groupBy("_part", *groups).agg(*[F.sum(n).alias(n) for n in names])
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(parts.select(
        F.col("_part").alias("_of"), *[F.col(g).alias(f"_of_{g}") for g in groups],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_start_{n}") for n in names],
        *[F.sum(n).over(group).alias(f"{n}_total") for n in names],
    ), "range-starts")
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups), F.col("_part") == F.col("_of"))
    joined = placed.join(starts, same)
    kept = [c for c in rows.columns if c not in names]
    return joined.select(
        *kept, *[(F.col(f"_in_{n}") + F.col(f"_start_{n}")).alias(f"{n}_before") for n in names], *[f"{n}_total" for n in names]
    )
