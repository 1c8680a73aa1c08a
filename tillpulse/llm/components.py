"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to smaller neighbours; after a number of rounds that grows with the logarithm of the
longest path, every node is linked to the smallest node of its component and to nothing else. Neighbours' minima are
aggregates with a partial step, and they are joined back from a written table, so that the adaptive join can split the
links of a node with very many. Each round is written to the shared folder; only row counts and checksums come to the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import row_identity, rows_without, stored


def _state(links: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.shiftright(mark, 20)), F.bit_xor(mark)).first())


def _with_minimum(links: DataFrame) -> DataFrame:
    """(node, neighbour) with the smallest of the node and all its neighbours."""
    lowest = stored(links.groupBy("node").agg(F.least("node", F.min("neighbour")).alias("lowest")), "lowest")
    return links.join(lowest, "node")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (columns a, b); ``root`` is the smallest node it can reach."""
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("neighbour"))
        both = both.unionByName(both.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour")))
        large = _with_minimum(both).where("neighbour > node").select(F.col("neighbour").alias("a"), F.col("lowest").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-stars")
        down = large.select(F.col("a").alias("node"), F.col("b").alias("neighbour"))
        small = _with_minimum(down)
        small = small.select(F.col("neighbour").alias("a"), F.col("lowest").alias("b")).unionByName(
            small.select(F.col("node").alias("a"), F.col("lowest").alias("b"))
        )
        links = stored(small.where("a <> b").distinct(), "small-stars")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def one_row_of_each(docs: DataFrame, marked: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``docs`` per ``root``, that with the smallest ``first``. ``marked`` has the row identity of all rows,
    ``rooted`` (first, root) the smallest row identity of each node."""
    row = ["row_id", "row_digest"]
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    dropped = stored(marked.select(*row).distinct().join(kept, row, "left_anti"), "dropped-documents")
    left = rows_without(docs, dropped)
    repeated = marked.groupBy(*row).count().where("count > 1").limit(1).count()
    if not repeated:
        return left
    keyed = left.select(F.struct(*left.columns).alias("_whole"), *row_identity(left))
    return keyed.dropDuplicates(row).select("_whole.*")
