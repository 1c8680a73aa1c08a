"""Sharding by a Feistel permutation with cycle walking (law ``rows``).

Documents get global row numbers 0..n-1 in an order that depends on their content only. A keyed Feistel permutation of
0..n-1 sends each number to a position; ``position mod shards`` is the shard and ``position div shards`` the slot, so
shards differ by one row at most, slots have no gaps, and both can be computed from a row number alone.

The permutation works on pairs (x div b, x mod b) with a * b >= n and a * b - n < b, b about the root of n. A value that
lands in n..a*b-1 is permuted again until it falls below n. How often that can be needed is found exactly beforehand
from the fewer than b values outside.

DataFrame functions only. Rows travel as (doc_id, size, checksum); texts are not shuffled.

Cases: a null text has size 16 and checksum 0; null and repeated doc_ids are ordinary keys; equal rows are counted before
they are dealt, so that a group of copies of any size is one row in the shuffles; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpulse.llm.common import stored

ROUNDS = 6
# Row numbers are counted off in this many groups; the groups' counts are the only broadcast table.
NUMBERING_GROUPS = 4096
# Copies of a row are numbered in chunks of this many, dealt out to all tasks.
CHUNK_ROWS = 1 << 14


def _sides(n: int) -> tuple[int, int]:
    b = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return max(1, -(-n // b)), b


def _round(value: Column, seed: int, number: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed), F.lit(number)), F.lit(modulus))


def _feistel(df: DataFrame, source: str, target: str, a: int, b: int, seed: int) -> DataFrame:
    """``target``: ``source`` under the permutation of 0..a*b-1."""
    left, right = f"_{target}_left", f"_{target}_right"
    df = df.withColumns({right: F.pmod(F.col(source), F.lit(b))})
    df = df.withColumn(left, F.expr(f"`{source}` div {b}"))
    for i in range(ROUNDS):
        if i % 2 == 0:
            df = df.withColumn(left, F.pmod(F.col(left) + _round(F.col(right), seed, i, a), F.lit(a)))
        else:
            df = df.withColumn(right, F.pmod(F.col(right) + _round(F.col(left), seed, i, b), F.lit(b)))
    return df.withColumn(target, F.col(left) * F.lit(b) + F.col(right)).drop(left, right)


def walk_depth(spark: SparkSession, n: int, seed: int) -> int:
    """How often a value of 0..n-1 may have to be permuted again."""
    a, b = _sides(n)
    outside = spark.range(n, a * b).select(F.col("id").alias("first"), F.col("id").alias("x"))
    depth = 0
    while outside.limit(1).count():
        depth += 1
        # A walk that returns to its start never meets a value below n.
        outside = _feistel(outside, "x", "y", a, b, seed).where((F.col("y") >= n) & (F.col("y") != F.col("first")))
        outside = outside.select("first", F.col("y").alias("x"))
    return depth


def permute(df: DataFrame, number: str, position: str, n: int, seed: int) -> DataFrame:
    """``position``: the place of row ``number`` (0..n-1) in the shuffled order of n rows."""
    a, b = _sides(n)
    df = _feistel(df, number, position, a, b, seed)
    for _ in range(walk_depth(df.sparkSession, n, seed)):
        again = _feistel(df, position, "_again", a, b, seed)
        df = again.withColumn(position, F.when(F.col(position) < n, F.col(position)).otherwise(F.col("_again"))).drop("_again")
    return df


def row_numbers(rows: DataFrame, keys: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """Rows of ``keys`` numbered 0..n-1 without gaps, in an order that only their values decide; and n."""
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    copies = copies.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(NUMBERING_GROUPS)).cast("int"))
    copies = stored(copies, "row-numbers")  # keys only: the wide input is read once
    n = copies.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    sizes = copies.groupBy("_group").agg(F.sum("_copies").alias("_rows"))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    # NUMBERING_GROUPS rows at most, whatever the input.
    starts = F.broadcast(sizes.select("_group", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")))
    within = Window.partitionBy("_group").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    before = F.coalesce(F.sum("_copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = copies.withColumn("_before", before).join(starts, "_group")
    first = F.col("_start") + F.col("_before")
    chunks = F.sequence(first, first + F.col("_copies") - 1, F.lit(CHUNK_ROWS).cast("long"))
    dealt = numbered.select(*keys, (first + F.col("_copies")).alias("_end"), F.explode(chunks).alias("_from")).repartition("_from")
    last = F.least(F.col("_from") + CHUNK_ROWS, F.col("_end")) - 1
    return dealt.select(*keys, F.explode(F.sequence("_from", last)).alias(number)), n


def feistel_shards(docs: DataFrame, shards: int = 40, seed: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, law, row_number, position, shard, slot, grown_shard: one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = row_numbers(thin, ["doc_id", "size", "text_crc32"])
    placed = permute(numbered, "row_number", "position", n, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number", "position",
        F.pmod(F.col("position"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
