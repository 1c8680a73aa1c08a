"""Last write wins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F


def latest_rows(
    df: DataFrame, key_cols: list[str], order_cols: list[str], null_is_value: bool = False
) -> DataFrame:
    """One row per key, the one with the greatest ``order_cols``.

    Rows with a NULL in the key all stay, like documents saved without an id, unless
    ``null_is_value`` says that NULL is a key value like any other.

    An aggregate rather than a ranking window: every task reduces a key to one row before the
    shuffle, so a key with very many versions does not fill one task.
    """
    others = [c for c in df.columns if c not in key_cols]
    versions = F.max_by(F.struct(*others), F.struct(*order_cols, *[c for c in others if c not in order_cols]))

    def newest(rows: DataFrame) -> DataFrame:
        picked = rows.groupBy(*key_cols).agg(versions.alias("row"))
        return picked.select(*key_cols, "row.*").select(*df.columns)

    if null_is_value:
        return newest(df)
    has_key = reduce(and_, (F.col(name).isNotNull() for name in key_cols))
    return newest(df.where(has_key)).unionByName(df.where(~has_key))


def last_rows(df: DataFrame, key_cols: list[str], order_cols: list[str], null_is_value: bool = False) -> DataFrame:
    """The same rows as ``latest_rows``, for wide rows in large number: a row is carried through the shuffle once, as its own order,
    where ``max_by`` carries it and what it is compared by."""
    others = [*order_cols, *[c for c in df.columns if c not in (*key_cols, *order_cols)]]

    def newest(rows: DataFrame) -> DataFrame:
        picked = rows.groupBy(*key_cols).agg(F.max(F.struct(*others)).alias("row"))
        return picked.select(*key_cols, "row.*").select(*df.columns)

    if null_is_value:
        return newest(df)
    has_key = reduce(and_, (F.col(name).isNotNull() for name in key_cols))
    return newest(df.where(has_key)).unionByName(df.where(~has_key))


# Keys with several rows that are sent to every task; with more of them all rows are settled.
FEW_KEYS = 10_000


def last_rows_of_few(df: DataFrame, key_cols: list[str], order_cols: list[str], null_is_value: bool = False) -> DataFrame:
    """The same rows as ``last_rows``, for data that is read from files: keys are counted at once, a shuffle of keys alone, and
    only the rows of keys that occur several times are settled. The others stay where they are, and columns that nobody
    asks for are not read. Where more than ``FEW_KEYS`` keys occur several times all rows are settled."""
    counts = df.groupBy(*key_cols).count().where(F.col("count") > 1)
    if not null_is_value:
        counts = counts.where(reduce(and_, (F.col(k).isNotNull() for k in key_cols)))
    again = counts.select(*key_cols).limit(FEW_KEYS + 1).collect()
    if not again:
        return df
    if len(again) > FEW_KEYS:
        return last_rows(df, key_cols, order_cols, null_is_value)
    named = df.sparkSession.createDataFrame(again, df.select(*key_cols).schema).toDF(*[f"_{k}" for k in key_cols])
    same = reduce(and_, (
        df[k].eqNullSafe(F.col(f"_{k}")) if null_is_value else df[k] == F.col(f"_{k}") for k in key_cols
    ))
    once = df.join(F.broadcast(named), same, "left_anti")
    return once.unionByName(last_rows(df.join(F.broadcast(named), same, "left_semi"), key_cols, order_cols, null_is_value))


# Of changes that arrive at the same moment the later of these counts.
OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def apply_changes(
    changes: DataFrame, key_cols: list[str], order_cols: list[str], operation: str = "event_type"
) -> DataFrame:
    """The rows that are left after all changes: of each key the after-image of its last one, none if that is a deletion.

    ``changes`` has the columns of the table and the operation; a key may be inserted again after its deletion. Rows are
    reduced to one per key and task before the shuffle, deletions are dropped only after all changes of a key have met.
    """
    at = F.array_position(F.array(*map(F.lit, OPERATIONS)), F.upper(operation))
    ranked = changes.withColumn("_operation", at)
    last = latest_rows(ranked, key_cols, [*order_cols, "_operation"], null_is_value=True)
    return last.where(F.col("_operation") < len(OPERATIONS)).drop("_operation", operation)


def first_rows(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order_cols``, then the smallest other columns."""
    others = [*order_cols, *[c for c in df.columns if c not in (*key_cols, *order_cols)]]
    picked = df.groupBy(*key_cols).agg(F.min(F.struct(*others)).alias("row"))
    return picked.select(*key_cols, "row.*").select(*df.columns)
