"""Helpers that several corpus operators share."""

from __future__ import annotations

import pathlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpulse.session import written as stored


SLICE_ROWS = 512

# For bytes.translate: A-Z to lower case, other ASCII that is no letter or digit to a space.
PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that a text operator reads; a null text becomes empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def row_identity(docs: DataFrame) -> list:
    """Key columns that tell rows with different texts apart: doc_id (null: the lowest) and a digest of the text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("row_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_digest"),
    ]


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow``, over batches of few rows, by workers that find this package also when only the driver's path has it (one
    machine); on a cluster it comes with ``--py-files``."""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    environment = df.sparkSession.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(":")
    if root not in known:
        environment["PYTHONPATH"] = ":".join(filter(None, [root, *known]))
    return df.mapInArrow(lambda batches: function(_slices(batches)), schema)


def _slices(batches):
    """The same rows in smaller batches: Python objects are made for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


# Bit maps take 64 bits an entry, between these bounds: at most 16 MB each.
MAP_BITS = (1 << 20, 1 << 27)


def _bit(values: np.ndarray, bits: int) -> np.ndarray:
    mixed = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _row_mark(row_id, row_digest):
    """One number for a row's identity: rows of one text are told apart by their ids."""
    return F.xxhash64(row_id, row_digest)


def bit_map(values: DataFrame, column: str) -> np.ndarray:
    """Fixed-size map of the bits that the values set."""
    n = values.count()
    bits = min(max(1 << (64 * max(n, 1)).bit_length(), MAP_BITS[0]), MAP_BITS[1])

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(batch.column(0).to_numpy(), bits) + 1)], ["place"])

    set_bits = map_batches(values.select(F.col(column).cast("long")), places, "place long")
    parts = set_bits.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")
    )
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in parts.collect():  # bits / 32768 rows of 4 KB at most
        part = np.frombuffer(bytes(bitmap), np.uint8)
        at = (bucket - 1) * 4096
        out[at:at + len(part)] = part[:len(out) - at]
    return out


def is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = _bit(values, 8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _row_map(rows: DataFrame) -> np.ndarray:
    return bit_map(rows.select(_row_mark("row_id", "row_digest").alias("mark")), "mark")


def _sifted(docs: DataFrame, bits: np.ndarray, known: bool, function=lambda batches: batches, schema=None) -> DataFrame:
    """The rows of ``docs`` whose identity the bit map lets through (``known``) or does not; ``function`` goes on with their batches
    in the same worker."""
    def sift(batches):
        for batch in batches:
            hit = is_set(bits, batch.column("_row_mark").to_numpy())
            yield batch.drop_columns(["_row_mark"]).filter(pa.array(hit if known else ~hit))

    marked = docs.withColumn("_row_mark", _row_mark(*row_identity(docs)))
    return map_batches(marked, lambda batches: function(sift(batches)), schema or docs.schema)


def map_among(docs: DataFrame, rows: DataFrame, function, schema) -> DataFrame:
    """``map_batches`` over at least the rows of ``docs`` whose identity is in ``rows`` (row_id, row_digest), and few others, whatever
    the size of either."""
    return _sifted(docs, _row_map(rows), True, function, schema)


def rows_without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without those whose identity is in ``rows`` (row_id, row_digest). Rows that the bit map of ``rows`` does not know
    stay where they are; only the others, mostly those to be left out, are exchanged."""
    bits = _row_map(rows)
    asked = _sifted(docs, bits, True)
    row_id, row_digest = row_identity(asked)
    same = (row_id == rows["row_id"]) & (row_digest == rows["row_digest"])
    return _sifted(docs, bits, False).unionByName(asked.join(rows, same, "left_anti"))
