"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document if at least ``THRESHOLD`` of its distinct shingles occur there, anywhere. Shingles have five
words, those of a shorter item as many words as it has.

Items are partitioned by size: 1, 2-3, 4-7, 8-15, ... shingles. A partition has a permutation of its own, under which an item's
signature is its least values, its minima, ahead of them the shingles that fewer items have. Of an item with n shingles a document
that contains it lacks at most n - ceil(THRESHOLD * n), so it holds at least one of any n - ceil(THRESHOLD * n) + 1 of them: that is
the number of minima, and no item is missed, however short, however long the document, and wherever its shingles lie. A document is
asked for by the partitions' values of its own shingles; those that hold a minimum are candidates. For each candidate the item's
shingles themselves are looked up in the document and counted.

Documents are read once. What leaves that pass is only what a bit map of the items' minima and shingles lets through; the map's size
is bounded and its errors are removed by the joins. Words are lower-cased runs without ASCII punctuation, so that marks around a
passage do not hide it.

Cases: null and empty texts contain nothing, empty items are contained in nothing; items with the same words are one item, named by
the smallest item_id; texts that share an item_id are items of their own; an item without id contaminates and counts like any
other but has no id to be listed; repeated rows give repeated results; without items nothing is found.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import PLAIN, bit_map, is_set, map_batches, row_identity, rows_without, stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
PARTITIONS = 32
_MULTIPLIERS = np.random.default_rng(17).integers(1 << 62, (1 << 63) - 1, PARTITIONS, dtype=np.uint64) | np.uint64(1)


def plain_words(text: str) -> tuple[bytes, list[int]]:
    """The plain words joined by single spaces, and where each ends (the space behind it included)."""
    words = text.encode("utf-8").translate(PLAIN).split()
    return b" ".join(words), list(itertools.accumulate(len(w) + 1 for w in words))


def runs(ends: list[int], words: int) -> tuple[list[int], list[int]]:
    """Where each run of so many words begins and ends."""
    return [0, *ends[:-1]][:max(0, len(ends) - words + 1)], [e - 1 for e in ends[words - 1:]]


def shingles(text: str) -> tuple[bytes, list[int], list[int]]:
    """The joined words, and where each shingle of an item begins and ends."""
    joined, ends = plain_words(text)
    return joined, *(runs(ends, min(SHINGLE_WORDS, len(ends))) if ends else ([], []))


def partition_of(size: int) -> int:
    return size.bit_length() - 1


def _hashes(joined: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b]) for a, b in zip(starts, ends)], np.uint64)


def key_count(size: int, threshold: float) -> int:
    """How many of an item's shingles are looked up, so that a document that contains it holds one of them."""
    needed = next(n for n in range(max(1, int(threshold * size) - 1), size + 2) if n / size >= threshold or n > size)
    return max(0, size - needed + 1)


def _permuted(hashes: np.ndarray, partition: int) -> np.ndarray:
    return (hashes * _MULTIPLIERS[partition]).view(np.int64)


def _item_rows(items: DataFrame, threshold: float) -> DataFrame:
    """(item, item_id, size, length, part, hashes, shingles), one row per distinct text of an item."""

    def sketch(batches):
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                joined, starts, ends = shingles(text or "")
                if not starts:
                    continue
                own = sorted({joined[a:b] for a, b in zip(starts, ends)})
                hashes = np.array([xxhash.xxh64_intdigest(s) for s in own], np.uint64)
                length = min(SHINGLE_WORDS, joined.count(b" ") + 1)
                rows.append((item_id, joined, len(own), length, partition_of(len(own)), hashes.view(np.int64).tolist(), own))
            if rows:
                types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())]
                names = ["item_id", "words", "size", "length", "part", "hashes", "shingles"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "item_id long, words binary, size int, length int, part int, hashes array<long>, shingles array<string>"
    rows = map_batches(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), sketch, schema)
    rest = [F.first(c).alias(c) for c in ("size", "length", "part", "hashes", "shingles")]
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id"), *rest).withColumn("item", F.xxhash64("words"))


def item_minima(found_items: DataFrame, threshold: float) -> DataFrame:
    """(item, part, length, key): the signature of each item."""
    hashes = found_items.select("item", F.explode("hashes").alias("hash"))
    often = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    counted = hashes.join(often, "hash").groupBy("item").agg(F.collect_list(F.struct("hash", "items")).alias("counted"))

    def least(batches):
        for batch in batches:
            keys = []
            for size, part, own in zip(batch.column("size").to_pylist(), batch.column("part").to_pylist(), batch.column("counted").to_pylist()):
                values = _permuted(np.array([x["hash"] for x in own], np.int64).view(np.uint64), part)
                order = np.lexsort((values.view(np.uint64), [x["items"] for x in own]))
                keys.append(values[order[:key_count(size, threshold)]])
            columns = [*(batch.column(c) for c in ("item", "part", "length")), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "part", "length", "keys"])

    signed = map_batches(found_items.select("item", "size", "part", "length").join(counted, "item"), least, "item long, part int, length int, keys array<long>")
    return signed.select("item", "part", "length", F.explode("keys").alias("key"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, row_digest, item_id, containment): the items that each document contains, by document row identity."""
    found_items = stored(_item_rows(items, threshold), "benchmark-items")
    minima = stored(item_minima(found_items, threshold), "benchmark-minima")
    key_map = bit_map(minima, "key")
    shingle_map = bit_map(found_items.select(F.explode("hashes").alias("hash")), "hash")
    kinds = sorted(tuple(r) for r in found_items.select("length", "part").distinct().collect())  # SHINGLE_WORDS * PARTITIONS at most
    lengths = sorted({length for length, _ in kinds})

    def sketch(batches):
        for batch in batches:
            kept, parts, keys, own = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                joined, ends = plain_words(text.as_py() or "")
                asked_parts, asked_keys, words = [], [], set()
                for length in lengths:
                    starts, stops = runs(ends, length)
                    if not starts:
                        continue
                    hashes = _hashes(joined, starts, stops)
                    known = np.flatnonzero(is_set(shingle_map, hashes))
                    if not len(known):
                        continue
                    words |= {joined[starts[j]:stops[j]] for j in known}
                    for part in (p for n, p in kinds if n == length):
                        values = np.unique(_permuted(hashes[known], part))
                        values = values[is_set(key_map, values)]
                        asked_parts += [part] * len(values)
                        asked_keys += values.tolist()
                if asked_keys:
                    kept.append(i)
                    parts.append(asked_parts)
                    keys.append(asked_keys)
                    own.append(sorted(words))
            if kept:
                ids = [batch.column(c).take(pa.array(kept)) for c in ("row_id", "row_digest")]
                types = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*ids, *(pa.array(c, t) for c, t in zip((parts, keys, own), types))], ["row_id", "row_digest", "parts", "keys", "shingles"]
                )

    rows = docs.select(*row_identity(docs), "text")
    row = ["row_id", "row_digest"]
    schema = "row_id long, row_digest long, parts array<int>, keys array<long>, shingles array<string>"
    near = stored(map_batches(rows, sketch, schema).dropDuplicates(row), "benchmark-candidates")
    asked = near.select(*row, F.explode(F.arrays_zip("parts", "keys")).alias("x")).select(*row, F.col("x.parts").alias("part"), F.col("x.keys").alias("key"))
    candidates = stored(asked.join(minima, ["part", "key"]).select(*row, "item").distinct(), "benchmark-pairs")
    # Only shingles of the candidates: one that all items have is looked up for no others.
    wanted = candidates.join(found_items.select("item", "item_id", "size", F.explode("shingles").alias("shingle")), "item")
    held = near.select(*row, F.explode("shingles").alias("shingle"))
    counted = wanted.join(held, [*row, "shingle"]).groupBy(*row, "item").agg(
        F.count(F.lit(1)).alias("shared"), F.first("size").alias("size"), F.first("item_id").alias("item_id")
    )
    verified = counted.withColumn("containment", F.col("shared") / F.col("size"))
    return verified.where(F.col("containment") >= threshold).select(*row, "item_id", "containment")


def decontamination_report(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, contaminated, n_items, items, containment) for every document: the items contained, ascending, and the
    greatest containment (null if none)."""
    found = contained_items(docs, items, threshold).groupBy("row_id", "row_digest").agg(
        F.sort_array(F.collect_list("item_id")).alias("items"), F.count(F.lit(1)).cast("int").alias("n_items"),
        F.max("containment").alias("containment"),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_identity(docs))
    return rows.join(found, ["row_id", "row_digest"], "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"), "containment",
    )


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    found = contained_items(docs, items, threshold).select("row_id", "row_digest").distinct()
    return rows_without(docs, stored(found, "contaminated-documents"))
