"""Near-duplicates by SimHash and multi-index hashing.

A document's fingerprint has a bit set where over half the hashes of its word shingles have it set. Documents whose
fingerprints differ in two bits at most are linked; classes are the connected components of the links. Equal
fingerprints are one node, so that copies of any number cost one row.

Multi-index hashing: a fingerprint is cut into two segments of 32 bits. If two fingerprints differ in two bits at most,
then either one segment is equal, or each segment differs in one bit. So a fingerprint looks up, in the table of its first
segment, all values of the ball of radius one, and in the table of its second segment its own value. What is left of the
distance bounds the other segment too, so table entries also carry a part of that one:

* segment equal: the other differs in two bits at most, and one of its three parts is equal;
* first segment one bit off: the second differs in one bit at most, and one of its two halves is equal.

The part belongs to the join key. A value that many fingerprints share in one segment is thereby dealt out by the other
segment instead of forming one large entry. Every match is verified with the complete distance.

Cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle make one
shingle of all words; null doc_ids never name a class unless it has no other; repeated rows give repeated results.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import keyed_text, map_batches, row_identity, stored
from tillpulse.llm.components import components, one_row_of_each

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
_SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    last = min(shingle_words, len(words)) - 1
    digest, total, counts = xxhash.xxh64_intdigest, len(words) - last, np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        block = zip(starts[at:min(at + _BLOCK, total)], ends[at + last:])
        hashes = np.array([digest(joined[a:b - 1], _SEED) for a, b in block], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``rows`` with ``fingerprint`` (the 64 bits as a signed long) in the place of ``text``."""
    keys = [c for c in rows.columns if c != "text"]

    def compute(batches):
        for batch in batches:
            bits = np.array([fingerprint(t or "", shingle_words) for t in batch.column("text").to_pylist()], np.uint64)
            columns = [batch.column(c) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bits.view(np.int64))], [*keys, "fingerprint"])

    return map_batches(rows, compute, rows.drop("text").withColumn("fingerprint", F.lit(0).cast("long")).schema)


def _bits(value, start: int, width: int):
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


# Parts of the other segment (start, width), by the distance that the segment itself leaves for it.
_PARTS = {2: ((0, 11), (11, 11), (22, 10)), 1: ((0, 16), (16, 16))}


def _entries(bits, segment: int, left: int, segment_value=None) -> list:
    """Keys in the table of ``segment`` (0: high half) for a distance of ``left`` in the other segment. The key is a hash of
    table, segment value and part; what it confuses, the verification tells apart."""
    own, other = (32, 0) if segment == 0 else (0, 32)
    value = _bits(bits, own, 32) if segment_value is None else segment_value
    return [
        F.xxhash64(F.lit(100 * segment + 10 * left + i), value, _bits(bits, other + at, width))
        for i, (at, width) in enumerate(_PARTS[left])
    ]


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b, each once: all pairs of distinct ``fingerprint`` values that differ in 1 or 2 bits."""
    bits = F.col("fingerprint")
    equal = _entries(bits, 0, 2) + _entries(bits, 1, 2)
    high = _bits(bits, 32, 32)
    ball = [key for i in range(32) for key in _entries(bits, 0, 1, high.bitwiseXOR(F.lit(1 << i).cast("long")))]
    listed = nodes.select(bits.alias("b"), F.explode(F.array(*equal, *_entries(bits, 0, 1))).alias("key"))
    asked = nodes.select(bits.alias("a"), F.explode(F.array(*equal, *ball)).alias("key"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = asked.join(listed, (asked["key"] == listed["key"]) & (F.col("a") < F.col("b")) & (distance <= MAX_DISTANCE))
    return found.select("a", "b").distinct()


def fingerprint_roots(nodes: DataFrame) -> DataFrame:
    """``nodes`` (one row per ``fingerprint``) with ``root``, the same for all fingerprints of a class."""
    roots = components(near_pairs(nodes))
    joined = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").drop("node")
    return joined.withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): ``component_id`` is the smallest doc_id that links reach, itself included."""
    marked = stored(fingerprints(keyed_text(docs)), "fingerprints")
    nodes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")), "fingerprint-nodes")
    rooted = fingerprint_roots(nodes)
    firsts = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = stored(rooted.join(firsts, "root").select("fingerprint", "component_id"), "fingerprint-classes")
    return marked.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per class, that with the smallest doc_id (null: smallest of all), with its columns. Of rows equal in
    doc_id and text any one stays."""
    row = ["row_id", "row_digest"]
    marked = stored(fingerprints(docs.select(*row_identity(docs), "text")), "fingerprints")
    nodes = stored(marked.groupBy("fingerprint").agg(F.min(F.struct(*row)).alias("first")), "fingerprint-nodes")
    return one_row_of_each(docs, marked, fingerprint_roots(nodes))
