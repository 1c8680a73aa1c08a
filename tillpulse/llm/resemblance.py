"""Near-duplicates: SimHash by multi-index hashing, completed to all pairs of a given resemblance.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is ``LEAST_SIMILARITY`` at least; classes
are the connected components of the links. Documents with the same set of shingles are one node, so that copies of any number
cost one row. Every link is verified by the shingles themselves. Candidates come in three steps:

1. **SimHash** over the five-word shingles: nodes with equal fingerprints, and fingerprints that differ in two bits at most
   (``simhash.near_pairs``). This finds the closest copies, but few pairs near the threshold: they differ in about ten bits.
2. **Rarest shingles.** A pair of sizes x <= y that is similar enough shares a shingle among the ``y - ceil(0.8 y) + 1`` first
   shingles of the larger set and the ``x - ceil(8 x / 9) + 1`` first of the smaller one, in any order common to all. The order
   is that of a count sketch of fixed size, rarest first, so that what thousands of pages have in common comes last and is
   not looked up. Each node meets the one node of a shingle in which that shingle comes earliest: one pair a row.
3. **The rest.** Shingles whose nodes are now in one class need nothing more, links within a class do not change it. In the
   others a node meets those of other classes whose size leaves enough behind the shingle in both sets: by buckets of
   sizes, so that what a set cannot be similar to is not even looked at.

No pair is missed: step 2 only saves pairs that step 3 would look at. Pages of one template that are not similar enough meet
in step 3 only as far as their own shingles fill less than a ninth of them.

Cases: null and empty texts have no shingles and are one class; fewer words than a shingle make one shingle of all words.
Words are those of the SimHash fingerprints. Shingles and sets are told apart by 64 bits of hash.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpulse.llm import simhash
from tillpulse.llm.common import bit_map, is_set, map_among, map_batches, row_identity, stored
from tillpulse.llm.components import components, one_row_of_each

SHINGLE_WORDS = 5
LEAST_SIMILARITY = (4, 5)  # as a fraction, so that all comparisons are exact
# Counters of the sketch, in chunks of so many; a task's counters stop at 255.
SLOTS, CHUNK = 1 << 20, 1 << 12
SIZE_BUCKET = 1.25
_BLOCK = 1 << 15


def shingle_hashes(text: str) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    last = min(SHINGLE_WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b - 1]) for a, b in zip([0, *ends], ends[last:])], np.uint64))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash bits: set where over half the shingles have them set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def least_shared(size: int, other: int) -> int:
    """How many shingles sets of these sizes share at least, to be similar enough."""
    over, under = LEAST_SIMILARITY
    return -(-over * (size + other) // (over + under))


def prefix_length(size: int) -> int:
    """How many of a set's first shingles are looked up, also by smaller sets."""
    over, under = LEAST_SIMILARITY
    return size - -(-over * size // under) + 1 if size else 0


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def signatures(rows: DataFrame) -> DataFrame:
    """(row_id, row_digest, node, size, fingerprint) per row; and per task (chunk, counts), its part of the count sketch."""
    row = ["row_id", "row_digest"]

    def compute(batches):
        sketch = np.zeros(SLOTS, np.int64)
        for batch in batches:
            nodes, sizes, prints = [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py() or "")
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                prints.append(fingerprint(hashes))
                np.add.at(sketch, slots(hashes), 1)
            n = len(nodes)
            columns = [*(batch.column(c) for c in row), _signed(nodes), pa.array(sizes, pa.int32()), _signed(prints)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], [*row, "node", "size", "fingerprint", "chunk", "counts"]
            )
        if sketch.any():
            parts = np.minimum(sketch, 255).astype(np.uint8).reshape(-1, CHUNK)
            empty = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                [*row, "node", "size", "fingerprint", "chunk", "counts"],
            )

    schema = "row_id long, row_digest long, node long, size int, fingerprint long, chunk int, counts binary"
    return map_batches(rows.select(*row, "text"), compute, schema)


def count_sketch(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters (chunk, counts)."""
    def added(batches):
        sums = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                own = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
                sums[chunk] = sums.get(chunk, 0) + own
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])

    out = np.zeros(SLOTS, np.int64)
    for chunk, sums in map_batches(parts.repartition("chunk"), added, "chunk int, sums binary").collect():  # a fixed size
        out[chunk * CHUNK:(chunk + 1) * CHUNK] += np.frombuffer(bytes(sums), np.int64)
    return out.astype(np.int32) if out.max(initial=0) < 1 << 31 else out


def prefixes(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, size, keys) per row: the first shingles of its set, rarest first."""
    def compute(batches):
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py() or "")
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                order = np.lexsort((hashes, counts[slots(hashes)]))[:prefix_length(len(hashes))]
                keys.append(hashes[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [_signed(nodes), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["node", "size", "keys"]
            )

    return map_batches(rows.select("text"), compute, "node long, size int, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose similarity is large enough, by the shingles of the nodes' first documents."""
    pairs = stored(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "alike-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(nodes.join(wanted, "node").select("node", "first.row_id", "first.row_digest"), "alike-nodes")

    def hashed(batches):
        for batch in batches:
            sets = [shingle_hashes(t.as_py() or "").tobytes() for t in batch.column("text")]
            nodes = _signed([xxhash.xxh3_64_intdigest(s) for s in sets])
            yield pa.RecordBatch.from_arrays([nodes, pa.array(sets, pa.binary())], ["node", "shingles"])

    # Nodes that the bit map lets through by error find no pair below.
    sets = map_among(docs.select("doc_id", "text"), wanted, hashed, "node long, shingles binary")
    sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "alike-shingles")

    def similar(batches):
        over, under = LEAST_SIMILARITY
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("shingles_a"), batch.column("shingles_b"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared * under >= (len(x) + len(y) - shared) * over:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int32())) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(sets.toDF("a", "shingles_a"), "a").join(sets.toDF("b", "shingles_b"), "b")
    return map_batches(both, similar, "a long, b long")


def alike_prefixes(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose prefixes have enough in common. What two sets share is in both prefixes, or behind the prefix
    that ends first; so few common keys rule a pair out by a fifth of its shingles."""
    pairs = stored(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    bits = bit_map(stored(wanted, "met-nodes"), "node")

    def asked(batches):
        for batch in batches:
            yield batch.filter(pa.array(is_set(bits, batch.column("node").to_numpy())))

    near = stored(map_batches(keyed.select("node", "size", "keys"), asked, "node long, size int, keys array<long>"), "met-prefixes")
    both = pairs.join(near.toDF("a", "size_a", "keys_a"), "a").join(near.toDF("b", "size_b", "keys_b"), "b")
    over, under = LEAST_SIMILARITY
    size = {side: F.col(f"size_{side}").cast("long") for side in ("a", "b")}
    needed = F.ceil((size["a"] + size["b"]) * over / (over + under))
    behind = F.greatest(*[size[side] - F.size(f"keys_{side}") for side in ("a", "b")])
    return both.where(F.size(F.array_intersect("keys_a", "keys_b")) >= needed - behind).select("a", "b")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes with equal fingerprints, each with one of them; and one node each of fingerprints two bits apart at most."""
    named = nodes.where("size > 0").select("node", "fingerprint")
    heads = stored(named.groupBy("fingerprint").agg(F.min("node").alias("head")), "fingerprint-heads")
    equal = named.join(heads, "fingerprint").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = simhash.near_pairs(heads.select("fingerprint"))
    for side in ("a", "b"):
        near = near.join(heads.select(F.col("fingerprint").alias(side), F.col("head").alias(f"node_{side}")), side)
    return equal.unionByName(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _may_be_similar(a: str, b: str) -> Column:
    """Whether sizes and what stands behind the common shingle in both sets allow the similarity."""
    over, under = LEAST_SIMILARITY
    size = [F.col(f"{side}.size").cast("long") for side in (a, b)]
    behind = F.least(*[s - F.col(f"{side}.at") for s, side in zip(size, (a, b))])
    return (F.least(*size) * under >= F.greatest(*size) * over) & (behind * (over + under) >= (size[0] + size[1]) * over)


def _bucket(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / math.log(SIZE_BUCKET)).cast("int")


def key_members(keyed: DataFrame) -> DataFrame:
    """(node, size, at, key): the keys of ``keyed`` (node, size, keys) that several nodes have, ``at`` their places. Most keys are their
    node's alone; a bit map of the others keeps those from leaving their task."""
    keys = keyed.select(F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
    bits = bit_map(shared, "key")

    def known(batches):
        for batch in batches:
            lists = batch.column("keys")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy()[ends[0]:ends[-1]]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.arange(len(values)) - (ends[:-1] - ends[0])[owner]
            kept = np.flatnonzero(is_set(bits, values))
            columns = [batch.column(c).take(pa.array(owner[kept])) for c in ("node", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[kept], pa.int32()), pa.array(values[kept])], ["node", "size", "at", "key"])

    listed = map_batches(keyed.select("node", "size", "keys"), known, "node long, size int, at int, key long")
    return stored(listed.join(shared, "key", "left_semi"), "key-members")


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every node of a key with that in which the key comes earliest."""
    # Few shingles of its own come before it: of copies with edits, the one with the fewest.
    heads = members.groupBy("key").agg(F.min(F.struct("at", "node", "size")).alias("head"))
    a = stored(heads.select("key", "head.*"), "key-heads").alias("a")
    b = members.alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node")) & _may_be_similar("a", "b")
    return a.join(b, met).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def other_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a the smaller one: all pairs of different classes that share a key and may be similar."""
    rooted = stored(members.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-members")
    # Most keys of several classes are those of two nodes, which alone decide whether there is anything to look at.
    ends = F.struct("size", "at")
    mixed = rooted.groupBy("key").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"), F.min(ends).alias("a"), F.max(ends).alias("b")
    )
    mixed = mixed.where("least <> most").where((F.col("n") > 2) | _may_be_similar("a", "b")).select("key")
    rooted = stored(rooted.join(stored(mixed, "mixed-keys"), "key", "left_semi"), "mixed-members")
    over, under = LEAST_SIMILARITY
    size, at = F.col("size").cast("long"), F.col("at").cast("long")
    # The smaller set: it shares 2 over / (over + under) of its shingles at least.
    small = rooted.where((size - at) * (over + under) >= 2 * over * size).withColumn("bucket", _bucket(size))
    # The sizes that the larger set may meet: at least its share, and no more than what stands behind the shingle allows.
    low = F.ceil(size * over / under)
    high = F.least(size, F.floor((size - at) * (over + under) / over) - size)
    large = rooted.withColumns({"low": low, "high": high}).where("low <= high")
    large = large.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("low")), _bucket(F.col("high"))))).drop("low", "high")
    a, b = small.alias("a"), large.alias("b")
    ordered = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") != F.col("b.node")))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.root") != F.col("b.root"))
    return a.join(b, met & ordered & _may_be_similar("a", "b")).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def roots(docs: DataFrame, nodes: DataFrame, counts: np.ndarray) -> DataFrame:
    """``nodes`` (node, size, fingerprint, first) with ``root``, the same for all nodes of a class."""
    links = stored(verified(simhash_pairs(nodes), docs, nodes), "fingerprint-links")
    keyed = prefixes(docs, counts).groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    keyed = stored(keyed, "node-keys")
    members = key_members(keyed)
    links = stored(links.unionByName(verified(alike_prefixes(star_pairs(members), keyed), docs, nodes)), "star-links")
    classes = stored(components(links).toDF("node", "root"), "star-classes")
    more = verified(alike_prefixes(other_pairs(members, classes), keyed), docs, nodes)
    links = stored(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "class-links")
    joined = nodes.join(components(links).toDF("node", "root"), "node", "left")
    return joined.withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per class, that with the smallest doc_id (null: smallest of all), with its columns. Of rows equal in
    doc_id and text any one stays."""
    row = ["row_id", "row_digest"]
    found = stored(signatures(docs.select(*row_identity(docs), "text")), "signatures")
    counts = count_sketch(found.where("chunk is not null").select("chunk", "counts"))
    marked = found.where("chunk is null").select(*row, "node", "size", "fingerprint")
    rest = [F.first(c).alias(c) for c in ("size", "fingerprint")]
    nodes = stored(marked.groupBy("node").agg(F.min(F.struct(*row)).alias("first"), *rest), "signature-nodes")
    return one_row_of_each(docs, marked, roots(docs, nodes, counts))
