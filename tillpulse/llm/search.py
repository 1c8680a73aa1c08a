"""Ranked lexical search by Block-Max MaxScore over an index in shards.

The index has one row per shard, a stretch of the documents of one task: the terms with their document counts, and their postings in
blocks of ``BLOCK`` documents, byte-packed. Within a shard documents are numbered by length, so that those of a block are about equally
long and the bound of a block, its greatest term count at its least length, is close.

A shard answers a query, a bag of weighted terms, like this. Lists are taken by falling bound. As long as the lists left could
together reach the threshold, the tenth best score so far, they are essential: their postings are added up, but for blocks whose
bound leaves their documents below it. Beyond that no new document can come up. For the documents that are left the bounds of
their blocks in the next list are looked up first; only blocks that still have a document above the threshold are unpacked. The
threshold rises with every list and goes on to the next shard of the task. Tasks give their best, which are merged in
two steps. Every document that could be among the best is scored in full; nothing is estimated.

The index does not depend on corpus counts: these (documents, terms, documents of a term) are summed over its rows afterwards.
Queries are sent to the shards in blocks of ``QUERY_BLOCK``.

Scores are integers: w * ((1000000000 * tf) div (1000 * tf + 8 * m)) summed over the query's terms, repeats included, with
m = 25 + (75 * n * N) div L and w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Cases: null and empty texts have no terms, are not counted and never found; a query without known terms finds nothing; rows that
share an item_id are queries of their own; rows that share a doc_id are documents of their own; a null doc_id comes first
among equal scores; without documents or queries nothing is found.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpulse.llm.common import PLAIN, map_batches, stored
from tillpulse.llm.running import running_sums

TOP = 10
BLOCK = 128
# A shard ends with the document that reaches one of these.
SHARD_TERMS, SHARD_DOCS = 1 << 21, 1 << 15
QUERY_BLOCK = 1024
# Postings that a task keeps unpacked for the next queries.
CACHE_POSTINGS = 1 << 21
MERGE_PARTS = 64
_NO_ID = -(1 << 63)  # sorts first

INDEX_SCHEMA = (
    "docs long, terms long, doc_ids array<long>, lengths binary, words array<binary>, counts array<int>, "
    "block_of binary, first binary, last binary, most binary, least binary, width binary, place binary, postings binary"
)


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8").translate(PLAIN).split()


class _Vocabulary(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _packed(blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Width of each block, its place, and all blocks packed: the first of ``values`` of a block, then the second."""
    widest = np.maximum.reduceat(np.maximum(*values), starts) if len(starts) else np.zeros(0, np.int64)
    width = np.where(widest < 1 << 8, 1, np.where(widest < 1 << 16, 2, 4))
    place = np.concatenate([[0], np.cumsum(2 * width * sizes)])
    out = np.zeros(place[-1], np.uint8)
    within = np.arange(len(blocks)) - starts[blocks]
    for part, numbers in enumerate(values):
        at = place[blocks] + (within + part * sizes[blocks]) * width[blocks]
        for byte in range(4):
            used = width[blocks] > byte
            out[at[used] + byte] = (numbers[used] >> (8 * byte)) & 255
    return width.astype(np.uint8), place[:-1].astype(np.int64), out.tobytes()


def index_row(ids: list, counts: list[int], words: list[bytes]) -> dict:
    """The index of one shard: documents ``ids`` with ``counts`` terms each, ``words`` all their terms."""
    lengths = np.array(counts, np.int64)
    order = np.argsort(lengths, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    vocabulary = _Vocabulary()
    tokens = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    keys, tf = np.unique(tokens * len(ids) + np.repeat(number, lengths), return_counts=True)
    lists, docs = np.divmod(keys, len(ids))
    df = np.bincount(lists, minlength=len(vocabulary))
    ends = np.cumsum(df)
    per_list = -(-df // BLOCK)
    block_of = np.concatenate([[0], np.cumsum(per_list)])
    owner = np.repeat(np.arange(len(df)), per_list)
    starts = (ends - df)[owner] + BLOCK * (np.arange(len(owner)) - block_of[owner])
    sizes = np.minimum(starts + BLOCK, ends[owner]) - starts
    blocks = np.repeat(np.arange(len(owner)), sizes)
    first = docs[starts]
    steps = np.diff(docs, prepend=0)
    steps[starts] = 0
    width, place, postings = _packed(blocks, starts, sizes, [steps, tf.astype(np.int64)])
    lengths = lengths[order]
    return {
        "docs": len(ids), "terms": len(words), "doc_ids": [ids[i] for i in order], "lengths": lengths.astype("<i4").tobytes(),
        "words": list(vocabulary), "counts": df.astype(np.int32), "block_of": block_of.astype("<i4").tobytes(),
        "first": first.astype("<i4").tobytes(), "last": docs[starts + sizes - 1].astype("<i4").tobytes(),
        "most": np.maximum.reduceat(tf, starts).astype("<i4").tobytes(), "least": lengths[first].astype("<i4").tobytes(),
        "width": width.tobytes(), "place": place.astype("<i8").tobytes(), "postings": postings,
    }


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard; the documents stay in their tasks."""
    def shards(batches):
        names = [part.split()[0] for part in INDEX_SCHEMA.split(", ")]
        types = {"docs": pa.int64(), "terms": pa.int64(), "doc_ids": pa.list_(pa.int64()), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int32())}

        def flushed():
            row = index_row(ids, counts, words)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], types.get(c, pa.binary())) for c in names], names)

        ids, counts, words = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = terms_of(text.as_py() or "")
                if not own:
                    continue
                ids.append(doc_id)
                counts.append(len(own))
                words += own
                if len(words) >= SHARD_TERMS or len(ids) >= SHARD_DOCS:
                    yield flushed()
                    ids, counts, words = [], [], []
        if ids:
            yield flushed()

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shards, INDEX_SCHEMA)


class Best:
    """The ``TOP`` best of a query so far: highest score, then lowest doc_id."""

    def __init__(self):
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        kept = np.lexsort((ids, -scores))[:TOP]
        self.scores, self.ids = scores[kept], ids[kept]

    def threshold(self, more: np.ndarray | None = None) -> int:
        """What a document must reach; ``more``: least scores of further documents."""
        every = self.scores if more is None else np.concatenate([self.scores, more])
        return int(np.partition(every, len(every) - TOP)[len(every) - TOP]) if len(every) >= TOP else 1


class Shard:
    def __init__(self, row: dict, documents: int, terms: int):
        self.lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.ids = np.array([_NO_ID if i is None else i for i in row["doc_ids"].as_py()], np.int64)
        self.block_of, self.first, self.last = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("block_of", "first", "last"))
        self.width, self.place, self.postings = np.frombuffer(row["width"], np.uint8), np.frombuffer(row["place"], "<i8"), row["postings"]
        self.end = np.append(self.place[1:], len(self.postings))
        self.documents, self.terms = documents, terms
        self.impact = self._impact(np.frombuffer(row["most"], "<i4").astype(np.int64), np.frombuffer(row["least"], "<i4").astype(np.int64))
        self.list_impact = np.maximum.reduceat(self.impact, self.block_of[:-1])
        self.sums = np.zeros(len(self.ids), np.int64)
        self.cache, self.cached = {}, 0
        self.unpacked = 0

    def _impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 25 + 75 * length * self.documents // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        found = self.cache.get(b)
        if found is None:
            width = int(self.width[b])
            raw = np.frombuffer(self.postings, f"<u{width}", (int(self.end[b]) - int(self.place[b])) // width, int(self.place[b])).astype(np.int64)
            steps, tf = raw.reshape(2, -1)
            docs = self.first[b] + np.cumsum(steps)
            found = docs, self._impact(tf, self.lengths[docs])
            if self.cached + len(docs) > CACHE_POSTINGS:
                self.cache.clear()
                self.cached = 0
            self.cache[b] = found
            self.cached += len(docs)
            self.unpacked += 1
        return found

    def _add(self, blocks: list[int], weight: int) -> None:
        parts = [self.block(b) for b in blocks]
        if parts:
            docs = np.concatenate([d for d, _ in parts])  # ascending: a document once at most
            self.sums[docs] += weight * np.concatenate([i for _, i in parts])

    def search(self, query: list[tuple[int, int]], best: Best) -> None:
        """``query``: (list, weight) with weights above 0."""
        bounds = [weight * int(self.list_impact[number]) for number, weight in query]
        order = sorted(range(len(query)), key=lambda i: (-bounds[i], i))
        left = [0] * (len(query) + 1)  # what the lists from here on can add
        for at in reversed(range(len(query))):
            left[at] = left[at + 1] + bounds[order[at]]
        least, at = best.threshold(), 0
        while at < len(query) and left[at] >= least:
            number, weight = query[order[at]]
            lo, hi = self.block_of[number], self.block_of[number + 1]
            others = left[0] - bounds[order[at]]
            self._add((lo + np.flatnonzero(weight * self.impact[lo:hi] + others >= least)).tolist(), weight)
            at += 1
            if left[at]:
                least = max(least, best.threshold(self.sums))
        alive = np.flatnonzero(self.sums)
        for at in range(at, len(query)):
            alive = alive[self.sums[alive] + left[at] >= least]
            if not len(alive):
                break
            number, weight = query[order[at]]
            lo, hi = self.block_of[number], self.block_of[number + 1]
            where = np.minimum(lo + np.searchsorted(self.last[lo:hi], alive), hi - 1)
            inside = (self.first[where] <= alive) & (alive <= self.last[where])
            bound = np.where(inside, weight * self.impact[where], 0)
            kept = self.sums[alive] + bound + left[at + 1] >= least
            alive, where, inside = alive[kept], where[kept], inside[kept]
            for b in np.unique(where[inside]).tolist():
                docs, impacts = self.block(b)
                asked = alive[inside & (where == b)]
                found = np.minimum(np.searchsorted(docs, asked), len(docs) - 1)
                hit = docs[found] == asked
                self.sums[asked[hit]] += weight * impacts[found[hit]]
            if len(alive) >= TOP:
                least = max(least, best.threshold(self.sums[alive]))
        alive = alive[self.sums[alive] >= least]
        best.add(self.sums[alive], self.ids[alive])
        self.sums[:] = 0


def _answers(index: DataFrame, queries: list[tuple[int, list[tuple[bytes, int]]]], documents: int, terms: int) -> DataFrame:
    """(query, part, doc_id, score): the best of every task for every query; ``part`` deals them out for merging."""
    known = sorted({word for _, own in queries for word, _ in own})
    number = {word: i for i, word in enumerate(known)}
    asked = [(query, [(number[word], weight) for word, weight in own]) for query, own in queries]

    def search(batches):
        wanted, best, part = pa.array(known, pa.binary()), defaultdict(Best), 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                words = row.pop("words").values
                part ^= len(words)
                views = {c: v.as_buffer() for c, v in row.items() if c not in ("docs", "terms", "doc_ids", "counts")}
                shard = Shard({**views, "doc_ids": row["doc_ids"]}, documents, terms)
                lists = pc.index_in(wanted, value_set=words).fill_null(-1).to_pylist()
                for query, own in asked:
                    here = [(lists[word], weight) for word, weight in own if lists[word] >= 0]
                    if here:
                        shard.search(here, best[query])
        rows = [(q, part % MERGE_PARTS, int(i), int(s)) for q, b in best.items() for i, s in zip(b.ids, b.scores)]
        for start in range(0, len(rows), 1 << 14):
            columns = zip(*rows[start:start + (1 << 14)])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query", "part", "doc_id", "score"])

    columns = ["doc_ids", "lengths", "words", "block_of", "first", "last", "most", "least", "width", "place", "postings"]
    return map_batches(index.select(*columns), search, "query long, part int, doc_id long, score long")


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def weighted_terms(queries: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """(query, words array<struct<word, weight>>) of ``queries`` (query, text): weight is w times the term's occurrences."""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    every = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    own = queries.select("query", F.explode(every).alias("word")).groupBy("query", "word").agg(F.count(F.lit(1)).alias("times"))
    own = stored(own.withColumn("word", F.col("word").cast("binary")), "query-terms")
    listed = index.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    df = listed.join(own.select("word").distinct(), "word").groupBy("word").agg(F.sum("n").alias("df"))
    w = F.floor(1000.0 * F.log((F.lit(2.0 * documents + 2.0)) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = own.join(df, "word").select("query", F.struct("word", (w * F.col("times")).alias("weight")).alias("x")).where("x.weight > 0")
    return weighed.groupBy("query").agg(F.sort_array(F.collect_list("x")).alias("words"))


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` best documents of every row of ``items``."""
    index = stored(build_index(docs), "search-index")
    documents, terms = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    thin = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")), "search-items")
    numbered = running_sums(thin, [], ["item_id", "text"], {"query": F.lit(1).cast("long")})
    queries = stored(numbered.select(F.col("query_before").alias("query"), "item_id", "text"), "search-queries")
    weighted = stored(weighted_terms(queries, index, documents), "search-weights")
    count = queries.count() if documents else 0
    found = index.sparkSession.createDataFrame([], "query long, part int, doc_id long, score long")
    for block in range(math.ceil(count / QUERY_BLOCK)):
        own = weighted.where(F.col("query").between(block * QUERY_BLOCK, (block + 1) * QUERY_BLOCK - 1)).collect()
        asked = [(r["query"], [(bytes(x["word"]), x["weight"]) for x in r["words"]]) for r in own]
        if asked:
            found = found.unionByName(_best(stored(_answers(index, asked, documents, terms), "search-answers"), "query", "part").drop("rank"))
    best = _best(found, "query").join(queries.select("query", "item_id"), "query")
    doc_id = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))
    return best.select("item_id", "rank", doc_id.alias("doc_id"), "score")
