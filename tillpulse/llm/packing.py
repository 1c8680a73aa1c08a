"""Packing into sequences of a fixed length: shortest pack first over the length histogram.

Every document is cut into full sequences and a rest. Rests are packed by length class: classes are placed longest first,
each into the emptiest open pack that has room (the shortest pack) or into new packs, a whole block of packs with the
same pattern at a time. Packs that are not full at the end are then evened out: the emptiest are taken apart and their
documents, cut where needed, fill the room left in others. What remains, less than one sequence, becomes sequences whose
lengths are powers of two. All of this works on the histogram (as many rows as the sequence length) and gives a table of
(class, ranks, sequences), which documents meet through their rank within their class.

Ranks need no sort: each task numbers its own documents per class, and the tasks' counts give each task its first rank.

Cases: a null or empty text is the end token alone; documents of any length are cut; repeated rows are packed once each;
an empty table gives no rows. Within one run all pieces of a document agree; another run may deal equal lengths otherwise.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict, deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpulse.llm.common import keyed_text, map_batches, stored
from tillpulse.llm.tokens import encoder

END_ID = 1
# No piece is cut shorter than this to fill room in another sequence.
LEAST_FILL = 16


class Item(NamedTuple):
    """Tokens start..start+length of the rests of class ``rest`` with ranks from ``rank`` on."""

    rest: int
    rank: int
    start: int
    length: int


class Pattern(NamedTuple):
    """``count`` packs with the same lengths; pack i holds the rests with rank ``item.rank + i``."""

    count: int
    room: int
    items: tuple[Item, ...]

    def split(self, count: int) -> tuple[Pattern, Pattern | None]:
        """The first ``count`` packs and the others."""
        if count == self.count:
            return self, None
        later = tuple(i._replace(rank=i.rank + count) for i in self.items)
        return self._replace(count=count), Pattern(self.count - count, self.room, later)

    def plus(self, item: Item) -> Pattern:
        return Pattern(self.count, self.room - item.length, (*self.items, item))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Patterns for ``histogram`` (length -> documents), longest lengths first."""
    open_packs: list[tuple[int, int, Pattern]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                pattern = heapq.heappop(open_packs)[2]
                taken, others = pattern.split(min(left, pattern.count))
                if others:
                    serial += 1
                    heapq.heappush(open_packs, (-others.room, serial, others))
            else:
                taken = Pattern(left, size, ())
            filled = taken.plus(Item(length, rank, 0, length))
            serial += 1
            heapq.heappush(open_packs, (-filled.room, serial, filled))
            rank, left = rank + taken.count, left - taken.count
    return [p for _, _, p in open_packs]


def even_out(patterns: list[Pattern], size: int, least: int = LEAST_FILL) -> list[Pattern]:
    """Take the emptiest packs apart to fill the others; at most one pack keeps ``least`` or more room, and it is cut into
    sequences whose lengths are powers of two."""
    done = [p for p in patterns if p.room < least]
    rest = deque(sorted((p for p in patterns if p.room >= least), key=lambda p: -p.room))
    while rest:
        donor = rest.popleft()
        if not donor.items:
            continue
        if not rest:
            if donor.count == 1:
                done += _powers_of_two(donor, size)
                break
            donor, other = donor.split(donor.count // 2)
            rest.append(other)
        receiver = rest.popleft()
        count = min(donor.count, receiver.count)
        (donor, donors), (receiver, receivers) = donor.split(count), receiver.split(count)
        *kept, item = donor.items
        moved = min(item.length, receiver.room)
        if item.length > moved and item.length - moved < least <= moved - least:
            moved -= least  # neither piece gets very short
        receiver = receiver.plus(item._replace(length=moved))
        if moved < item.length:
            kept.append(item._replace(start=item.start + moved, length=item.length - moved))
        donor = Pattern(count, donor.room + moved, tuple(kept))
        if receiver.room < least:
            done.append(receiver)
            receiver = None
        rest.extendleft(p for p in (receivers, receiver, donors, donor) if p)
    return done


def _powers_of_two(pattern: Pattern, size: int) -> list[Pattern]:
    out, items = [], deque(pattern.items)
    left = size - pattern.room
    while left:
        pack = Pattern(1, 1 << left.bit_length() - 1, ())
        left -= pack.room
        while pack.room:
            item = items.popleft()
            taken = min(item.length, pack.room)
            pack = pack.plus(item._replace(length=taken))
            if taken < item.length:
                items.appendleft(item._replace(start=item.start + taken, length=item.length - taken))
        out.append(pack)
    return out


class Places:
    """Where the rests of each class go: found by class and rank."""

    def __init__(self, patterns: list[Pattern]):
        self.sequences = 0
        found = defaultdict(list)
        for pattern in patterns:
            offset = 0
            for item in pattern.items:
                found[item.rest].append((item.rank, pattern.count, item.start, item.length, self.sequences - item.rank, offset))
                offset += item.length
            self.sequences += pattern.count
        self.classes = {}
        for rest, rows in found.items():
            edges = sorted({r[0] for r in rows} | {r[0] + r[1] for r in rows})
            spans = [[] for _ in edges]
            for rank, count, *place in rows:
                for i in range(bisect.bisect_left(edges, rank), bisect.bisect_left(edges, rank + count)):
                    spans[i].append(tuple(place))
            self.classes[rest] = edges, [sorted(s) for s in spans]

    def of(self, rest: int, rank: int):
        """(start, length, sequence, offset) of each piece of a rest."""
        edges, spans = self.classes[rest]
        return [(s, n, q + rank, o) for s, n, q, o in spans[bisect.bisect_right(edges, rank) - 1]]


def tokenized(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, ids (16 bits each, with the end), n, rest, and running numbers per task: of full sequences, and of the
    rest within its class."""

    def encode(batches):
        part = TaskContext.get().partitionId()
        chunks, end = encoder(), np.array([END_ID], "<u2").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = chunks.encode(text) + end
                n = len(ids) // 2
                rows.append((doc_id, part, n, n % size, seen[0], seen[n % size], ids))
                seen[0] += n // size
                if n % size:
                    seen[n % size] += 1
                if len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", "part", "n", "rest", "full_before", "rest_before", "ids"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    schema = "doc_id long, part int, n long, rest int, full_before long, rest_before long, ids binary"
    return map_batches(keyed_text(docs), encode, schema)


def pack_documents(docs: DataFrame, size: int = 2048) -> DataFrame:
    """doc_id, start, length, sequence_id, offset, doc_tokens, ids (little-endian 32-bit): one row per piece."""
    rows = stored(tokenized(docs, size), "tokens")
    rests = rows.where("rest > 0").groupBy("part", "rest").agg(F.count(F.lit(1)).alias("docs"))
    fulls = rows.groupBy("part").agg(F.sum(F.expr(f"n div {size}")).alias("docs")).select("part", F.lit(0).alias("rest"), "docs")
    counts = stored(rests.unionByName(fulls), "token-counts")
    histogram = {r["rest"]: r["docs"] for r in counts.groupBy("rest").agg(F.sum("docs").alias("docs")).collect()}  # <= size rows
    histogram.pop(0, None)
    places = Places(even_out(shortest_pack_first(histogram, size), size))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("docs").over(earlier), F.lit(0)))
    # One row per task. The planner sends it to the tokens if it is small and sorts both sides otherwise.
    first = first.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "first"))).alias("first"))
    ranked = rows.join(first, "part").select(
        "doc_id", "n", "rest", "ids",
        (F.col("full_before") + F.element_at("first", F.lit(0))).alias("full_rank"),
        (F.col("rest_before") + F.coalesce(F.try_element_at("first", F.col("rest")), F.lit(0))).alias("rest_rank"),
    )

    def cut(batches):
        for batch in batches:
            out = []
            for doc in batch.to_pylist():
                ids = np.frombuffer(doc["ids"], "<u2").astype("<u4")
                full = doc["n"] // size
                pieces = [(k * size, size, places.sequences + doc["full_rank"] + k, 0) for k in range(full)]
                if doc["rest"]:
                    pieces += [(full * size + s, n, q, o) for s, n, q, o in places.of(doc["rest"], doc["rest_rank"])]
                out += [(doc["doc_id"], s, n, q, o, doc["n"], ids[s:s + n].tobytes()) for s, n, q, o in pieces]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids"]
    kinds = [*[pa.int64()] * 6, pa.binary()]
    return map_batches(ranked, cut, ", ".join(f"{n} long" for n in names[:-1]) + ", ids binary")
