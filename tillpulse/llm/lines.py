"""Substring deduplication by hashing units of text: lines, and the sentences inside a line.

Units are normalised (lower case, no ASCII punctuation, single spaces) and digested. Digests are grouped over the whole
corpus; the occurrence with the lowest rank (doc_id, then offset) stays. Every other one of ``least_words`` words or more
goes, and so do runs of shorter ones that touch it or that have twice as many words together. Spans are in code points of the original text, so the text that
stays can be traced back.

Hashing sentences, not only lines, finds passages that were set into the middle of a line. Digests have 128 bits: at 10^12
units a chance match is still out of reach. The group of a digest is an aggregate with a partial step; the digests that
occur twice or more are written, and the units are joined to them by the adaptive join, which can split a unit that very
many documents share.

Cases: null and empty texts have no units; rows equal in doc_id and text are one document and get the same result; a null
doc_id ranks first; a unit repeated inside one document stays where it comes first; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import PLAIN, map_batches, row_identity, stored

LEAST_WORDS = 8
_END = re.compile(r"[.!?](?=\s)|\n")

Unit = tuple[int, int, int, int, int]  # digest (two signed halves), start, end, words


def text_units(text: str) -> list[Unit]:
    """The units of ``text`` that have a word, in order."""
    out, start = [], 0
    for end in (*(m.end() for m in _END.finditer(text)), len(text)):
        unit = text[start:end]
        words = unit.encode("utf-8").translate(PLAIN).split()
        if words:
            high, low = divmod(xxhash.xxh3_128_intdigest(b" ".join(words)), 1 << 64)
            left = start + len(unit) - len(unit.lstrip())
            out.append((high - (1 << 63), low - (1 << 63), left, start + len(unit.rstrip()), len(words)))
        start = end
    return out


def removed_units(words: list[int], later: dict[int, int | None], least_words: int) -> list[int]:
    """Positions to remove. ``later``: the units that have an earlier occurrence. Of each run of such units without a gap all
    go if one has ``least_words`` words or all together have twice as many."""
    gone: list[int] = []
    run: list[int] = []
    for i in [*sorted(later), None]:
        if run and i != run[-1] + 1:
            if max(words[j] for j in run) >= least_words or sum(words[j] for j in run) >= 2 * least_words:
                gone += run
            run = []
        if i is not None:
            run.append(i)
    return gone


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; what is left of their white space is one character."""
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end + (end < len(text) and text[end].isspace())
    return "".join(parts) + text[at:]


_ROW = ["row_id", "row_digest"]


def repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: row_id, row_digest, doc_id, n_units, and the removed units as arrays ``starts``, ``ends``,
    ``words`` and ``first_docs`` (the document that keeps the unit)."""

    def split(batches):
        names = ["highs", "lows", "starts", "ends", "words"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            columns = [[] for _ in names]
            for text in batch.column("text"):
                units = text_units(text.as_py() or "")
                for column, values in zip(columns, zip(*units) if units else [()] * 5):
                    column.append(values)
            arrays = [pa.array(c, pa.list_(t)) for c, t in zip(columns, types)]
            kept = [batch.column(c) for c in ("doc_id", *_ROW)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], ["doc_id", *_ROW, *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_identity(docs), "text")
    schema = "doc_id long, row_id long, row_digest long, highs array<long>, lows array<long>, starts array<int>, ends array<int>, words array<int>"
    units = stored(map_batches(rows, split, schema), "text-units")

    entries = units.select("doc_id", *_ROW, F.posexplode(F.arrays_zip("highs", "lows", "starts")).alias("place", "unit")).select(
        "doc_id", *_ROW, "place", F.col("unit.highs").alias("high"), F.col("unit.lows").alias("low"), F.col("unit.starts").alias("start")
    )
    rank = F.struct("row_id", "row_digest", "start", "doc_id")
    repeated = entries.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = stored(repeated.where("copies > 1").select("high", "low", "first"), "repeated-units")
    own = F.struct("row_id", "row_digest", "start")
    first = F.struct("first.row_id", "first.row_digest", "first.start")
    later = entries.join(repeated, ["high", "low"]).where(own != first)
    later = later.groupBy(*_ROW).agg(F.collect_set(F.struct("place", F.col("first.doc_id").alias("first_doc"))).alias("later"))

    def remove(batches):
        names = ["doc_id", *_ROW, "n_units", "starts", "ends", "words", "first_docs"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                firsts = {x["place"]: x["first_doc"] for x in row["later"] or ()}
                gone = removed_units(row["words"], firsts, least_words)
                out.append((
                    row["doc_id"], row["row_id"], row["row_digest"], len(row["words"]),
                    *([row[c][i] for i in gone] for c in ("starts", "ends", "words")), [firsts[i] for i in gone],
                ))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    wanted = units.select("doc_id", *_ROW, "starts", "ends", "words").join(later, _ROW, "left")
    return map_batches(
        wanted, remove,
        "doc_id long, row_id long, row_digest long, n_units long, starts array<int>, ends array<int>, words array<int>, first_docs array<long>",
    )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``; all rows and columns stay."""
    found = repeated_units(docs, least_words).where(F.size("starts") > 0).dropDuplicates(_ROW).select(*_ROW, "starts", "ends")
    row_id, row_digest = row_identity(docs)
    names = {c: c for c in ("starts", "ends")}
    for c in names:
        while names[c] in docs.columns:
            names[c] += "_"
        found = found.withColumnRenamed(c, names[c])
    joined = docs.join(found, (row_id == found["row_id"]) & (row_digest == found["row_digest"]), "left").drop(found["row_id"], found["row_digest"])

    def rewrite(batches):
        for batch in batches:
            texts = [
                cut(t, list(zip(s, e))) if s else t
                for t, s, e in zip(*(batch.column(c).to_pylist() for c in ("text", names["starts"], names["ends"])))
            ]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.drop_columns(list(names.values()))

    return map_batches(joined, rewrite, docs.schema)
