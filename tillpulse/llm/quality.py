"""Quality rules: statistics of whole texts, base limits, and a learned decision list.

Sequential covering learns the list from labelled statistics: a rule is grown by adding the threshold that gains most
until it covers no document of good quality, then pruned on rows kept aside, and accepted if it is precise there; the
documents it covers are removed and the next rule is grown. The list is emitted as an ordered Spark conditional
expression over the statistics, so that applying it is a projection.

The list is fitted on at most ``SAMPLE_ROWS`` labelled documents, chosen by a hash of their id. Everything else covers all
documents.

Cases: a null or empty text has no words and fails the base limits; labels with a null id or quality are left out, of
repeated labels the lowest counts; without labels (or with one class only) the list is empty and only the base limits
decide; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import keyed_text, map_batches

WINDOW = 8
SAMPLE_ROWS = 20_000
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_echoes",
)
# name -> (numerator, denominator)
FEATURES = {
    "words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "echo_share": ("n_echoes", "n_words"),
}

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?"
_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(WINDOW)], np.uint64)


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = sum(hashes[i:i + n] * _POWERS[i] for i in range(WINDOW))
    ranked = np.sort(sums)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    # Equal sums: now exactly, by ranks of words, then of runs of 2, 4 and 8.
    number: dict[bytes, int] = {}
    ranks = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    for width in (1, 2, 4):
        pairs = ranks[:-width] * (len(words) + 1) + ranks[width:]
        ranks = np.unique(pairs, return_inverse=True)[1]
    again = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8")
    words = data.split()
    seen, repeats, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if not line or line.isspace():
            continue
        lines += 1
        if line in seen:
            repeats += 1
        seen.add(line)

    def count(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    return (
        len(words), len(text) - count(_SPACE), count(_SYMBOLS), repeats, repeated_words(words),
        lines, count(_UPPER), count(_DIGITS), count(_MARKS), len(set(words)), sum(map(bytes.__eq__, words, words[1:])),
    )


def with_statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """``docs`` with a struct of the statistics of ``text``."""
    kind = pa.struct([(name, pa.int64()) for name in STATISTICS])

    def compute(batches):
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(STATISTICS)
            yield batch.append_column(into, pa.StructArray.from_arrays(columns, fields=list(kind)))

    fields = ",".join(f"{name}:bigint" for name in STATISTICS)
    return map_batches(docs, compute, docs.withColumn(into, F.lit(None).cast(f"struct<{fields}>")).schema)


class Condition(NamedTuple):
    feature: str
    above: bool
    limit: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.limit if self.above else x[self.feature] <= self.limit

    def column(self, statistics: str) -> Column:
        value = feature_column(statistics, self.feature)
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def feature_column(statistics: str, feature: str) -> Column:
    top, bottom = FEATURES[feature]
    value = F.col(f"{statistics}.{top}").cast("double")
    return value if bottom is None else value / F.greatest(F.col(f"{statistics}.{bottom}"), F.lit(1))


def _features(rows: np.ndarray) -> dict[str, np.ndarray]:
    at = {name: rows[:, i].astype(float) for i, name in enumerate(STATISTICS)}
    return {f: at[top] if bottom is None else at[top] / np.maximum(at[bottom], 1) for f, (top, bottom) in FEATURES.items()}


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    mask = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        mask &= condition.mask(x)
    return mask


def _candidates(x, covered, cuts: int):
    for feature, values in x.items():
        inside = np.unique(values[covered])
        if len(inside) < 2:
            continue
        middle = (inside[1:] + inside[:-1]) / 2
        for limit in middle if len(middle) <= cuts else middle[np.linspace(0, len(middle) - 1, cuts).astype(int)]:
            yield Condition(feature, True, float(limit))
            yield Condition(feature, False, float(limit))


def _grow(x, bad, cuts: int, most: int) -> Rule:
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < most and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, gain = None, 1e-9
        for condition in _candidates(x, covered, cuts):
            inside = covered & condition.mask(x)
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                best, gain = condition, g
        if best is None:
            break
        rule += (best,)
        covered &= best.mask(x)
    return rule


def _prune(rule: Rule, x, bad) -> Rule:
    def worth(r):
        inside = _covered(r, x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return ((p - n) / max(p + n, 1), p)

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=worth)


def learn(rows: np.ndarray, bad: np.ndarray, precision: float = 0.97, cuts: int = 48, conditions: int = 4, rules: int = 16) -> list[Rule]:
    """Rules for documents to reject, in order. ``rows``: statistics; ``bad``: the labels. Every third row prunes."""
    x = _features(rows)
    aside = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    found: list[Rule] = []

    def part(mask):
        return {f: v[mask] for f, v in x.items()}, bad[mask]

    while len(found) < rules:
        grow_x, grow_bad = part(left & ~aside)
        prune_x, prune_bad = part(left & aside)
        if grow_bad.sum() < 2 or grow_bad.all():
            break
        rule = _grow(grow_x, grow_bad, cuts, conditions)
        if not rule:
            break
        rule = _prune(rule, prune_x, prune_bad)
        inside = _covered(rule, prune_x)
        if not inside.any() or prune_bad[inside].mean() < precision:
            break
        found.append(rule)
        left &= ~_covered(rule, x)
    return found


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list for ``docs`` from ``labels`` (doc_id, quality 0 or 1)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows rows of two numbers.
    texts = keyed_text(docs).join(F.broadcast(sample), "doc_id")
    rows = with_statistics(texts).select("quality", "doc_id", *[f"statistics.{s}" for s in STATISTICS])
    rows = rows.orderBy(F.xxhash64("doc_id"), *STATISTICS).limit(sample_rows).collect()
    if not rows:
        return []
    values = np.array([tuple(r) for r in rows], np.int64)
    return learn(values[:, 2:], values[:, 0] == 0)


def base_failed(statistics: str = "statistics") -> Column:
    words, repeats = F.col(f"{statistics}.n_words"), F.col(f"{statistics}.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * words)


def verdict(rules: list[Rule], statistics: str = "statistics") -> Column:
    """True to keep: the first rule that applies rejects."""
    chain = None
    for rule in rules:
        applies = rule[0].column(statistics)
        for condition in rule[1:]:
            applies &= condition.column(statistics)
        chain = F.when(applies, F.lit(False)) if chain is None else chain.when(applies, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, statistics, base_failed, kept) for every document."""
    rules = fit(docs, labels, sample_rows)
    rows = with_statistics(keyed_text(docs)).withColumn("base_failed", base_failed())
    return rows.select("doc_id", "statistics", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    rules = fit(docs, labels, sample_rows)
    name = "statistics"
    while name in docs.columns:
        name += "_"
    rows = with_statistics(docs, into=name)
    return rows.where(~base_failed(name) & verdict(rules, name)).select(*docs.columns)
