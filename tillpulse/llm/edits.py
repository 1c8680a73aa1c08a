"""Token counts that follow edits.

A document is kept as leaves: groups of ``LEAF_PIECES`` pre-tokens, runs of white space with the visible characters behind
them, so that no token reaches from one into the next. A segment tree over the leaves holds the sums of characters and tokens of
every subtree. An edit (or several that lie closer than a leaf) finds its leaves from the root by offset, changes their text,
takes in neighbours as long as a border is no longer one that tokens cannot cross, encodes that region again, and updates the
sums on the way back to the root. All other leaves keep their counts. A region that has come to twice as many leaves as it had is
split, and the tree is built anew over the counts of its leaves, without encoding anything; so a leaf does not grow
however many edits fall on one place.

Trees are stored as rows: text, and characters and tokens of every leaf. Edits apply to stored trees.

Cases: a null or empty text has no leaves and no tokens; edits are taken by start; one that begins before the end of the one
before it, or beyond the text, or has a null bound, is left out; a null replacement deletes; an edit that ends beyond the
text ends with it; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import map_batches
from tillpulse.llm.tokens import encoder

LEAF_PIECES = 16
# Edits closer than this become one: about a leaf.
NEAR_CHARS = 96
_BORDER = re.compile(r"(?<=\S)(?=[ \n\t\r])")

Edit = tuple[int, int, str]  # start, end, replacement


def leaves(text: str) -> list[str]:
    """Consecutive groups of pre-tokens; tokens of one do not depend on another."""
    borders = [m.start() for m in _BORDER.finditer(text)]
    starts = [0, *borders[LEAF_PIECES - 1::LEAF_PIECES]]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] if text else []


def _separate(left: str, right: str) -> bool:
    return not left or not right or (not left[-1].isspace() and right[0] in " \n\t\r")


class TokenTree:
    """Sums of characters and tokens over leaves; node 1 is the root, node i has children 2i and 2i + 1."""

    def __init__(self, parts: list[str], tokens: list[int]):
        self.parts = parts or [""]
        self.width = 1 << (len(self.parts) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width:self.width + len(self.parts), 0] = [len(p) for p in self.parts]
        self.sums[self.width:self.width + len(parts), 1] = tokens
        level = self.width
        while level > 1:
            children = self.sums[level:2 * level]
            self.sums[level // 2:level] = children[::2] + children[1::2]
            level //= 2
        self.encoded_chars = 0

    @classmethod
    def of(cls, text: str) -> TokenTree:
        parts = leaves(text)
        return cls(parts, [_count(p) for p in parts])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds character ``offset`` (the last leaf with text for the end), and the offset in it."""
        node = 1
        while node < self.width:
            node *= 2
            if offset >= self.sums[node, 0] and self.sums[node + 1, 0]:
                offset -= self.sums[node, 0]
                node += 1
        return node - self.width, int(offset)

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        node = self.width + leaf
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def _neighbour(self, leaf: int, step: int) -> int:
        """The next leaf with text in a direction, or -1."""
        leaf += step
        while 0 <= leaf < len(self.parts) and not self.parts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.parts) else -1

    def replace(self, start: int, end: int, text: str) -> None:
        """Characters start..end become ``text``."""
        first, left = self.find(start)
        last, right = self.find(max(start, end - 1)) if end > start else (first, left - 1)
        region = self.parts[first][:left] + text + self.parts[last][right + 1:]
        touched = list(range(first, last + 1))
        while (i := self._neighbour(touched[0], -1)) >= 0 and not (region and _separate(self.parts[i], region)):
            region = self.parts[i] + region
            touched.insert(0, i)
        while (i := self._neighbour(touched[-1], 1)) >= 0 and not (region and _separate(region, self.parts[i])):
            region += self.parts[i]
            touched.append(i)
        self.encoded_chars += len(region)
        parts = leaves(region)
        if len(parts) > 2 * len(touched):
            self._split(touched, parts)
            return
        # As many leaves as were touched; what does not fit goes into the last of them, until the region has doubled.
        if len(parts) > len(touched):
            parts[len(touched) - 1:] = ["".join(parts[len(touched) - 1:])]
        for leaf, part in zip(touched, parts + [""] * (len(touched) - len(parts))):
            self._put(leaf, part, _count(part))

    def _split(self, touched: list[int], parts: list[str]) -> None:
        """``parts`` take the place of the ``touched`` leaves; empty leaves go."""
        tokens = self.sums[self.width:self.width + len(self.parts), 1].tolist()
        first, last = touched[0], touched[-1]
        every = [
            *zip(self.parts[:first], tokens[:first]), *((p, _count(p)) for p in parts), *zip(self.parts[last + 1:], tokens[last + 1:])
        ]
        kept = [x for x in every if x[0]]
        done = self.encoded_chars
        self.__init__([p for p, _ in kept], [n for _, n in kept])
        self.encoded_chars = done

    def apply(self, edits: Iterable[Edit]) -> int:
        """Make edits given in offsets of the present text; gives how many were made."""
        made, done = [], 0
        for start, end, text in sorted((e for e in edits if e[0] is not None and e[1] is not None), key=lambda e: e[:2]):
            if done <= start <= self.chars and end >= start:
                end = min(end, self.chars)
                made.append((start, end, text or ""))
                done = end
        for edit in reversed(self._joined(made)):
            self.replace(*edit)
        return len(made)

    def _joined(self, made: list[Edit]) -> list[Edit]:
        """Edits closer than a leaf as one, so that a region with many edits is encoded once."""
        source, out = self.text if len(made) > 1 else "", []
        for start, end, text in made:
            if out and start - out[-1][1] < NEAR_CHARS:
                out[-1][2] += [source[out[-1][1]:start], text]
                out[-1][1] = end
            else:
                out.append([start, end, [text]])
        return [(start, end, "".join(parts)) for start, end, parts in out]

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _count(part: str) -> int:
    return len(encoder().encode(part)) // 2 if part else 0


def _result(tree: TokenTree, before: int, made: int) -> tuple:
    kept = [i for i, p in enumerate(tree.parts) if p]
    lengths, tokens = ([int(tree.sums[tree.width + i, c]) for i in kept] for c in (0, 1))
    return before, tree.tokens, made, tree.encoded_chars, tree.text, lengths, tokens


_FIELDS = [
    ("tokens_before", "long", pa.int64()), ("tokens_after", "long", pa.int64()), ("n_edits", "long", pa.int64()),
    ("encoded_chars", "long", pa.int64()), ("text", "string", pa.string()),
    ("leaf_chars", "array<int>", pa.list_(pa.int32())), ("leaf_tokens", "array<int>", pa.list_(pa.int32())),
]
_SCHEMA = "doc_id long, " + ", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS)


def _batches(ids: list, rows: Iterable[tuple]):
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    arrays = [pa.array(c, kind) for c, (_, _, kind) in zip(columns, _FIELDS)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], ["doc_id", *[f[0] for f in _FIELDS]])


def counted(docs: DataFrame, find_edits: Callable[[str], Iterable[Edit]] | None = None) -> DataFrame:
    """The tree of every document, after the edits that ``find_edits`` finds in its text: doc_id, tokens_before,
    tokens_after, n_edits, encoded_chars (characters encoded again), text, leaf_chars, leaf_tokens."""

    def build(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 256):
                rows = []
                for text in texts[at:at + 256].to_pylist():
                    tree = TokenTree.of(text or "")
                    before = tree.tokens
                    made = tree.apply(find_edits(text or "")) if find_edits else 0
                    rows.append(_result(tree, before, made))
                yield _batches(ids[at:at + 256], rows)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, _SCHEMA)


def _tree(text: str, chars: np.ndarray, tokens: list[int]) -> TokenTree:
    """A stored tree; nothing is encoded."""
    ends = np.cumsum(chars, dtype=int).tolist()
    return TokenTree([text[a:b] for a, b in zip([0, *ends], ends)], tokens)


def edited(trees: DataFrame, find_edits: Callable[[str], Iterable[Edit]]) -> DataFrame:
    """The stored trees (the result of ``counted``) after the edits that ``find_edits`` finds in their texts."""

    def change(batches):
        for batch in batches:
            rows = []
            for text, chars, tokens in zip(*(batch.column(c) for c in ("text", "leaf_chars", "leaf_tokens"))):
                text = text.as_py()
                found = list(find_edits(text))
                tree = _tree(text, chars.values.to_numpy(), tokens.values.to_numpy())
                before = tree.tokens
                rows.append(_result(tree, before, tree.apply(found)))
            yield _batches(batch.column("doc_id").to_pylist(), rows)

    return map_batches(trees.select("doc_id", "text", "leaf_chars", "leaf_tokens"), change, _SCHEMA)


def recounted(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """The stored trees (the result of ``counted``) after a table of edits (doc_id, start, end, replacement)."""
    changes = edits.groupBy(F.col("doc_id").alias("edited_id")).agg(
        F.collect_list(F.struct("start", "end", "replacement")).alias("changes")
    )
    state = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens")
    joined = state.join(changes, F.col("doc_id").eqNullSafe(F.col("edited_id")), "left").drop("edited_id")

    def change(batches):
        for batch in batches:
            ids, rows = [], []
            for row in batch.to_pylist():
                tree = _tree(row["text"], row["leaf_chars"], row["leaf_tokens"])
                before = tree.tokens
                made = tree.apply((e["start"], e["end"], e["replacement"]) for e in row["changes"] or ())
                ids.append(row["doc_id"])
                rows.append(_result(tree, before, made))
            yield _batches(ids, rows)

    return map_batches(joined, change, _SCHEMA)
