from __future__ import annotations

import pytest

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, shard int, statistics string, "
    "start long, starts string, words string, row_id string, digest string, spans string, part int"
)


def as_docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 1, "s", 7, "y", "w", "r", "d", "p", 3) for i, t in rows], DOCS)


SENTENCE = "Some plain words that make up one rather long sentence about nothing at all."
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, SENTENCE),
    (5, SENTENCE),
    (5, SENTENCE),
    (None, SENTENCE + "\nAnd a line of its own with password = hunter22secret in it."),
    (None, None),
    (6, "é日本 語 " * 30),
    (7, "word " * 60_000 + "end"),
    (8, "x" * 300_000),
    (9, "one two"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return as_docs(spark, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return as_docs(spark, [])
