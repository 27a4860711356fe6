"""Small tables with the awkward cases every operator must handle."""

from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, s string, "
          "u long, v long, probability string, n_tokens string, topic string, _odds int, digest string, k int, "
          "family string, p string, fraction string")
CLASH = (True, "r", "s", 1, 2, "x", "n", "t", 3, "d", 4, "f", "p", "q")


def prose(seed: int, n: int) -> str:
    gen = random.Random(seed)
    words = [a + b for a in ("tan", "mo", "ri", "sel", "du", "vek", "pal") for b in ("der", "lin", "got", "ar", "ney")]
    return " ".join(gen.choice(words) + gen.choice(("", "", "", ",", ".")) for _ in range(n))


def document_rows() -> list[tuple]:
    base = prose(1, 300)
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(base.split(" ")))
    rows = [
        (0, base, "en", "a", 1), (1, base.upper(), "en", "a", 1), (2, near, "en", "b", 1),
        (3, None, "en", "a", None), (4, "", "de", "a", 0), (5, " \t\n ", None, None, 4), (6, "one two", "de", "b", 7),
        (7, "One  two", "de", "b", 8), (8, "x", None, "b", 1), (9, prose(2, 40_000), "de", "c", 1),
        (10, "spam spam eggs " * 60, "fr", "c", 1), (11, "same line here\n" * 30 + prose(3, 80), "fr", None, 1),
        (12, "été naïve ≠ 日本語 🎉" + prose(4, 90), "fr", "c", 1), (13, "#$%& <> | * " * 40, "en", "a", 1),
        (None, prose(5, 120), "en", "a", 1), (14, prose(6, 200), "en", "a", 1), (14, prose(6, 200), "en", "a", 1),
        (15, "no\x00blank\u00a0here\u2003at\x0ball\x0c" + prose(7, 60), "en", None, 1),
    ]
    return [r + CLASH for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    """Rows by id; ids here may be null, and of equal rows one is returned."""
    return {r[key]: r for r in df.collect()}
