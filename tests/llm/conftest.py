from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, size string, key string, label string, _bucket string"


def rows(texts, first=0, source=lambda i: f"s{i % 3}"):
    return [(first + i, t, "en", source(i), None if t is None else len(t), "x", "y", "z", "w", "v") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table, with columns whose names the operators use themselves."""

    def make(texts, first=0, source=lambda i: f"s{i % 3}"):
        return spark.createDataFrame(rows(texts, first, source), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and sources, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    body = rows([None, "", "  \t\n ", "one", "one", "one two", long, "ünï " * 80, "x" * 5000, long + " end"])
    body += [body[3], body[3], (None, "one", None, None, 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(body, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def words_of():
    def make(n, seed, vocabulary=400):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
        return [rng.choice(pool) for _ in range(n)]

    return make
