from __future__ import annotations

import pytest

EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one two three four"),
    (6, "One two three four"),
    (7, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (8, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (9, "start the quick brown fox jumps over the lazy dog near the river bank today end"),
    (10, "word " * 9000),
    (11, "é ü ñ — 日本 🙂 ￿ a\x00b"),
    (12, "x" * 70000),
    (None, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (13, "1234 5678 ###"),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and long texts, ties, and columns whose names clash with ours."""
    rows = [
        (d, t, "en" if d != 4 else None, "s", len(t or ""), True, 5, b"x", "y", 1, *"abcdefgh")
        for d, t in EDGES
    ]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, kept boolean, "
        "row int, print binary, root string, length int, __text string, __gone string, "
        "__id string, __sha string, _id string, _gone string, tree string, lines string",
    )


@pytest.fixture(scope="session")
def repeated(odd):
    return odd.unionByName(odd)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
