from __future__ import annotations

import pytest

EDGE = [
    (1, None, "en", None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one two three", "en", None, 13),
    (5, "one two three", "en", "b", 13),
    (5, "one two three", "en", "b", 13),
    (None, "Mail jo@example.org or +1 (234) 555-6789 now, please do it today", "de", "b", 60),
    (6, "word " * 40_000, "en", "a", 200_000),
    (7, "x" * 50_000, "en", "c", 50_000),
    (8, "Ünïcode wörds ß and 4111 1111 1111 1111 at 10.0.0.256 or 10.0.0.25", "de", "c", 70),
]
#: names that operators use inside
CLASH = ["words", "lines", "hashes", "row", "host", "digest", "n", "cls", "bits", "hits", "size", "key", "label", "x", "token"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(*row, *["clash"] * len(CLASH)) for row in EDGE]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
