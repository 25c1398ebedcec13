from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, key string, kept int, sha string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "z", "z", "z", 7, "z") for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, empty, white and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "one two three four five six seven eight", "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, long, "b"), (6, long, None), (7, "one", "a")]
    rows += [(8, "one two three four five six seven eight", "b")] * 3 + [(None, "one", "a"), (None, None, None), (9, "x y   z\x1c\x85", "c"), (9, "l1 a\nl2 b\nl3 c\nl4 d", "c"), (10, "l0\nl1 a\nl2 b\nl3 c\nl4 d\nend", "c")]
    return docs_of(rows)
