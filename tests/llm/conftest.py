"""Small awkward tables that every operator has to take."""

from __future__ import annotations

import pytest

LONG = "word " * 30_000 + "end"

#: Null, empty and blank texts, repeated rows, ties, a very long text and texts beyond ASCII.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog\nsecond line here\nthe quick brown fox jumps over the lazy dog", "s0"),
    (1, "the quick brown fox jumps over the lazy dog\nsecond line here\nthe quick brown fox jumps over the lazy dog", "s0"),
    (2, None, "s0"), (3, "", None), (4, " \t\n ", "s1"), (None, "a text without an id", "s1"), (None, None, None),
    (7, "Größe naïve café 数字 🙂 \u00a0x\u2003y don't <|endoftext|> it's 12345", "s1"),
    (8, LONG, "s2"), (9, "tie one two three", "s2"), (10, "tie one two three", "s2"),
    (11, "\r\nwindows\r\nlines\r\n\u0085next\x0b\x0c", "s2"),
]


@pytest.fixture()
def awkward(spark):
    """Documents with extra columns whose names operators might use themselves."""
    return spark.createDataFrame(
        [(*row, "x", 5, 7, "y") for row in ROWS],
        "doc_id long, text string, source string, words string, row long, n long, line string")


@pytest.fixture()
def awkward_written(awkward, tmp_path):
    path = str(tmp_path / "documents")
    awkward.coalesce(1).write.parquet(path)
    return awkward.sparkSession.read.schema(awkward.schema).parquet(path)


@pytest.fixture()
def rows():
    return ROWS
