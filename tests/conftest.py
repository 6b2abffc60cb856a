from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallymill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def apply(spark):
    """Values of a text column builder over plain Python texts, in order."""

    def run(build, texts, schema="i long, text string"):
        rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(texts)]
        df = spark.createDataFrame(rows, schema)
        out = df.select("i", build(df).alias("out")).orderBy("i").collect()
        return [row["out"] for row in out]

    return run
