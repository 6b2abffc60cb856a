"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib.util
import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tallymill.plans import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

_spec = importlib.util.spec_from_file_location("check", ROOT / "scripts" / "check.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in sorted(DATA.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    rows = [tuple(row) for row in df.collect()]
    assert rows
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert check.rows_of(df.columns, rows) == check.rows_of(want.columns, want.fetchall())


def test_queries_of_the_library_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_no_plan_has_a_python_worker(spark, capsys):
    for name, run in QUERIES.items():
        run(spark, str(DATA)).explain("formatted")
        plan = capsys.readouterr().out
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas", plan), name
        assert not re.search(r"CartesianProduct", plan), name
