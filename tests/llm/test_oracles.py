"""Registered queries with SQL, against it."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import duckdb
import pytest

from tallymill.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
_spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parents[2] / "scripts" / "check.py")
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS FROM '{file}'")
    df, want = QUERIES[name](spark, str(DATA)), con.sql(ORACLES[name])
    rows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(want.columns)
    assert compare.rows_of(df.columns, rows) == compare.rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_url_filters", "op7_line_dedup"])
def test_native_queries_run_no_python(spark, capsys, name):
    QUERIES[name](spark, str(DATA)).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "MapInArrow", "MapInPandas", "CartesianProduct"))
