"""Compare registered queries with their SQL: python scripts/check.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallymill.plans import ORACLES, QUERIES  # noqa: E402
from tallymill.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((key, plain(v)) for key, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for file in sorted((DATA / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS FROM '{file}'")
    bad = []
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, str(DATA / sf))
            got = [tuple(row) for row in df.collect()]
            spent = time.time() - begin
            note = ""
            if name in ORACLES:
                rel = con.sql(ORACLES[name])
                want = rel.fetchall()
                a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
                ok = sorted(df.columns) == sorted(rel.columns) and a == b
                if not ok:
                    bad.append(name)
                    off = [x for x in zip(a, b) if x[0] != x[1]][:2]
                    note = f" {sorted(df.columns)} {sorted(rel.columns)} {len(a)}/{len(b)} {str(off)[:900]}"
                types = dict(zip(rel.columns, map(str, rel.types)))
                verdict = "same" if ok else "DIFFERENT"
                note += " " + " ".join(
                    f"{c}:{d}/{types.get(c)}" for c, d in df.dtypes
                    if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
                        "double": "DOUBLE", "boolean": "BOOLEAN"}.get(d, d) != types.get(c)
                )
            else:
                verdict = "rows only"
            print(f"{name:28s} {len(got):7d} rows {spent:6.2f}s {verdict}{note}", flush=True)
        except Exception as error:  # report and go on with the next query
            bad.append(name)
            print(f"{name:28s} ERROR {str(error)[:1500]}", flush=True)
    print("failing:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
