from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallymill.operators import outcomes as o
from tallymill.operators import timing

CASES = [
    # language, phase, timed out, exit, stdout, stderr, status
    ("python", "run", True, -1, "", "", "Timeout"),
    ("py", "run", False, 0, "", "SyntaxError", "OK"),
    ("python", "run", False, 1, "", "SyntaxError: x", "SyntaxError"),
    ("python", "run", False, 1, "SyntaxError", "", "Exception"),
    ("js", "run", False, 1, "ERR_ASSERTION SyntaxError", "", "AssertionError"),
    ("javascript", "run", False, 1, "", "ReferenceError", "ReferenceError"),
    ("ts", "build", False, 2, "", "", "SyntaxError"),
    ("ts", "build", False, 0, "", "", None),
    ("ts", "run", False, 1, "ERR_ASSERTION", "", "Exception"),
    ("r", "run", False, 1, "unexpected", "", "SyntaxError"),
    ("r", "run", False, 1, "", "", "AssertionError"),
    ("r", "run", False, 1, None, "x", "Exception"),
    ("java", "build", True, -1, "", "", "SyntaxError"),
    ("swift", "build", True, -1, "", "", "Timeout"),
    ("rs", "build", False, 1, "", "", "SyntaxError"),
    ("rust", "run", False, 101, "", "", "Exception"),
    ("cpp", "run", False, 0, "", "", "OK"),
    ("scala", "run", False, 0, "", "warn", "Exception"),
    ("scala", "run", False, 0, "", "", "OK"),
    ("cs", "run", False, 0, "", "Unhandled Exception", "Exception"),
    ("cs", "run", False, 1, "", "", "OK"),
    ("go", "run", False, 1, "[build failed] FAIL", "", "SyntaxError"),
    ("go", "run", False, 1, "FAIL", "", "Exception"),
    ("go_test.go", "run", False, 1, "", "", "OK"),
    ("php", "run", True, -1, "", "", "Exception"),
    ("php", "run", False, 0, "PHP Parse error", "", "SyntaxError"),
    ("rkt", "run", False, 0, "", "read-syntax", "SyntaxError"),
    ("racket", "run", True, -1, "", "", "Exception"),
    ("racket", "run", False, 0, "", "", "OK"),
    ("pl", "run", False, 0, "ERROR", "", "Exception"),
    ("d", "run", False, 1, "", "Error: x", "SyntaxError"),
    ("sh", "run", False, 1, "", "syntax error", "SyntaxError"),
    ("jl", "run", False, 1, "", "", "Exception"),
    ("rb", "run", False, 1, "", "boom", "SyntaxError"),
    ("lua", "run", False, 1, "", "boom", "Exception"),
    ("cobol", "run", False, 0, "", "", "Exception"),
]


def test_status_rules(spark):
    df = spark.createDataFrame(
        [(i, *case[:6]) for i, case in enumerate(CASES)],
        "i int, l string, p string, t boolean, e int, o string, r string",
    )
    rows = df.select("i", o.status(
        o.evaluator(F.col("l")), F.col("p"), F.col("t"), F.col("e"), F.col("o"), F.col("r")
    ).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [case[6] for case in CASES]


def test_captured(spark):
    df = spark.createDataFrame([("a!!int b",), (None,), ("x" * 3000,)], "t string")
    got = [r[0] for r in df.select(o.captured(F.col("t"), "!!int")).collect()]
    assert got == ["a b", "", "x" * 2048]


@pytest.mark.parametrize("salts", [1, 10, 64])
def test_share_results_with_a_hot_program(spark, salts):
    rows = spark.range(3000).select(
        "id", F.lit("py").alias("lang"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))).alias("program"),
    )
    once = o.distinct_programs(rows, "program", "lang")
    assert once.count() == 51
    run = once.select("lang", "program_md5", F.upper("program").alias("out"))
    got = o.share_results(rows, run, "program", "lang", "id", spread=salts)
    assert got.count() == 3000
    assert got.where(F.col("out") != F.upper("program")).count() == 0
    assert got.where(F.col("out").isNull()).count() == 0


def test_missing_results_stay_null(spark):
    rows = spark.createDataFrame([(1, "py", "a"), (2, "py", "b")], "id long, lang string, program string")
    run = o.distinct_programs(rows.where("id = 1"), "program", "lang").select("lang", "program_md5", F.lit(1).alias("r"))
    got = {r["id"]: r["r"] for r in o.share_results(rows, run, "program", "lang", "id").collect()}
    assert got == {1: 1, 2: None}


def test_summary(spark):
    df = spark.createDataFrame([("a", "OK"), ("a", "SyntaxError"), ("b", "OK"), ("c", None)], "l string, s string")
    got = {r["l"]: (r["total"], r["passed"], r["syntax_errors"], r["all_passed"]) for r in o.status_summary(df, "l", "s").collect()}
    assert got == {"a": (2, 1, 1, False), "b": (1, 1, 0, True), "c": (1, 0, 0, False)}


def test_gaps(spark):
    rows = [("a", 0), ("a", 3), ("a", 3), ("a", 25), ("b", 1)]
    df = spark.createDataFrame(rows, "g string, n long")
    for width in (1, 7, 1000):
        got = sorted((r["g"], r["n"]) for r in o.number_gaps(df, "g", "n", width).collect())
        assert got == [("a", n) for n in range(25) if n not in (0, 3)] + [("b", 0)]


def test_leaderboard(spark):
    rows = [
        ("m", "humaneval", json.dumps({"humaneval": {"pass@1": 0.5}})),
        ("m", "multiple-js", json.dumps({"multiple-js": {"pass@10": 0.5}})),
        ("m", "mbpp", "{}"), ("m", "multiple-rs", "broken"),
    ]
    files = spark.createDataFrame(rows, "model string, task string, body string")
    scores = o.leaderboard(files)
    assert {r["task"]: r["pass_at_1"] for r in scores.collect()} == {
        "humaneval": 0.5, "multiple-js": None, "multiple-rs": None
    }
    assert [r["task"] for r in o.skipped_metrics(files).collect()] == ["mbpp"]
    body = json.loads(o.nested_leaderboard(scores).first()["body"])
    assert body["meta"] == {"model": "m"}
    assert {"task": "multiple-js", "pass@1": None} in body["results"]
    wide = o.wide_leaderboard(scores).first()
    assert wide["humaneval"] == 0.5 and wide["multiple-js"] is None


def test_scopes(spark):
    df = spark.createDataFrame([(x,) for x in (0, 99, 100, 499, 500, 1999, 2000, 4999, 5000, -1)], "n int")
    assert [r[0] for r in df.select(timing.scope(F.col("n"))).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_percentile(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for values in ([5.0], [1.0, 2.0], list(rng.normal(size=501)), [2.0] * 300 + list(rng.normal(size=99))):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert timing.percentile(df, "v").first()["p95"] == pytest.approx(np.quantile(values, 0.95))


def test_neighbours(spark):
    rows = [(0, 1), (9, 2), (10, 4), (-10, 8), (30, 16), (0, 32)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r["target"]: r["near"] for r in timing.neighbour_sum(df, "k", F.col("v")).collect()}
    for target in got:
        assert got[target] == sum(v for k, v in rows if target - 10 <= k < target + 10)


@pytest.mark.parametrize("back,ahead,keys", [(10, 10, 4), (0, 1, 1), (0, 0, 8), (3, 0, 2), (1, 7, 5), (500, 2, 64)])
def test_neighbours_across_ranges(spark, monkeypatch, back, ahead, keys):
    monkeypatch.setattr(timing, "RANGE_KEYS", keys)
    rows = [(i * i % 211 - 100, i) for i in range(300)] + [(None, 5), (2**62, 3), (2**62 + 1, 4), (7, None), (1000, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r["target"]: (r["own"], r["near"]) for r in timing.neighbour_sum(df, "k", F.col("v"), back, ahead).collect()}
    known = [(k, v) for k, v in rows if k is not None and v is not None]
    assert set(got) == {k for k, _ in known}
    for target, (own, near) in got.items():
        seen = [v for k, v in known if target - back <= k < target + ahead]
        assert own == sum(v for k, v in known if k == target)
        assert near == (sum(seen) if seen else None)


def test_neighbours_cost_the_same_for_any_reach(spark):
    df = spark.range(20_000).select((F.col("id") * 3).alias("k"))
    far = timing.neighbour_sum(df, "k", F.lit(1), 10**9, 10**9)
    assert far.where("near <> 20000").count() == 0 and far.count() == 20_000
    assert timing.neighbour_sum(df.limit(0), "k", F.lit(1)).count() == 0
    with pytest.raises(ValueError):
        timing.neighbour_sum(df, "k", F.lit(1), -1, 0)


def test_gap_ranges_of_far_numbers_are_not_listed(spark):
    rows = [("a", 10**12), ("a", 0), ("a", 1), ("b", 3), ("b", 3), (None, 1), ("c", None), ("d", -4)]
    df = spark.createDataFrame(rows, "g string, n long")
    got = sorted((r["g"] or "", r["first"], r["last"]) for r in o.gap_ranges(df, "g", "n").collect())
    assert got == [("", 0, 0), ("a", 2, 10**12 - 1), ("b", 0, 2)]
    some = spark.range(50_000).where("id % 17 <> 3").select(F.lit("x").alias("g"), F.col("id").alias("n"))
    for width in (1, 64, 10**6):
        got = [r["n"] for r in o.number_gaps(some, "g", "n", width).orderBy("n").collect()]
        assert got == list(range(3, 49_999, 17))
