from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallymill.functions import prompts
from tallymill.sources import files


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return path


def test_generations_round_trip(spark, tmp_path):
    put(tmp_path, "mbpp/m1/generations.json", [["a", "b\n"], ["c"], []])
    put(tmp_path, "conala/m2/generations.json", [["é"]])
    df = files.read_generations(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in df.select("task", "model", "problem_idx", "sample_idx", "text").collect())
    assert rows == [
        ("conala", "m2", 0, 0, "é"), ("mbpp", "m1", 0, 0, "a"), ("mbpp", "m1", 0, 1, "b\n"), ("mbpp", "m1", 1, 0, "c"),
    ]
    assert files.read_generations(spark, str(tmp_path), n_tasks=1).count() == 3
    assert files.read_generations(spark, str(tmp_path), limit_start=1).count() == 1

    files.save_generations(df, str(tmp_path / "long"))
    again = spark.read.parquet(str(tmp_path / "long"))
    assert sorted(tuple(r) for r in again.select("task", "model", "problem_idx", "sample_idx", "text").collect()) == rows
    files.export_generations(df, str(tmp_path / "nested"))
    back = files.read_exported(spark, str(tmp_path / "nested"))
    assert sorted(tuple(r) for r in back.select("task", "model", "problem_idx", "sample_idx", "text").collect()) == rows


def test_export_has_one_problem_a_line(spark, tmp_path):
    df = spark.range(2_000).select(
        F.lit("t").alias("task"), F.lit("m").alias("model"), F.col("id").alias("problem_idx"),
        F.lit(0).alias("sample_idx"), F.lit("x").alias("text"),
    )
    files.export_generations(df, str(tmp_path / "n"))
    lines = spark.read.text(str(tmp_path / "n"))
    assert lines.count() == 2_000
    assert lines.where(F.col("value") == '{"problem_idx":7,"texts":["x"]}').count() == 1


def test_benchmark_and_corpus(spark, tmp_path):
    df = spark.createDataFrame([("test", "x", "py", 1), ("train", "x", "js", 2)], "split string, config string, lang string, v int")
    files.save_corpus(df, str(tmp_path / "c"), "lang")
    assert files.read_corpus(spark, str(tmp_path / "c"), "js").first()["v"] == 2
    assert files.read_corpus(spark, str(tmp_path / "c")).count() == 2
    assert files.read_benchmark(spark, str(tmp_path / "c"), "test", "x").first()["v"] == 1


def test_partition_column_is_pruned(spark, tmp_path, capsys):
    df = spark.createDataFrame([("py", 1), ("js", 2)], "lang string, v int")
    files.save_corpus(df, str(tmp_path / "c"), "lang")
    files.read_corpus(spark, str(tmp_path / "c"), "js").explain("formatted")
    assert "PartitionFilters: [isnotnull(lang" in capsys.readouterr().out


def test_descriptions(spark, tmp_path):
    path = put(tmp_path, "d.json", [["one", "two"], ["three"]])
    rows = files.read_descriptions(spark, str(path)).orderBy("problem_idx", "candidate").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "one"), (0, 1, "two"), (1, 0, "three")]


def test_metrics(spark, tmp_path):
    scores = spark.createDataFrame([("mbpp", "pass@1", 0.5), ("mbpp", "pass@10", 1.0)], "task string, metric string, value double")
    files.save_metrics(scores, str(tmp_path / "m"), {"n_samples": "20"})
    row = spark.read.json(str(tmp_path / "m")).first()
    assert row["metrics"]["pass@1"] == 0.5 and row["config"]["n_samples"] == "20"


def test_metric_files(spark, tmp_path):
    put(tmp_path, "metrics_humaneval_m.json", {"humaneval": {"pass@1": 0.25}})
    put(tmp_path, "metrics_mbpp_m.json", {})
    df = files.read_metric_files(spark, str(tmp_path / "*.json"), "m")
    assert sorted(r["task"] for r in df.collect()) == ["humaneval", "mbpp"]


def test_reports(spark, tmp_path):
    row = spark.createDataFrame([("t", 10, 8, 4, 0.5)], files.TOKEN_REPORT_SCHEMA)
    for _ in range(2):
        files.append_token_report(row, str(tmp_path / "r"))
    assert files.read_token_report(spark, str(tmp_path / "r")).count() == 2
    timing = spark.createDataFrame([(1, 2, .1, .2, .3, .4, 5, .6, .7)], files.TIMING_SCHEMA)
    files.save_timings(timing, str(tmp_path / "t"))
    assert tuple(files.read_timings(spark, str(tmp_path / "t")).first()) == (1, 2, .1, .2, .3, .4, 5, .6, .7)
    status = spark.createDataFrame([("py", "HumanEval_3_x", "OK")], files.STATUS_SCHEMA)
    files.save_statuses(status, str(tmp_path / "s"))
    assert tuple(files.read_statuses(spark, str(tmp_path / "s")).first()) == ("py", "HumanEval_3_x", "OK")


def test_shots(spark, tmp_path):
    store = {"instruction1": "a", "solution1": "b", "instruction2": "c", "solution2": "d"}
    path = put(tmp_path, "shots.json", json.dumps(store, indent=2))
    shots = files.read_shots(spark, str(path)).select(F.struct(
        F.col("instruction1").alias("ask1"), F.col("solution1").alias("answer1"),
        F.col("instruction2").alias("ask2"), F.col("solution2").alias("answer2"),
    ).alias("e"))
    made = shots.select(prompts.two_shot_from(F.col("e"), F.lit("t"), "E", "A", "B").alias("p")).first()["p"]
    assert made.startswith("E\nA:\na") and made.count("\nB:\n") == 3


def test_results(spark, tmp_path):
    entry = {"status": "OK", "exit_code": 0, "stdout": "", "stderr": "", "program": "x", "timestamp": 1}
    for run, count in (("new", 2), ("old", 1)):
        put(tmp_path, f"{run}/p.results.json", json.dumps(
            {"name": "p", "language": "py", "run_id": run, "results": [entry] * count}, indent=1))
    assert files.read_results(spark, str(tmp_path / "*/*.results.json")).count() == 3
    rows = files.read_results(spark, str(tmp_path / "*/*.results.json"), "new").collect()
    assert [r["sample_idx"] for r in rows] == [0, 1] and rows[0]["status"] == "OK"


def test_completions(spark, tmp_path):
    df = spark.createDataFrame([("t", ["a"], ["b"])], "task_id string, raw_generation array<string>, generation array<string>")
    files.save_completions(df, str(tmp_path / "c"))
    assert files.read_completions(spark, str(tmp_path / "c")).first()["generation"] == ["b"]


def test_broken_nested_file_is_no_rows(spark, tmp_path):
    put(tmp_path, "t/m/generations.json", "[[")
    assert files.read_generations(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["stray.json"])
def test_only_generation_files_are_read(spark, tmp_path, name):
    put(tmp_path, "t/m/generations.json", [["a"]])
    put(tmp_path, f"t/m/{name}", [["b"]])
    assert files.read_generations(spark, str(tmp_path)).count() == 1


NESTED = [["a", "b\n\"q\" [x], \\", ""], [], ["é\u0000\\\"", "[[", "]],", "😀 \t"], ["\\\\"], [",", "\""]]


@pytest.mark.parametrize("indent", [None, 1])
def test_nested_files_are_cut_anywhere(spark, tmp_path, indent):
    """Byte ranges of a few bytes give the same rows as the whole file."""
    (tmp_path / "t" / "m").mkdir(parents=True)
    (tmp_path / "t" / "m" / "generations.json").write_text(json.dumps(NESTED, indent=indent), encoding="utf-8")
    want = sorted((i, j, x) for i, row in enumerate(NESTED) for j, x in enumerate(row))
    names = {"spark.sql.files.maxPartitionBytes": "7", "spark.sql.files.openCostInBytes": "1"}
    held = {name: spark.conf.get(name) for name in names}
    try:
        for few in (False, True):
            for name in names if few else ():
                spark.conf.set(name, names[name])
            df = files.read_generations(spark, str(tmp_path))
            assert sorted((r["problem_idx"], r["sample_idx"], r["text"]) for r in df.collect()) == want
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def test_a_large_nested_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "t" / "m").mkdir(parents=True)
    rows = [[f"p{i} \"x\"", f"s{i}"] for i in range(60_000)]
    (tmp_path / "t" / "m" / "generations.json").write_text(json.dumps(rows))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        cut = spark.read.option("lineSep", '"').text(str(tmp_path / "t" / "m" / "generations.json"))
        assert cut.rdd.getNumPartitions() > 10
        df = files.read_generations(spark, str(tmp_path), n_tasks=50_000, limit_start=5_000)
        assert df.count() == 100_000
        some = df.where("problem_idx = 54321").orderBy("sample_idx").select("text").collect()
        assert [r[0] for r in some] == rows[54_321]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_a_run_written_again_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = [("m1", 1, 2, 3, 0.5), ("m2", 4, 5, 6, 0.25)]
    report = spark.createDataFrame(rows, files.TOKEN_REPORT_SCHEMA)
    files.append_token_report(report.limit(1), path, run_id="r1")
    files.append_token_report(report, path, run_id="r1")
    files.append_token_report(report, path, run_id="r2")
    files.append_token_report(report, path, run_id="r2")
    assert sorted(r["model"] for r in files.read_token_report(spark, path).collect()) == ["m1", "m1", "m2", "m2"]
    for _ in range(2):
        files.append_results(spark.range(3).select(F.col("id").alias("x")), str(tmp_path / "json"), run_id="r")
        files.append_statuses(spark.createDataFrame([("py", "a", "OK")], files.STATUS_SCHEMA), str(tmp_path / "st"), run_id="r")
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert files.read_statuses(spark, str(tmp_path / "st")).count() == 1
