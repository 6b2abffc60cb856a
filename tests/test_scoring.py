from __future__ import annotations

import pytest

from tallymill import scoring, tasks

SHOTS = {"questions": [""] * 8, "solutions": [""] * 8}


def scores(df):
    return {r["metric"]: r["score"] for r in df.collect()}


def test_pass_rate_of_a_task(spark):
    """One of four problems passes, as in the published example run: 0.25."""
    rows = spark.createDataFrame(
        [(p, s, p == 0) for p in range(4) for s in range(2)], "problem_idx long, sample_idx int, passed boolean")
    assert scores(scoring.score_task(tasks.spec("humaneval"), rows)) == {"pass@1": 0.25}


def test_perturbed_task_needs_all_seeds(spark):
    name = next(n for n in tasks.fixed.task_names() if n.startswith("perturbed-"))
    rows = spark.createDataFrame(
        [(0, 0, 0, True), (0, 1, 0, True), (1, 0, 0, True), (1, 1, 0, False)],
        "problem_idx long, seed int, sample_idx int, passed boolean")
    assert scores(scoring.score_task(tasks.spec(name), rows)) == {
        "robust-pass-at-1": 0.5, "alt-robust-pass-at-1": 0.5}


def test_answers_are_voted_or_taken_first(spark):
    rows = spark.createDataFrame(
        [(0, 0, "1", 2.0), (0, 1, "2", 2.0), (0, 2, "2", 2.0), (1, 0, "failed: x", 5.0), (1, 1, "5", 5.0)],
        "problem_idx long, sample_idx int, text string, target double")
    voted = tasks.spec("pal-gsm8k-majority_voting", shots=SHOTS)
    first = tasks.spec("pal-gsm8k-greedy", shots=SHOTS)
    assert scores(scoring.score_task(voted, rows)) == {"accuracy": 1.0}
    assert scores(scoring.score_task(first, rows)) == {"accuracy": 0.5}


def test_texts_are_compared_with_references(spark):
    rows = spark.createDataFrame(
        [(0, 0, "adds one to it", "adds one to it"), (1, 0, "x", "y")],
        "problem_idx long, sample_idx int, text string, task_reference string")
    assert scores(scoring.score_task(tasks.spec("python_bugs"), rows)) == {"exact_match": 0.5}
    bleu = scores(scoring.score_task(tasks.spec("codexglue_code_to_text-java"), rows.where("problem_idx = 0")))
    assert bleu == {"bleu": pytest.approx(100.0)}


def test_broken_references_are_named(spark):
    bench = spark.createDataFrame([(0, "p", "t", "f"), (1, "q", "u", "g")], "problem_idx long, prompt string, test string, entry_point string")
    ran = spark.createDataFrame([(0, True), (1, False)], "problem_idx long, passed boolean")
    broken = scoring.check_references(bench, tasks.spec("humaneval"), ran, "problem_idx").collect()
    assert [(r["problem_idx"], r["reference"]) for r in broken] == [(1, "\nu\ncheck(g)")]


def test_groups_are_scored_one_by_one(spark):
    rows = spark.createDataFrame(
        [(0, 0, True, 1, "gcd"), (0, 1, False, 1, "gcd"), (1, 0, True, 2, "sieve"), (1, 1, True, 2, "sieve")],
        "problem_idx long, sample_idx int, passed boolean, bugs long, name string")
    assert scores(scoring.score_task(tasks.spec("parity"), rows)) == {"1 bugs/pass@1": 0.5, "2 bugs/pass@1": 1.0}
    assert scores(scoring.score_task(tasks.spec("quixbugs"), rows)) == {
        "gcd/pass@1": 0.5, "sieve/pass@1": 1.0, "all/pass@1": 0.75, "num_correct": 1.5}


def test_every_task_has_a_score_or_says_that_it_has_none(spark):
    rows = spark.createDataFrame(
        [(0, 0, True, 1, 1, "gcd", "1", "1", 1.0)],
        "problem_idx long, sample_idx int, passed boolean, seed int, bugs long, name string, text string, "
        "task_reference string, target double")
    shots = {**SHOTS, **{f"{a}{i}": "" for a in ("instruction", "solution") for i in (1, 2)}}
    shots |= {x: {f"{a}{i}": "" for a in ("source", "target") for i in (1, 2)}
              for x in tasks.fixed.TRANSLATION_LANGUAGES.values()}
    for name in tasks.fixed.task_names():
        task = tasks.spec(name, shots=shots)
        if task.metric == "none":
            with pytest.raises(ValueError):
                scoring.score_task(task, rows)
        else:
            assert scoring.score_task(task, rows).columns == ["metric", "score"]
