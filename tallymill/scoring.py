"""Scores of a task by its name: one long table of metrics, whatever the family.

Outcomes and completions are input tables; nothing here runs a program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators import bleu, metrics
from tallymill.tasks import TaskSpec, prompted


def _named(df: DataFrame, name: str, score: str) -> DataFrame:
    return df.select(F.lit(name).alias("metric"), F.col(score).cast("double").alias("score"))


def _words(text: str, into: str):
    return bleu.normalise(bleu.prepare(F.col(text))).alias(into)


def _by_group(task: TaskSpec, rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """Scores of each group, named ``group/metric``.

    Bug counts stand alone, every sample being a problem of its own. Programs have
    pass@k each, with their plain means as ``all`` and the number solved.
    """
    if task.group == "bugs":
        scores = metrics.group_pass(rows, [task.group], ok)
        name = F.concat(F.col(task.group).cast("string"), F.lit(" bugs/pass@1"))
        return scores.select(name.alias("metric"), "score")
    each = metrics.pass_at_k(rows, [key], ok, by=[task.group], ks=tuple(task.ks))
    means = metrics.macro_average(each.select(task.group, "metric", "score"), task.group, "metric", "score")
    solved = F.col(task.group) == "num_correct"
    name = F.when(solved, F.lit("num_correct")).otherwise(F.concat_ws("/", task.group, "metric"))
    return means.select(name.alias("metric"), "score")


def score_task(
    task: TaskSpec,
    rows: DataFrame,
    *,
    key: str = "problem_idx",
    sample: str = "sample_idx",
    text: str = "text",
    passed: str = "passed",
    reference: str = "task_reference",
    target: str = "target",
    seed: str = "seed",
) -> DataFrame:
    """``(metric, score)`` rows of a task's completions, by the task's own metric.

    ``rows`` has a row per sample. Which of its columns are read depends on the
    metric: outcomes (``passed``, with ``seed`` for perturbed prompts and the
    task's ``group`` column where it scores groups), answers in ``text`` with a
    numeric ``target``, or texts with a ``reference``. A task whose texts only
    feed another one has no score and raises an error.
    """
    ok = F.col(passed)
    if task.metric == "none":
        raise ValueError(f"{task.name} has no score of its own: its texts feed another task")
    if task.metric == "group_pass":
        return _by_group(task, rows, key, ok)
    if task.metric == "pass":
        return metrics.pass_at_k(rows, [key], ok, ks=tuple(task.ks)).select("metric", "score")
    if task.metric == "accuracy":
        return _named(rows.agg(F.avg(ok.cast("double")).alias("score")), "mean_score", "score")
    if task.metric == "robust":
        one = rows.withColumn("__variant", F.lit(task.name))
        strict = metrics.robust_pass(
            one, variant="__variant", problem=key, seed=seed, sample=sample, passed=ok
        )
        product = metrics.alt_robust_pass(
            one, variant="__variant", problem=key, seed=seed, passed=ok
        )
        return _named(strict, "robust-pass-at-1", "score").unionByName(
            _named(product, "alt-robust-pass-at-1", "score")
        )
    if task.metric in ("vote", "first_answer"):
        choose = metrics.voted_answers if task.metric == "vote" else metrics.first_answers
        chosen = choose(rows, key, sample, text)
        goals = rows.groupBy(key).agg(F.min(target).alias(target))
        return _named(
            metrics.answer_accuracy(chosen, goals, key, text, target), "accuracy", "accuracy"
        )
    if task.metric == "exact_match":
        found = metrics.exact_match(rows, key, F.col(text), F.col(reference))
        return _named(found, "exact_match", "score")
    pairs = rows.select(key, sample, _words(text, "candidate"), _words(reference, "reference"))
    if task.metric == "sentence_bleu":
        scores = bleu.mean_bleu(bleu.sentence_bleu(pairs, [key, sample]))
        return _named(scores, "bleu", "bleu")
    if task.metric == "corpus_bleu":
        return _named(bleu.corpus_bleu(pairs, [key, sample]), "bleu", "bleu")
    raise KeyError(f"unknown metric {task.metric}")


def references(benchmark: DataFrame, task: TaskSpec, key: str) -> DataFrame:
    """The references of a task, to save or to check as if they were completions."""
    return prompted(benchmark, task).select(key, F.col("task_reference").alias("reference"))


def check_references(
    benchmark: DataFrame, task: TaskSpec, outcomes: DataFrame, key: str, passed: str = "passed"
) -> DataFrame:
    """Problems whose own reference has no passing outcome: they are broken.

    ``outcomes`` holds the results of running each reference once.
    """
    good = outcomes.where(F.col(passed)).select(key).distinct()
    return references(benchmark, task, key).join(good, key, "left_anti")
