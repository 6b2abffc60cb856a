"""Scores over long outcome tables. Counts are combined before every shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import prompts

KS = (1, 10, 100)


def pass_estimate(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k draws without replacement is correct.

    Written with k factors, ``1 - prod (n-c-j)/(n-j)``, so a problem with any
    number of samples costs at most k multiplications.
    """
    ratio = reduce(
        lambda acc, j: acc * (n - c - j) / (n - j), range(k), F.lit(1.0)
    ) if k <= 10 else F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0),
        lambda acc, j: acc * (n - c - j) / (n - j),
    )
    return F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - ratio)


def problem_counts(outcomes: DataFrame, keys: Sequence[str], passed: Column) -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("c")
    )


def is_pass(status: Column, exit_code: Column) -> Column:
    return (status == "OK") & (exit_code == 0)


def pass_at_k(
    outcomes: DataFrame,
    problem: Sequence[str],
    passed: Column,
    by: Sequence[str] = (),
    ks: Sequence[int] = KS,
) -> DataFrame:
    """Mean pass@k over problems, for every k that each problem has samples for.

    The estimate has n factors, so equal ``(n, c)`` pairs are scored once: the
    problems are counted by pair first and weighted afterwards.
    """
    per_problem = problem_counts(outcomes, [*by, *problem], passed)
    pairs = per_problem.groupBy(*by, "n", "c").agg(F.count(F.lit(1)).alias("problems"))
    # A k beyond a problem's samples has no estimate and is dropped below.
    n, c = F.col("n"), F.col("c")
    spread = pairs.select(*by, "n", "problems", F.explode(F.array(*[
        F.struct(
            F.lit(k).cast("long").alias("k"),
            F.when(n >= k, pass_estimate(n, c, k)).alias("estimate"),
        ) for k in ks
    ])).alias("s")).select(*by, "n", "problems", "s.*")
    return (
        spread.groupBy(*by, "k")
        .agg(
            F.min("n").alias("least"),
            F.sum("problems").alias("problems"),
            F.sum(F.col("estimate") * F.col("problems")).alias("total"),
        )
        .where(F.col("k") <= F.col("least"))
        .select(
            *by, F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("metric"),
            "problems", (F.col("total") / F.col("problems")).alias("score"),
        )
    )


def group_pass(outcomes: DataFrame, group: Sequence[str], passed: Column) -> DataFrame:
    """Share passed per group; every sample stands for its own problem."""
    return outcomes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.when(passed, 1.0).otherwise(0.0)).alias("score"),
    )


def macro_average(scores: DataFrame, group: str, metric: str, value: str) -> DataFrame:
    """Scores per group, their plain mean as ``all``, and the correct count.

    Each score counts for its group and for ``all`` in one aggregation.
    """
    name = F.explode(F.array(F.col(group).cast("string"), F.lit("all"))).alias(group)
    means = scores.select(name, metric, value).groupBy(group, metric).agg(
        F.avg(value).alias(value), F.count(F.lit(1)).alias("__groups")
    )
    correct = F.when(
        (F.col(group) == "all") & (F.col(metric) == "pass@1"),
        F.struct(
            F.lit("num_correct").alias(group),
            (F.col(value) * F.col("__groups")).alias(value),
        ),
    )
    both = F.array_compact(F.array(F.struct(group, value), correct))
    return means.select(metric, F.explode(both).alias("r")).select(
        f"r.{group}", metric, f"r.{value}"
    )


def exact_match(rows: DataFrame, problem: str, generated: Column, reference: Column) -> DataFrame:
    """Mean exact match, with a check that problems have equal sample counts."""
    per_problem = rows.groupBy(problem).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(generated == reference).alias("hits")
    )
    return per_problem.agg(
        F.count(F.lit(1)).alias("problems"), F.sum("hits").alias("hits"),
        F.try_divide(F.sum("hits"), F.sum("n")).alias("score"),
        (F.min("n") == F.max("n")).alias("equal_samples"),
    )


def robust_pass(
    outcomes: DataFrame, *, variant: str, problem: str, seed: str, sample: str, passed: Column
) -> DataFrame:
    """Share of sample indexes for which every seed passes, per variant.

    Samples count from 0 in every seed, so index 0 is in all seeds and an index
    is complete when as many seeds hold it. Only complete indexes count;
    ``uneven`` is the number of problems whose seeds differ in sample count.
    """
    # A seed's samples are bits, 64 a row: those it holds, and those that fail.
    bit = F.expr(f"shiftleft(1L, cast(pmod({sample}, 64) AS int))")
    maps = outcomes.groupBy(variant, problem, seed, F.floor(F.col(sample) / 64).alias("__bucket")).agg(
        F.bit_or(bit).alias("held"), F.bit_or(F.when(passed, F.lit(0).cast("long")).otherwise(bit)).alias("failed"))
    seeds = maps.groupBy(variant, problem, "__bucket").agg(
        F.count(F.lit(1)).alias("seeds"), F.bit_and("held").alias("in_all"), F.bit_or("held").alias("in_any"),
        F.bit_or("failed").alias("failed"))
    # Buckets are counted by how many seeds hold them: a few rows a problem.
    robust = F.col("in_all").bitwiseAND(F.bitwise_not("failed"))
    counts = seeds.groupBy(variant, problem, "seeds").agg(
        F.sum(F.bit_count("in_all")).alias("indexes"), F.sum(F.bit_count(robust)).alias("robust"),
        F.bool_or(F.col("in_all") != F.col("in_any")).alias("ragged"))
    per_problem = counts.groupBy(variant, problem).agg(
        F.max_by("indexes", "seeds").alias("indexes"), F.max_by("robust", "seeds").alias("robust"),
        ((F.count(F.lit(1)) > 1) | F.bool_or("ragged")).alias("uneven"))
    return per_problem.groupBy(variant).agg(
        F.count(F.lit(1)).alias("problems"),
        F.count_if("uneven").alias("uneven"),
        F.avg(F.coalesce(F.try_divide("robust", "indexes"), F.lit(0.0))).alias("score"),
    )


def alt_robust_pass(
    outcomes: DataFrame, *, variant: str, problem: str, seed: str, passed: Column
) -> DataFrame:
    """Product over seeds of the pass rates, averaged over problems."""
    rates = outcomes.groupBy(variant, problem, seed).agg(
        F.avg(F.when(passed, 1.0).otherwise(0.0)).alias("rate")
    )
    products = rates.groupBy(variant, problem).agg(F.product("rate").alias("rate"))
    return products.groupBy(variant).agg(
        F.count(F.lit(1)).alias("problems"), F.avg("rate").alias("score")
    )


def usable_answer(answer: Column) -> Column:
    return answer.isNotNull() & ~F.startswith(answer, F.lit("failed:"))


def voted_answers(answers: DataFrame, task: str, sample: str, answer: str) -> DataFrame:
    """Most common usable answer; ties go to the one seen first.

    Two combining aggregations: no list of answers is ever built.
    """
    counted = answers.groupBy(task, answer).agg(
        F.count(F.lit(1)).alias("votes"), F.min(sample).alias("seen")
    )
    usable = usable_answer(F.col(answer))
    rank = F.when(usable, F.struct(F.col("votes"), -F.col("seen")))
    return counted.groupBy(task).agg(
        F.coalesce(F.max_by(F.when(usable, F.col(answer)), rank), F.lit("")).alias(answer)
    )


def first_answers(answers: DataFrame, task: str, sample: str, answer: str) -> DataFrame:
    """First usable answer of each task.

    Equal answers are combined first by hash; only their first places are
    compared, since a text beside a minimum would need the rows sorted.
    """
    seen = answers.where(usable_answer(F.col(answer))).groupBy(task, answer).agg(
        F.min(sample).alias("seen")
    )
    first = seen.groupBy(task).agg(F.min_by(answer, "seen").alias(answer))
    tasks = answers.select(task).distinct()
    return tasks.join(first, task, "left").select(
        task, F.coalesce(answer, F.lit("")).alias(answer)
    )


def answer_accuracy(
    chosen: DataFrame, references: DataFrame, task: str, answer: str, target: str
) -> DataFrame:
    """Share of answers within 0.001 of the target; unreadable ones fail."""
    joined = references.join(chosen, task, "left")
    value = prompts.number(F.coalesce(F.col(answer), F.lit("")))
    goal = F.col(target).cast("double")
    close = (F.abs(value - goal) < 1e-3) & ~F.isnan(value) & ~F.isnan(goal)
    return joined.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.avg(F.when(close, 1.0).otherwise(0.0)).alias("accuracy"),
        F.count_if(value.isNull()).alias("num_failed_execution"),
    )


def first_by_text(refs: DataFrame, text: str, order: str, columns: Sequence[str]) -> DataFrame:
    """First row for each text, found by hash with the text kept for equality."""
    return refs.groupBy(text).agg(
        F.min_by(F.struct(*columns), F.col(order)).alias("__first")
    ).select(text, "__first.*")


def argmax(scores: Column) -> Column:
    """Index of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def accuracy(rows: DataFrame, predicted: Column, label: Column) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(predicted == label, 1.0).otherwise(0.0)).alias("accuracy"),
    )


def join_references(
    completions: DataFrame, references: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Completions with their reference by key, with a count check.

    Spark broadcasts the references only below its size limit; beyond it the
    join is sorted and skewed problems are split at run time.
    """
    return completions.join(references, list(keys), "inner")


def reference_counts(
    completions: DataFrame, references: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Every problem of either side with its sample count and reference.

    Completions are counted before the join, so a hot problem joins as one row.
    ``side`` tells problems on one side only, so a mismatch is seen instead of
    being cut off.
    """
    counts = completions.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    known = references.withColumn("__known", F.lit(True))
    joined = counts.join(known, list(keys), "full_outer")
    side = (
        F.when(F.col("__known").isNull(), F.lit("completions"))
        .when(F.col("samples").isNull(), F.lit("references"))
        .otherwise(F.lit("both"))
    )
    return joined.withColumn("side", side).withColumn(
        "samples", F.coalesce("samples", F.lit(0))
    ).drop("__known")
