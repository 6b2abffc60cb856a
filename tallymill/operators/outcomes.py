"""Process results: status rules, clean-up, sharing by program, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import text as t

# Status rules by evaluator, read left to right; the first rule
# that holds names the status. "build" rules see the build phase only.
#   timeout, exit_ok, exit_bad          process facts
#   err:x, out:x, any:x                 text in stderr, stdout or either
#   no_err, some_err                    stderr empty or not
RUN_RULES: dict[str, list[tuple[str, str]]] = {
    "python": [("timeout", "Timeout"), ("exit_ok", "OK"), ("err:SyntaxError", "SyntaxError")],
    "javascript": [
        ("timeout", "Timeout"), ("exit_ok", "OK"), ("any:ERR_ASSERTION", "AssertionError"),
        ("any:SyntaxError", "SyntaxError"), ("any:ReferenceError", "ReferenceError"),
    ],
    "ts": [
        ("timeout", "Timeout"), ("exit_ok", "OK"), ("err:ERR_ASSERTION", "AssertionError"),
        ("err:SyntaxError", "SyntaxError"), ("err:ReferenceError", "ReferenceError"),
    ],
    "r": [
        ("timeout", "Timeout"), ("exit_ok", "OK"), ("any:unexpected", "SyntaxError"),
        ("no_err", "AssertionError"),
    ],
    "java": [("timeout", "Timeout"), ("exit_ok", "OK")],
    "cpp": [("timeout", "Timeout"), ("exit_ok", "OK")],
    "scala": [("timeout", "Timeout"), ("exit_ok&no_err", "OK")],
    "swift": [("timeout", "Timeout"), ("exit_ok", "OK")],
    "rust": [("timeout", "Timeout"), ("exit_ok", "OK")],
    "cs": [
        ("timeout", "Timeout"), ("err:System.Diagnostics.DefaultTraceListener.Fail", "Exception"),
        ("err:Unhandled Exception", "Exception"), ("always", "OK"),
    ],
    "go": [
        ("timeout", "Timeout"), ("out:[setup failed]", "SyntaxError"),
        ("out:[build failed]", "SyntaxError"), ("out:FAIL", "Exception"), ("always", "OK"),
    ],
    "php": [("out:PHP Parse error", "SyntaxError"), ("exit_ok", "OK")],
    "racket": [
        ("exit_ok&no_err", "OK"), ("err:read-syntax", "SyntaxError"),
    ],
    "pl": [
        ("timeout", "Timeout"), ("exit_bad", "Exception"), ("any:ERROR", "Exception"),
        ("always", "OK"),
    ],
    "d": [("timeout", "Timeout"), ("exit_ok", "OK"), ("err:Error:", "SyntaxError")],
    "sh": [("timeout", "Timeout"), ("exit_ok", "OK"), ("err:syntax error", "SyntaxError")],
    "julia": [("timeout", "Timeout"), ("exit_ok", "OK"), ("some_err", "SyntaxError")],
    "ruby": [("timeout", "Timeout"), ("exit_ok", "OK"), ("some_err", "SyntaxError")],
    "lua": [("timeout", "Timeout"), ("exit_ok", "OK")],
}
BUILD_RULES: dict[str, list[tuple[str, str]]] = {
    "ts": [("exit_bad", "SyntaxError")],
    "java": [("exit_bad", "SyntaxError")],
    "cpp": [("exit_bad", "SyntaxError")],
    "scala": [("exit_bad", "SyntaxError")],
    "swift": [("timeout", "Timeout"), ("exit_bad", "SyntaxError")],
    "rust": [("timeout", "Timeout"), ("exit_bad", "SyntaxError")],
    "cs": [("exit_bad", "SyntaxError")],
}


def _holds(rule: str, c: dict[str, Column]) -> Column:
    if "&" in rule:
        first, second = rule.split("&", 1)
        return _holds(first, c) & _holds(second, c)
    simple = {
        "timeout": c["timed_out"], "exit_ok": c["exit_code"] == 0,
        "exit_bad": c["exit_code"] != 0, "no_err": c["stderr"] == "",
        "some_err": c["stderr"] != "", "always": F.lit(True),
    }
    if rule in simple:
        return simple[rule]
    where, word = rule.split(":", 1)
    in_err, in_out = t.contains(c["stderr"], word), t.contains(c["stdout"], word)
    return {"err": in_err, "out": in_out, "any": in_err | in_out}[where]


def evaluator(language: Column) -> Column:
    """Canonical evaluator of a language alias; unknown names stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in fixed.EVALUATOR_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, language), language)


def status(
    language: Column, phase: Column, timed_out: Column, exit_code: Column,
    stdout: Column, stderr: Column,
) -> Column:
    """Status of a process result; a passed build phase has no status yet.

    Give ``language`` as a column of the table (``evaluator`` in a step of its
    own): it is compared with every evaluator.
    """
    columns = {
        "timed_out": timed_out, "exit_code": exit_code,
        "stdout": F.coalesce(stdout, F.lit("")), "stderr": F.coalesce(stderr, F.lit("")),
    }

    def verdict(rules: list[tuple[str, str]], other: Column) -> Column:
        out = F.when(F.lit(False), other)
        for rule, name in rules:
            out = out.when(_holds(rule, columns), F.lit(name))
        return out.otherwise(other)

    # One test picks the few rules that apply to the row. Languages with equal
    # rules share a branch: the generated method stays small enough for the JIT.
    def by_language(table: dict[str, list[tuple[str, str]]], other: Column) -> Column:
        shared: dict[tuple, list[str]] = {}
        for name, rules in table.items():
            shared.setdefault(tuple(rules), []).append(name)
        out = F.when(F.lit(False), other)
        for rules, names in shared.items():
            out = out.when(language.isin(names), verdict(list(rules), other))
        return out.otherwise(other)

    # Most languages first ask for a timeout and a zero exit: asked once for all.
    usual = [("timeout", "Timeout"), ("exit_ok", "OK")]
    late = {n: r[len(usual):] for n, r in RUN_RULES.items() if r[:len(usual)] == usual}
    other = {n: r for n, r in RUN_RULES.items() if n not in late}
    failed, unset = F.lit("Exception"), F.lit(None).cast("string")
    run = F.when(language.isin(list(late)), F.coalesce(
        verdict(usual, unset), by_language({n: r for n, r in late.items() if r}, failed)
    )).otherwise(by_language(other, failed))
    return F.when(phase == "build", by_language(BUILD_RULES, unset)).otherwise(run)


def captured(text: Column, drop: str = "") -> Column:
    """Captured output: null becomes empty, a marker goes, 2,048 characters stay."""
    text = F.coalesce(text, F.lit(""))
    if drop:
        text = F.replace(text, F.lit(drop), F.lit(""))
    return F.left(text, F.lit(fixed.CAPTURE_CHARS))


def distinct_programs(rows: DataFrame, program: str, language: str) -> DataFrame:
    """Each program once per language, with the hash that finds it again."""
    key = F.md5(F.col(program).cast("binary"))
    return rows.select(language, program).distinct().withColumn("program_md5", key)


def share_results(
    rows: DataFrame, results: DataFrame, program: str, language: str,
    row_key: str, spread: int = 16,
) -> DataFrame:
    """Give every row the result of its program.

    ``results`` has one row per language and ``program_md5``. Rows are salted by
    their key, and a result is copied once for each salt that its rows have, so no
    program fills one task and a program that is used once has one copy.
    """
    on = [language, "program_md5"]
    salted = rows.withColumn("program_md5", F.md5(F.col(program).cast("binary"))).withColumn(
        "__salt", F.pmod(F.xxhash64(row_key), F.lit(spread)).cast("int"))
    copies = salted.select(*on, "__salt").distinct().join(results, on)
    return salted.join(copies, [*on, "__salt"], "left").drop("__salt")


def status_summary(rows: DataFrame, language: str, status_column: str) -> DataFrame:
    verdict = F.col(status_column)
    return rows.groupBy(language).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(verdict == "OK").alias("passed"),
        F.count_if(verdict == "SyntaxError").alias("syntax_errors"),
        F.bool_and(F.coalesce(verdict == "OK", F.lit(False))).alias("all_passed"),
    )


#: Numbers of a range whose neighbours are looked up together.
GAP_RANGE = 1_000_000


def gap_ranges(files: DataFrame, group: str, number: str, width: int = GAP_RANGE) -> DataFrame:
    """``(group, first, last)`` of each run of numbers from 0 to the largest that no row has.

    A number ends a gap where the one in front of it is not its neighbour. The
    one in front lies in the same range of ``width`` or is the largest of the
    last range that has any, so neither a group nor a gap is ever listed whole.
    Null and negative numbers play no part.
    """
    have = files.where(F.col(number) >= 0).select(
        F.col(group).alias("__group"), F.col(number).cast("long").alias("number")).distinct().withColumn(
        "range", F.floor(F.col("number") / width))
    ends = have.groupBy("__group", "range").agg(F.max("number").alias("ahead"))
    earlier = Window.partitionBy("__group").orderBy("range")
    before = ends.select(F.col("__group").alias("__of"), F.col("range").alias("__in"),
                         F.coalesce(F.lag("ahead").over(earlier), F.lit(-1)).alias("ahead"))
    inside = F.lag("number").over(Window.partitionBy("__group", "range").orderBy("number"))
    met = have.withColumn("inside", inside).join(
        before, F.col("__group").eqNullSafe(F.col("__of")) & (F.col("range") == F.col("__in")))
    front = F.coalesce("inside", "ahead")
    return met.where(F.col("number") > front + 1).select(
        F.col("__group").alias(group), (front + 1).alias("first"), (F.col("number") - 1).alias("last"))


def number_gaps(
    files: DataFrame, group: str, number: str, width: int = GAP_RANGE
) -> DataFrame:
    """Each number from 0 to the largest of its group that no row has."""
    step = 10_000
    cut = gap_ranges(files, group, number, width).withColumn(
        "low", F.explode(F.sequence("first", "last", F.lit(step).cast("long"))))
    return cut.select(group, F.explode(
        F.sequence("low", F.least(F.col("low") + (step - 1), F.col("last")))).alias(number))


def leaderboard(
    metrics: DataFrame, valid: Sequence[str] = tuple(fixed.LEADERBOARD_TASKS)
) -> DataFrame:
    """Valid tasks with their pass@1 per model, null when the metric is missing.

    ``metrics`` has ``model``, ``task`` and the JSON text ``body``.
    """
    kept = metrics.where(F.col("task").isin(list(valid)))
    score = F.from_json("body", "map<string,map<string,double>>")
    return kept.select(
        "model", "task",
        F.try_element_at(F.try_element_at(score, F.col("task")), F.lit("pass@1"))
        .alias("pass_at_1"),
    )


def skipped_metrics(
    metrics: DataFrame, valid: Sequence[str] = tuple(fixed.LEADERBOARD_TASKS)
) -> DataFrame:
    return metrics.where(~F.col("task").isin(list(valid))).groupBy("task").agg(
        F.count(F.lit(1)).alias("files")
    )


def nested_leaderboard(scores: DataFrame) -> DataFrame:
    """One JSON object per model; a model has at most one entry per valid task."""
    entry = F.struct("task", F.col("pass_at_1").alias("pass@1"))
    best = scores.groupBy("model", "task").agg(F.max("pass_at_1").alias("pass_at_1"))
    listed = best.groupBy("model").agg(F.array_sort(F.collect_list(entry)).alias("results"))
    return listed.select(
        "model",
        F.to_json(
            F.struct("results", F.struct("model").alias("meta")),
            {"ignoreNullFields": "false"},
        ).alias("body"),
    )


def wide_leaderboard(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").pivot("task", fixed.LEADERBOARD_TASKS).agg(
        F.max("pass_at_1")
    )
