"""Slices, task selection, data expectations and prompt-mode checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import text as t


def problem_slice(df: DataFrame, index: str, start: int = 0, count: int | None = None) -> DataFrame:
    """Problems ``[start, start+count)``; everything from ``start`` without a count."""
    kept = df.where(F.col(index) >= start)
    return kept if count is None else kept.where(F.col(index) < start + count)


def head(df: DataFrame, key: str, count: int = 1000) -> DataFrame:
    """The first rows by an explicit key; a table has no order of its own."""
    return df.orderBy(key).limit(count)


def first_samples(df: DataFrame, sample: str, count: int) -> DataFrame:
    return df.where(F.col(sample) < count)


def task_table(spark: SparkSession) -> DataFrame:
    """Every task with its family and stop strings; a fixed, small table."""
    rows = [(name, fixed.stops_for(name)) for name in fixed.task_names()]
    table = spark.createDataFrame(rows, "task string, stops array<string>")
    return table.withColumn("family", t.before(F.col("task"), "-"))


def select_tasks(tasks: DataFrame, patterns: str, column: str = "task") -> DataFrame:
    """Distinct tasks that match any comma-separated shell wildcard."""
    matched = None
    for pattern in patterns.split(","):
        rows = tasks.where(t.matches_glob(F.col(column), pattern))
        matched = rows if matched is None else matched.unionByName(rows)
    return matched.dropDuplicates([column])


def check_patterns(patterns: str, names: Sequence[str] | None = None) -> None:
    """Raise for a pattern that matches no task name."""
    from fnmatch import fnmatchcase

    names = fixed.task_names() if names is None else names
    for pattern in patterns.split(","):
        if not any(fnmatchcase(name, pattern) for name in names):
            raise ValueError(f"no task matches {pattern}")


def expect_rows(df: DataFrame, count: int) -> DataFrame:
    """One row with the row count, or an error when it is not ``count``."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    checked = F.when(F.col("rows") == count, F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {count} rows, found "), F.col("rows")))
    )
    return counted.select(checked.cast("long").alias("rows"))


def one_mode(df: DataFrame, mode: Column) -> DataFrame:
    """The prompt mode of all rows, or an error when modes are mixed."""
    modes = df.agg(F.count_distinct(mode).alias("modes"), F.min(mode).alias("mode"))
    checked = F.when(F.col("modes") == 1, F.col("mode")).otherwise(
        F.raise_error(F.lit("mixed completion, infill and instruction prompts"))
    )
    return modes.select(checked.cast("string").alias("mode"))


def in_library(column: Column, library: str, mode: str) -> Column:
    """Whether a row is in a library; ``All`` leaves out the one without an insertion form."""
    if library != "All":
        return column == library
    return column != "Matplotlib" if mode == "Insertion" else F.lit(True)


def library_subset(df: DataFrame, library: str, mode: str, column: str = "library") -> DataFrame:
    return df.where(in_library(F.col(column), library, mode))


def library_mode(library: str, mode: str) -> str:
    """The mode that is really used: one library has no insertion form."""
    return "Completion" if library == "Matplotlib" else mode


def first_seeds(df: DataFrame, seed: str, count: int) -> DataFrame:
    """Keep the perturbation seeds below ``count``."""
    return df.where(F.col(seed) < count)


def explode_descriptions(descriptions: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """Problems once per description; candidates are rows, never one list."""
    return descriptions.join(problems, key)
