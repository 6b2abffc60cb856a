"""Layouts on disk: benchmarks, corpora, generations, results, metrics, CSVs.

Nested JSON files are one array each and may be of any size: they are read by
byte ranges, cut at quotes, and the place of every text is worked out from what
stands in front. Long tables partitioned by task and model are the canonical
form; the nested files are for exchange. A result file of a run is replaced as a
whole when the run is written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.operators.staging import staged

TIMING_SCHEMA = (
    "char_len int, token_num int, token_time double, parse_time double, "
    "parse_back_time double, hug_token_time double, hug_token_num int, "
    "hug_decode_time double, decode_time double"
)
TOKEN_REPORT_SCHEMA = (
    "model string, code_tokens long, filtered_code_tokens long, "
    "parsed_tokens long, ratio double"
)
STATUS_SCHEMA = "language string, stem string, status string"
RESULTS_SCHEMA = (
    "name string, language string, prompt string, tests string, run_id string, "
    "results array<struct<status string, exit_code int, stdout string, "
    "stderr string, program string, timestamp long>>"
)


def read_benchmark(
    spark: SparkSession, path: str, split: str | None = None, config: str | None = None
) -> DataFrame:
    """A benchmark table; split and config are partition or plain columns."""
    df = spark.read.parquet(path)
    if config is not None:
        df = df.where(F.col("config") == config)
    return df if split is None else df.where(F.col("split") == split)


def read_corpus(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if lang is None else df.where(F.col("lang") == lang)


def save_corpus(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def nested_texts(segments: DataFrame) -> DataFrame:
    """``(file, problem_idx, sample_idx, text)`` of JSON arrays of arrays of texts.

    ``segments`` holds what stands between quotes: ``file``, the start ``block``
    of the byte range, an ascending ``place`` in it, and ``value``. Quotes and
    brackets are counted inside each range and shifted by the ranges in front,
    so no task reads a whole file. A quote behind an odd run of backslashes
    belongs to its text. Other values than texts count as samples but give no
    row.
    """
    inside = Window.partitionBy("file", "block").orderBy("place")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    front = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def running(df: DataFrame, value: str, into: str, with_own: bool) -> DataFrame:
        """The sum of ``value`` over all segments of the file in front."""
        blocks = df.groupBy("file", "block").agg(F.sum(value).alias("__sum")).select(
            "file", "block", F.coalesce(F.sum("__sum").over(front), F.lit(0)).alias("__ahead"))
        own = F.coalesce(F.sum(value).over(upto), F.lit(0)) + (F.col(value) if with_own else F.lit(0))
        return df.withColumn(into, own).join(blocks, ["file", "block"]).withColumn(
            into, F.col(into) + F.col("__ahead")).drop("__ahead")

    escaped = F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2
    quoted = running(segments.withColumn("ends", 1 - escaped), "ends", "quotes", False)
    between = F.col("quotes") % 2 == 0
    count = lambda x, sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    opened = running(quoted.withColumn("opens", F.when(between, count("value", "[")).otherwise(0)), "opens", "lists", True)
    last = F.substring_index("value", "[", -1)
    texts = opened.groupBy("file", F.floor(F.col("quotes") / 2).alias("text_no")).agg(
        F.max(F.when(between, F.col("lists"))).alias("list_no"),
        F.max(F.when(between, count(last, ","))).alias("commas"),
        F.array_sort(F.collect_list(F.when(~between, F.struct("block", "place", "value")))).alias("parts"),
    ).where(F.size("parts") > 0)
    before = Window.partitionBy("file", "list_no").orderBy("text_no")
    literal = F.concat(F.lit('["'), F.array_join("parts.value", '"'), F.lit('"]'))
    return texts.select(
        "file", (F.col("list_no") - 2).cast("long").alias("problem_idx"),
        F.sum("commas").over(before).cast("int").alias("sample_idx"),
        F.from_json(literal, "array<string>")[0].alias("text"),
    )


def _nested(spark: SparkSession, path: str) -> DataFrame:
    cut = spark.read.option("lineSep", '"').text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    # Written, since the places depend on how the scan is split.
    return nested_texts(staged(cut, "segments"))


def read_generations(
    spark: SparkSession, root: str, n_tasks: int | None = None, limit_start: int = 0
) -> DataFrame:
    """Nested ``root/task/model/generations.json`` files as a long table.

    ``limit_start`` and ``n_tasks`` keep a slice of the problems.
    """
    part = lambda n: F.element_at(F.split("file", "/"), n)
    df = _nested(spark, f"{root}/*/*/generations.json").select(
        part(-3).alias("task"), part(-2).alias("model"), "problem_idx", "sample_idx", "text")
    kept = df.where(F.col("problem_idx") >= limit_start)
    return kept if n_tasks is None else kept.where(F.col("problem_idx") < limit_start + n_tasks)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Description candidates of an earlier run: one row per candidate."""
    return _nested(spark, path).select(
        "problem_idx", F.col("sample_idx").alias("candidate"), F.col("text").alias("description")
    )


def save_generations(df: DataFrame, path: str) -> None:
    """Canonical form: long rows in task and model partitions."""
    df.write.mode("overwrite").partitionBy("task", "model").parquet(path)


def export_generations(df: DataFrame, path: str) -> None:
    """JSON lines, one problem and its texts a line, in task and model partitions.

    Lines are sorted by problem inside each file; runs of any size are spread
    over files, and no value holds more than one problem.
    """
    samples = F.transform(
        F.array_sort(F.collect_list(F.struct("sample_idx", "text"))), lambda s: s["text"]
    )
    per_problem = df.groupBy("task", "model", "problem_idx").agg(samples.alias("texts"))
    line = F.to_json(F.struct("problem_idx", "texts")).alias("value")
    per_problem.sortWithinPartitions("task", "model", "problem_idx").select(
        "task", "model", line
    ).write.mode("overwrite").partitionBy("task", "model").text(path)


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """Long rows from ``export_generations`` output."""
    lines = spark.read.text(path).select(
        "task", "model", F.from_json("value", "problem_idx long, texts array<string>").alias("p")
    )
    return lines.select(
        "task", "model", "p.problem_idx", F.posexplode("p.texts").alias("sample_idx", "text")
    )


def save_metrics(scores: DataFrame, path: str, config: dict[str, str] | None = None) -> None:
    """Metric rows ``(task, metric, value)`` as one JSON object per task.

    The metrics of a task are a handful of names, so the map stays small.
    """
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    rows = scores.groupBy("task").agg(pairs.alias("metrics"))
    settings = F.create_map(*[F.lit(x) for pair in (config or {}).items() for x in pair])
    out = rows.withColumn("config", settings) if config else rows
    out.write.mode("overwrite").json(path)


def read_metric_files(spark: SparkSession, pattern: str, model: str) -> DataFrame:
    """Per-run metric files; the task is the second part of the file name."""
    files = spark.read.text(pattern, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return files.select(
        F.lit(model).alias("model"), F.get(F.split(stem, "_"), F.lit(1)).alias("task"),
        F.col("value").alias("body"),
    )


def _write_run(df: DataFrame, path: str, kind: str, run_id: str | None) -> None:
    """Append rows, or put them in place of all that an earlier try of the run has written.

    A run is a partition of its own. Files of a try that fails are not in it, so
    half a run followed by a whole one leaves one copy.
    """
    if run_id is None:
        df.write.mode("append").format(kind).save(path)
        return
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").format(kind).save(path)


def append_token_report(report: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add rows to the report; those of a named run replace the run's earlier rows."""
    columns = ("model", "code_tokens", "filtered_code_tokens", "parsed_tokens", "ratio")
    _write_run(report.select(*columns), path, "csv", run_id)


def read_token_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_REPORT_SCHEMA).csv(path)


def append_results(results: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add completions or outcomes as JSON lines; see ``append_token_report``."""
    _write_run(results, path, "json", run_id)


def append_statuses(df: DataFrame, path: str, run_id: str | None = None) -> None:
    _write_run(df.select("language", "stem", "status"), path, "csv", run_id)


def save_timings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMING_SCHEMA).option("header", True).csv(path)


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """Few-shot examples; a JSON object spread over lines is one row."""
    return spark.read.json(path, multiLine=True)


def read_results(spark: SparkSession, pattern: str, run_id: str | None = None) -> DataFrame:
    """One row per sample from per-problem result files of one run."""
    df = spark.read.schema(RESULTS_SCHEMA).json(pattern, multiLine=True)
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    rows = df.select("run_id", "name", "language", F.posexplode("results")
                     .alias("sample_idx", "r"))
    return rows.select("run_id", "name", "language", "sample_idx", "r.*")


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with list columns ``raw_generation`` and ``generation``."""
    return spark.read.json(path)


def save_completions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_statuses(df: DataFrame, path: str) -> None:
    df.select("language", "stem", "status").write.mode("overwrite").csv(path)


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS_SCHEMA).csv(path)
