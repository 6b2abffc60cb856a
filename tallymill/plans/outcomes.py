"""Outcome, summary, leaderboard and timing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.operators import outcomes as o
from tallymill.operators import timing
from tallymill.plans import sqlkit as k
from tallymill.plans.corpus import TASK_EVENTS_SQL, task_events
from tallymill.plans.registry import digest, query, table

ALIASES = [
    "rb", "lua", "py", "julia", "java", "rust", "swift", "rkt", "js", "cpp", "cs", "php",
    "d", "r", "ts", "go", "pl", "sh", "scala", "notypes.py",
]
MARKS = [
    "", "SyntaxError", "ERR_ASSERTION", "ReferenceError", "unexpected", "Unhandled Exception",
    "[build failed]", "FAIL", "PHP Parse error", "read-syntax", "ERROR", "Error: x",
    "syntax error", "!!int note",
]
_BUILT = "('java', 'rust', 'swift', 'cpp', 'cs', 'ts', 'scala')"
_ALIAS_LIST = "[" + ", ".join(k.q(x) for x in ALIASES) + "]"
_MARK_LIST = "[" + ", ".join(k.q(x) for x in MARKS) + "]"

RESULTS_SQL = f"""
SELECT *, CASE WHEN alias IN {_BUILT} AND user_id % 4 = 0 THEN 'build' ELSE 'run' END AS phase,
  CASE WHEN value > 100 THEN -1 WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS code,
  CASE WHEN (event_id // 20) % 2 = 0 THEN mark ELSE '' END AS err,
  CASE WHEN (event_id // 20) % 2 = 1 THEN mark WHEN event_id % 3 = 0 THEN NULL ELSE '' END AS out
FROM (SELECT event_id, user_id, event_type, value, {_ALIAS_LIST}[event_id % 20 + 1] AS alias,
        {_MARK_LIST}[user_id % 14 + 1] AS mark FROM events)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as process results of every evaluator."""
    even = F.floor(F.col("event_id") / 20) % 2 == 0
    built = F.col("alias").isin("java", "rust", "swift", "cpp", "cs", "ts", "scala")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.get(F.array(*map(F.lit, ALIASES)), (F.col("event_id") % 20).cast("int")).alias("alias"),
        F.get(F.array(*map(F.lit, MARKS)), (F.col("user_id") % 14).cast("int")).alias("mark"),
    ).select(
        "*",
        F.when(built & (F.col("user_id") % 4 == 0), "build").otherwise("run").alias("phase"),
        (F.col("value") > 100).alias("timed_out"),
        F.when(F.col("value") > 100, -1)
        .when(F.col("event_type").isin("error", "click"), 1).otherwise(0).alias("exit_code"),
        F.when(even, F.col("mark")).otherwise("").alias("stderr"),
        F.when(~even, F.col("mark")).when(F.col("event_id") % 3 != 0, F.lit("")).alias("stdout"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("evaluator", o.evaluator(F.col("alias")))
    return rows.withColumn("status", o.status(
        F.col("evaluator"), F.col("phase"), F.col("timed_out"), F.col("exit_code"),
        F.col("stdout"), F.col("stderr"),
    ))


# The status rules once more, written out by hand from the evaluator table.
_NAME = """CASE alias WHEN 'rb' THEN 'ruby' WHEN 'py' THEN 'python' WHEN 'notypes.py' THEN 'python'
  WHEN 'rkt' THEN 'racket' WHEN 'js' THEN 'javascript' ELSE alias END"""
STATUS_SQL = f"""
SELECT event_id, lang AS evaluator, CASE
  WHEN phase = 'build' AND lang IN ('swift', 'rust') AND value > 100 THEN 'Timeout'
  WHEN phase = 'build' AND code <> 0 THEN 'SyntaxError'
  WHEN phase = 'build' THEN NULL
  WHEN lang NOT IN ('php', 'racket') AND value > 100 THEN 'Timeout'
  WHEN lang = 'php' THEN CASE WHEN contains(o, 'PHP Parse error') THEN 'SyntaxError'
    WHEN code <> 0 THEN 'Exception' ELSE 'OK' END
  WHEN lang = 'racket' THEN CASE WHEN err = '' AND code = 0 THEN 'OK'
    WHEN contains(err, 'read-syntax') THEN 'SyntaxError' ELSE 'Exception' END
  WHEN lang = 'go' THEN CASE WHEN contains(o, '[setup failed]') OR contains(o, '[build failed]') THEN 'SyntaxError'
    WHEN contains(o, 'FAIL') THEN 'Exception' ELSE 'OK' END
  WHEN lang = 'cs' THEN CASE WHEN contains(err, 'Unhandled Exception') THEN 'Exception' ELSE 'OK' END
  WHEN lang = 'pl' THEN CASE WHEN code <> 0 OR contains(o, 'ERROR') OR contains(err, 'ERROR') THEN 'Exception' ELSE 'OK' END
  WHEN lang = 'scala' THEN CASE WHEN code = 0 AND err = '' THEN 'OK' ELSE 'Exception' END
  WHEN code = 0 THEN 'OK'
  WHEN lang = 'python' AND contains(err, 'SyntaxError') THEN 'SyntaxError'
  WHEN lang IN ('javascript', 'ts') THEN CASE
    WHEN contains(err || CASE lang WHEN 'ts' THEN '' ELSE o END, 'ERR_ASSERTION') THEN 'AssertionError'
    WHEN contains(err || CASE lang WHEN 'ts' THEN '' ELSE o END, 'SyntaxError') THEN 'SyntaxError'
    WHEN contains(err || CASE lang WHEN 'ts' THEN '' ELSE o END, 'ReferenceError') THEN 'ReferenceError'
    ELSE 'Exception' END
  WHEN lang = 'r' THEN CASE WHEN contains(err || o, 'unexpected') THEN 'SyntaxError'
    WHEN err = '' THEN 'AssertionError' ELSE 'Exception' END
  WHEN lang = 'd' AND contains(err, 'Error:') THEN 'SyntaxError'
  WHEN lang = 'sh' AND contains(err, 'syntax error') THEN 'SyntaxError'
  WHEN lang IN ('julia', 'ruby') AND err <> '' THEN 'SyntaxError'
  ELSE 'Exception' END AS status
FROM (SELECT *, {_NAME} AS lang, coalesce(out, '') AS o FROM ({RESULTS_SQL}))"""


@query(STATUS_SQL)
def status_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("event_id", "evaluator", "status")


@query(f"""
SELECT evaluator, count(*) AS total, count(*) FILTER (status = 'OK') AS passed,
  count(*) FILTER (status = 'SyntaxError') AS syntax_errors,
  count(*) FILTER (status = 'OK') = count(*) AS all_passed
FROM ({STATUS_SQL}) GROUP BY evaluator""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.status_summary(classified(spark, sf_dir), "evaluator", "status")


@query(f"""
SELECT event_id, md5(substr(replace(coalesce(repeat(out || ' ', 300), ''), '!!int', ''), 1, 2048)) AS out_md5,
  md5(substr(coalesce(repeat(err || ' ', 300), ''), 1, 2048)) AS err_md5 FROM ({RESULTS_SQL})""")
def result_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_out = F.repeat(F.concat("stdout", F.lit(" ")), F.lit(300))
    long_err = F.repeat(F.concat("stderr", F.lit(" ")), F.lit(300))
    return results(spark, sf_dir).select(
        "event_id", digest(o.captured(long_out, "!!int")).alias("out_md5"),
        digest(o.captured(long_err)).alias("err_md5"),
    )


@query("""
SELECT event_id, event_type AS language, md5(program) AS program_md5,
  CASE WHEN substr(md5(program), 1, 1) < '8' THEN 'OK' ELSE 'Exception' END AS status
FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'program ' || user_id END AS program FROM events)""")
def dedup_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all rows share one program; its one result is salted back."""
    program = F.when(F.col("user_id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("program "), F.col("user_id").cast("string"))
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("language"), program.alias("program")
    )
    once = o.distinct_programs(rows, "program", "language")
    run = once.select("language", "program_md5", F.when(
        F.substring("program_md5", 1, 1) < "8", "OK"
    ).otherwise("Exception").alias("status"))
    shared = o.share_results(rows, run, "program", "language", "event_id")
    return shared.select("event_id", "language", "program_md5", "status")


@query("""
WITH f AS (SELECT DISTINCT lang, doc_id AS number FROM documents),
r AS (SELECT lang, unnest(range(max(number) + 1)) AS number FROM f GROUP BY lang)
SELECT lang, number FROM r ANTI JOIN f USING (lang, number)""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers parsed from file names; numbers without a file stay gaps."""
    name = F.concat(F.lit("HumanEval_"), F.col("doc_id").cast("string"), F.lit("_x.py"))
    files = table(spark, sf_dir, "documents").select(
        "lang", F.get(F.split(name, "_"), F.lit(1)).cast("long").alias("number")
    )
    return o.number_gaps(files, "lang", "number", width=100)


_RUNS_SQL = f"""
SELECT 'model' || (user_id % 5) AS model, task, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 4) AS score
FROM ({TASK_EVENTS_SQL}) GROUP BY ALL"""


def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric file per model and task, some without a pass@1."""
    model = F.concat(F.lit("model"), (F.col("user_id") % 5).cast("string"))
    passed = F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)
    scores = task_events(spark, sf_dir).groupBy(model.alias("model"), "task").agg(
        F.round(F.avg(passed), 4).alias("score")
    )
    metric = F.when(F.col("model") == "model4", F.lit("pass@10")).otherwise(F.lit("pass@1"))
    body = F.to_json(F.create_map("task", F.create_map(metric, F.col("score"))))
    return scores.select("model", "task", body.alias("body"))


_VALID = "(" + ", ".join(k.q(x) for x in fixed.LEADERBOARD_TASKS) + ")"


@query(f"""
SELECT model, task, CASE WHEN model = 'model4' THEN NULL ELSE score END AS pass_at_1
FROM ({_RUNS_SQL}) WHERE task IN {_VALID}""")
def leaderboard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.leaderboard(metric_files(spark, sf_dir))


@query(f"SELECT task, count(*) AS files FROM ({_RUNS_SQL}) WHERE task NOT IN {_VALID} GROUP BY task")
def leaderboard_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.skipped_metrics(metric_files(spark, sf_dir))


@query(
    "SELECT model, " + ", ".join(
        f"max(CASE WHEN model <> 'model4' THEN score END) FILTER (task = {k.q(task)}) "
        f"AS \"{task}\"" for task in fixed.LEADERBOARD_TASKS
    ) + f" FROM ({_RUNS_SQL}) WHERE task IN {_VALID} GROUP BY model"
)
def leaderboard_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.wide_leaderboard(o.leaderboard(metric_files(spark, sf_dir)))


@query(f"""
SELECT model, count(*) AS tasks, count(score) FILTER (model <> 'model4') AS scored
FROM ({_RUNS_SQL}) WHERE task IN {_VALID} GROUP BY model""")
def leaderboard_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form per model, read back from its JSON."""
    nested = o.nested_leaderboard(o.leaderboard(metric_files(spark, sf_dir)))
    entries = F.from_json("body", "results array<struct<task string, `pass@1` double>>")["results"]
    return nested.select(
        "model", F.size(entries).cast("long").alias("tasks"),
        F.size(F.filter(entries, lambda e: e["pass@1"].isNotNull())).cast("long").alias("scored"),
    )


@query("""
SELECT event_type AS stage, round(sum(value), 4) AS seconds, CAST(sum(user_id) AS BIGINT) AS tokens
FROM events GROUP BY event_type""")
def timing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("seconds"),
        F.col("user_id").alias("tokens"),
    )
    return timing.totals(rows, ["seconds", "tokens"], ["stage"]).withColumn(
        "seconds", F.round("seconds", 4)
    )


@query("SELECT round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def timing_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.percentile(table(spark, sf_dir, "events"), "value").withColumn(
        "p95", F.round("p95", 6)
    )


@query("""
SELECT scope, count(*) AS rows, round(avg(size), 6) AS size, round(avg(value), 6) AS value,
  round(avg(user_id), 6) AS user_id
FROM (SELECT *, value * 20 AS size, CASE WHEN value * 20 < 100 THEN 0 WHEN value * 20 < 500 THEN 1
  WHEN value * 20 < 2000 THEN 2 WHEN value * 20 < 5000 THEN 3 ELSE 4 END AS scope FROM events)
GROUP BY scope""")
def timing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("size", F.col("value") * 20)
    columns = ["size", "value", "user_id"]
    means = timing.bucket_means(rows, "size", columns)
    return means.select("scope", "rows", *[F.round(c, 6).alias(c) for c in columns])


@query("""
WITH d AS (SELECT CAST(floor(value) AS BIGINT) AS target, count(*) AS own FROM events GROUP BY target)
SELECT a.target, a.own, CAST(sum(b.own) AS BIGINT) AS near FROM d a
JOIN d b ON b.target >= a.target - 10 AND b.target < a.target + 10 GROUP BY a.target, a.own""")
def neighbour_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor("value").cast("long").alias("size"))
    return timing.neighbour_sum(rows, "size", F.lit(1))
