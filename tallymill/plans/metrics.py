"""Score queries: pass rates, votes, matches and BLEU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import scoring, tasks
from tallymill.functions import completions as c
from tallymill.functions import tokens as tok
from tallymill.operators import bleu, metrics, selection
from tallymill.operators.numbering import number_rows
from tallymill.plans import sqlkit as k
from tallymill.plans.registry import ORACLES, digest, query, spread, table

#: Events as outcomes: the user is the problem, the event the sample.
OUTCOMES_SQL = """
SELECT event_id, user_id, event_type, value, CAST(event_id % 3 AS INTEGER) AS run,
  CASE WHEN event_type = 'error' THEN 'Exception' ELSE 'OK' END AS status,
  CASE WHEN value > 150 THEN 1 ELSE 0 END AS exit_code FROM events"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        (F.col("event_id") % 3).cast("int").alias("run"),
        F.when(F.col("event_type") == "error", "Exception").otherwise("OK").alias("status"),
        F.when(F.col("value") > 150, 1).otherwise(0).alias("exit_code"),
    )


def pass_sql(source: str, by: str, passed: str, ks: tuple[int, ...]) -> str:
    """The estimate in its published form, one factor per correct sample."""
    values = ", ".join(f"({k_})" for k_ in ks)
    return f"""
SELECT {by}, 'pass@' || k AS metric, count(*) AS problems, avg(
  CASE WHEN n - c < k THEN 1.0 ELSE 1 - coalesce(list_aggregate(
    list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i), 'product'), 1) END) AS score
FROM (SELECT {by}, user_id, count(*) AS n, count(*) FILTER ({passed}) AS c
      FROM ({source}) GROUP BY ALL), (VALUES {values}) v(k)
GROUP BY {by}, k HAVING k <= min(n)"""


@query(f"""
SELECT run, metric, problems, round(score, 9) AS score FROM (
  {pass_sql(OUTCOMES_SQL, 'run', "status = 'OK' AND exit_code = 0", (1, 5, 10, 100))})""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = metrics.is_pass(F.col("status"), F.col("exit_code"))
    scores = metrics.pass_at_k(
        outcomes(spark, sf_dir), ["user_id"], passed, by=["run"], ks=(1, 5, 10, 100)
    )
    return scores.withColumn("score", F.round("score", 9))


@query("""
WITH h AS (SELECT conv_id, turn, substr(text, 1, length(text) // (1 + turn % 3)) AS gen FROM conversations),
r AS (SELECT conv_id, gen, CASE WHEN turn % 2 = 0 THEN gen ELSE upper(gen) END AS ref FROM h),
p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (gen = ref) AS hits FROM r GROUP BY conv_id)
SELECT count(*) AS problems, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / sum(n), 9) AS score,
  min(n) = max(n) AS equal_samples FROM p""")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    # References of varied length: the whole text, its first half or its first third.
    head = F.left("text", F.floor(F.length("text") / (1 + F.col("turn") % 3)).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "text", F.when(F.col("turn") % 2 == 0, head).otherwise(F.upper(head)).alias("ref")
    )
    generated = c.cut_to_reference(F.col("text"), F.col("ref"))
    return metrics.exact_match(rows, "conv_id", generated, F.col("ref")).withColumn(
        "score", F.round("score", 9)
    )


@query("""
WITH f AS (SELECT lang || source AS ref, min_by(n_chars, doc_id) AS n_chars, min(doc_id) AS doc_id
           FROM documents GROUP BY ref),
g AS (SELECT event_id, (['de', 'en', 'es', 'fr', 'xx'])[event_id % 5 + 1] || 'src' || (user_id % 20) AS ref FROM events)
SELECT count(*) AS samples, count(f.ref) AS found,
  round(avg(CASE WHEN (event_id + n_chars) % 2 = 0 THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM g LEFT JOIN f USING (ref)""")
def mean_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test of a reference is the first row with an equal reference text."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat("lang", "source").alias("ref"), "doc_id", "n_chars"
    )
    first = metrics.first_by_text(docs, "ref", "doc_id", ["n_chars"])
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "xx")])
    samples = table(spark, sf_dir, "events").select("event_id", F.concat(
        F.get(langs, (F.col("event_id") % 5).cast("int")), F.lit("src"),
        (F.col("user_id") % 20).cast("string"),
    ).alias("ref"))
    joined = samples.join(first, "ref", "left")
    correct = (F.col("event_id") + F.col("n_chars")) % 2 == 0
    return joined.agg(
        F.count(F.lit(1)).alias("samples"), F.count("n_chars").alias("found"),
        F.round(F.avg(F.when(correct, 1.0).otherwise(0.0)), 9).alias("accuracy"),
    )


@query("""
SELECT event_type, count(*) AS samples,
  round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 9) AS score FROM events GROUP BY event_type""")
def group_pass_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.group_pass(
        table(spark, sf_dir, "events"), ["event_type"], F.col("value") < 50
    )
    return scores.withColumn("score", F.round("score", 9))


@query(f"""
WITH s AS ({pass_sql('SELECT * FROM events', 'event_type', 'value < 60', (1, 2))}),
a AS (SELECT metric, avg(score) AS score, count(*) AS g FROM s GROUP BY metric)
SELECT event_type AS name, metric, round(score, 9) AS score FROM s
UNION ALL SELECT 'all', metric, round(score, 9) FROM a
UNION ALL SELECT 'num_correct', metric, round(score * g, 9) FROM a WHERE metric = 'pass@1'""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.pass_at_k(
        table(spark, sf_dir, "events"), ["user_id"], F.col("value") < 60,
        by=["event_type"], ks=(1, 2),
    ).withColumnRenamed("event_type", "name")
    return metrics.macro_average(scores, "name", "metric", "score").withColumn(
        "score", F.round("score", 9)
    )


ROBUST_SQL = """
SELECT event_type, user_id, event_id % 5 AS seed, value < 60 AS passed,
  row_number() OVER (PARTITION BY event_type, user_id, event_id % 5 ORDER BY event_id) - 1 AS sample
FROM events WHERE event_id % 5 < 3"""


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of prompts perturbed by five seeds, of which three are asked for."""
    rows = table(spark, sf_dir, "events").select(
        "event_type", "user_id", "event_id", (F.col("event_id") % 5).alias("seed"),
        (F.col("value") < 60).alias("passed"),
    )
    return selection.first_seeds(rows, "seed", 3)


@query(f"""
WITH o AS ({ROBUST_SQL}),
s AS (SELECT event_type, user_id, count(*) AS seeds, min(n) <> max(n) AS uneven, min(n) AS shortest
      FROM (SELECT event_type, user_id, seed, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL),
i AS (SELECT event_type, user_id, sample, bool_and(passed) AS ok FROM o GROUP BY ALL),
p AS (SELECT s.event_type, s.user_id, any_value(uneven) AS uneven,
        count(*) FILTER (ok AND sample < shortest) / any_value(shortest) AS score
      FROM i JOIN s USING (event_type, user_id) GROUP BY ALL)
SELECT event_type, count(*) AS problems, count(*) FILTER (uneven) AS uneven, round(avg(score), 9) AS score
FROM p GROUP BY event_type""")
def robust_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_rows(
        perturbed(spark, sf_dir), "event_id", into="sample",
        groups=["event_type", "user_id", "seed"],
    )
    scores = metrics.robust_pass(
        rows, variant="event_type", problem="user_id", seed="seed", sample="sample",
        passed=F.col("passed"),
    )
    return scores.withColumn("score", F.round("score", 9))


@query(f"""
SELECT event_type, count(*) AS problems, round(avg(rate), 9) AS score FROM (
  SELECT event_type, user_id, product(rate) AS rate FROM (
    SELECT event_type, user_id, seed, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS rate
    FROM ({ROBUST_SQL}) GROUP BY ALL) GROUP BY ALL) GROUP BY event_type""")
def alt_robust_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.alt_robust_pass(
        perturbed(spark, sf_dir), variant="event_type", problem="user_id", seed="seed",
        passed=F.col("passed"),
    )
    return scores.withColumn("score", F.round("score", 9))


ANSWERS_SQL = """
SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed: x' WHEN 'signup' THEN NULL
  ELSE CASE WHEN user_id % 7 = 0 THEN 'none' ELSE CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END END AS result
FROM events"""
TARGETS_SQL = "SELECT DISTINCT user_id, user_id % 5 AS target FROM events"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor(F.col("value") / 10).cast("long").cast("string")
    usable = F.when(F.col("user_id") % 7 == 0, F.lit("none")).otherwise(number)
    result = F.when(F.col("event_type") == "error", F.lit("failed: x")).when(
        F.col("event_type") != "signup", usable
    )
    return table(spark, sf_dir, "events").select("user_id", "event_id", result.alias("result"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.withColumn("target", F.col("user_id") % 5)


def _accuracy_sql(chosen: str) -> str:
    return f"""
WITH a AS ({ANSWERS_SQL}), u AS (SELECT * FROM a WHERE result IS NOT NULL AND NOT starts_with(result, 'failed:')),
chosen AS ({chosen}), t AS ({TARGETS_SQL}),
v AS (SELECT t.user_id, target, TRY_CAST(coalesce(result, '') AS DOUBLE) AS x FROM t LEFT JOIN chosen USING (user_id))
SELECT count(*) AS tasks, round(avg(CASE WHEN abs(x - target) < 1e-3 THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
  count(*) FILTER (x IS NULL) AS num_failed_execution FROM v"""


@query(_accuracy_sql("""
  SELECT user_id, result FROM (SELECT user_id, result, row_number() OVER (
    PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS place FROM u GROUP BY user_id, result)
  WHERE place = 1"""))
def vote_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = metrics.voted_answers(answers(spark, sf_dir), "user_id", "event_id", "result")
    scored = metrics.answer_accuracy(chosen, targets(spark, sf_dir), "user_id", "result", "target")
    return scored.withColumn("accuracy", F.round("accuracy", 9))


@query(_accuracy_sql("SELECT user_id, min_by(result, event_id) AS result FROM u GROUP BY user_id"))
def first_answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = metrics.first_answers(answers(spark, sf_dir), "user_id", "event_id", "result")
    scored = metrics.answer_accuracy(chosen, targets(spark, sf_dir), "user_id", "result", "target")
    return scored.withColumn("accuracy", F.round("accuracy", 9))


@query("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS completion_id, event_id
FROM events""")
def answers_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in completion order as numbered rows; no list per task."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    numbered = number_rows(rows, "event_id", into="place", groups=["user_id"])
    return numbered.select(
        "user_id", (F.col("place") - 1).alias("completion_id"), "event_id"
    )


@query("""
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted, label,
  list_position(embedding, list_max(embedding)) - 1 = label AS correct FROM embeddings""")
def argmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = metrics.argmax(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", predicted.alias("predicted"), "label", (predicted == F.col("label")).alias("correct")
    )


@query("""
SELECT count(*) AS rows, round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label
  THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM embeddings""")
def argmax_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    scored = metrics.accuracy(rows, metrics.argmax(F.col("embedding")), F.col("label"))
    return scored.withColumn("accuracy", F.round("accuracy", 9))


@query("""
SELECT role, count(*) AS rows, round(avg(CASE WHEN contains(text, chr(10)) THEN 0.0 ELSE 1.0 END), 9) AS error_rate
FROM conversations GROUP BY role""")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = ~F.contains(F.col("text"), F.lit("\n"))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(failed.cast("int").cast("double")), 9).alias("error_rate"),
    )


@query("""
SELECT coalesce(c.conv_id, b.item_id) AS problem_idx, coalesce(samples, 0) AS samples, md5(b.text) AS ref_md5,
  CASE WHEN b.item_id IS NULL THEN 'completions' WHEN c.conv_id IS NULL THEN 'references' ELSE 'both' END AS side
FROM (SELECT conv_id, count(*) AS samples FROM conversations GROUP BY conv_id) c
FULL JOIN benchmark b ON b.item_id = c.conv_id""")
def join_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions meet references by id; problems on one side only are listed."""
    done = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("problem_idx"))
    refs = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("problem_idx"), digest(F.col("text")).alias("ref_md5")
    )
    return metrics.reference_counts(done, refs, ["problem_idx"])


@query("SELECT item_id FROM benchmark WHERE item_id IN (SELECT conv_id FROM conversations)")
def semi_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only references of predicted ids."""
    predicted = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(predicted, "item_id", "left_semi")


_GRAMS = ", ".join(
    f"list_transform(range(1, len(w) - {n - 2}), lambda i: "
    f"{{'n': {n}, 'g': array_to_string(list_slice(w, i, i + {n - 1}), ' ')}})"
    for n in range(1, 5)
)


def grams_sql(w: str = "w") -> str:
    return f"unnest(flatten([{_GRAMS}]))".replace("(w)", f"({w})").replace("(w,", f"({w},")


@query(f"""
SELECT item_id, CAST(u.n AS INTEGER) AS n, md5(u.g) AS ngram_md5, count(*) AS uses
FROM (SELECT item_id, {grams_sql()} AS u FROM (SELECT item_id, {k.words('lower(text)')} AS w FROM benchmark))
GROUP BY ALL""")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    counts = bleu.ngram_counts(rows, ["item_id"], tok.words(F.lower("text")))
    return counts.select(
        "item_id", F.col("order").alias("n"), digest(F.col("ngram")).alias("ngram_md5"), "uses"
    )


# The published normalisation patterns, as in operators/bleu.py.
def normalised_sql(x: str) -> str:
    x = f"array_to_string({k.words(f'lower({k.strip(k.before(x, chr(9)))})')}, ' ')"
    for rule, new in [("<skipped>", ""), ("-\\n", ""), ("\\n", " ")]:
        x = f"regexp_replace({x}, {k.q(rule)}, {k.q(new)}, 'g')"
    for entity, mark in [("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        x = f"replace({x}, {k.q(entity)}, {k.q(mark)})"
    x = f"lower(' ' || {x} || ' ')"
    for rule, new in [
        (r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ]:
        x = f"regexp_replace({x}, {k.q(rule)}, {k.q(new)}, 'g')"
    return f"list_filter(regexp_split_to_array({x}, '[{k.SPACE_CLASS}]+'), lambda z: z <> '')"


PAIR = ["conv_id", "turn"]
PAIRS_SQL = f"""
SELECT u.conv_id, u.turn, {normalised_sql('a.text')} AS c, {normalised_sql('u.text')} AS r
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn as the reference of the assistant turn behind it.

    The join key is turn and conversation together, so a conversation with very
    many turns is spread over the tasks.
    """
    turns = spread(table(spark, sf_dir, "conversations"))
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ref"))
    given = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cand")
    )
    return asked.join(given, PAIR).select(*PAIR, *[
        bleu.normalise(bleu.prepare(F.col(name))).alias(into)
        for name, into in (("cand", "candidate"), ("ref", "reference"))
    ])


def _score_sql(columns: str) -> str:
    tiny = "2.2250738585072014e-308"
    parts = " + ".join(
        f"ln(coalesce(m{n}, 0) + {int(n > 1)} + {tiny}) "
        f"- ln(greatest(len_c - {n - 1}, 0) + {int(n > 1)} + {tiny})" for n in range(1, 5)
    )
    return f"exp(({parts}) / 4 + least(0, 1 - (len_r + 1) / (len_c + 1)))"


_MATCHES = ", ".join(f"sum(least(a, b)) FILTER (n = {n}) AS m{n}" for n in range(1, 5))
SENTENCES_SQL = f"""
WITH p AS MATERIALIZED ({PAIRS_SQL}),
cc AS (SELECT conv_id, turn, u.n AS n, u.g AS g, count(*) AS a FROM (SELECT conv_id, turn, {grams_sql('c')} AS u FROM p) GROUP BY ALL),
rr AS (SELECT conv_id, turn, u.n AS n, u.g AS g, count(*) AS b FROM (SELECT conv_id, turn, {grams_sql('r')} AS u FROM p) GROUP BY ALL),
m AS (SELECT conv_id, turn, {_MATCHES} FROM cc JOIN rr USING (conv_id, turn, n, g) GROUP BY conv_id, turn),
s AS (SELECT conv_id, turn, len(c) AS len_c, len(r) AS len_r, m1, m2, m3, m4 FROM p LEFT JOIN m USING (conv_id, turn))
"""


@query(SENTENCES_SQL + f"SELECT conv_id, turn, round({_score_sql('')}, 9) AS bleu FROM s")
def bleu_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = bleu.sentence_bleu(answer_pairs(spark, sf_dir), PAIR)
    return scores.withColumn("bleu", F.round("bleu", 9))


@query(SENTENCES_SQL + f"SELECT count(*) AS pairs, round(avg({_score_sql('')}) * 100, 8) AS bleu FROM s")
def bleu_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = bleu.sentence_bleu(answer_pairs(spark, sf_dir), PAIR)
    return bleu.mean_bleu(scores).withColumn("bleu", F.round("bleu", 8))


@query(SENTENCES_SQL + """
SELECT CAST(c AS BIGINT) AS length, CAST(r AS BIGINT) AS reference_length, round(
  exp((ln((m1 + 1) / (g1 + 1)) + ln((m2 + 1) / (g2 + 1)) + ln((m3 + 1) / (g3 + 1)) + ln((m4 + 1) / (g4 + 1))) / 4)
  * CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END, 9) AS bleu
FROM (SELECT sum(len_c) AS c, sum(len_r) AS r, sum(m1) AS m1, sum(m2) AS m2, sum(m3) AS m3, sum(m4) AS m4,
  sum(len_c) AS g1, sum(greatest(len_c - 1, 0)) AS g2, sum(greatest(len_c - 2, 0)) AS g3,
  sum(greatest(len_c - 3, 0)) AS g4 FROM s)""")
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = bleu.corpus_bleu(answer_pairs(spark, sf_dir), PAIR)
    return score.withColumn("bleu", F.round("bleu", 9))


def _multi_sql(rule: str) -> str:
    return f"""
WITH t AS MATERIALIZED (SELECT conv_id, turn, role, {normalised_sql('text')} AS w FROM conversations),
c AS (SELECT conv_id, arg_min(w, turn) AS w FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT conv_id, turn, w FROM t WHERE role = 'user'),
cc AS (SELECT conv_id, u.n AS n, u.g AS g, count(*) AS a FROM (SELECT conv_id, {grams_sql()} AS u FROM c) GROUP BY ALL),
rr AS (SELECT conv_id, n, g, max(b) AS b FROM (SELECT conv_id, turn, u.n AS n, u.g AS g, count(*) AS b
  FROM (SELECT conv_id, turn, {grams_sql()} AS u FROM r) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT conv_id, {_MATCHES} FROM cc JOIN rr USING (conv_id, n, g) GROUP BY conv_id),
l AS (SELECT c.conv_id, len(c.w) AS len_c, CAST({rule} AS DOUBLE) AS len_r
      FROM c JOIN r USING (conv_id) GROUP BY c.conv_id, len_c),
s AS (SELECT * FROM l LEFT JOIN m USING (conv_id))
SELECT conv_id, CAST(len_c AS INTEGER) AS length, len_r AS reference_length, round({_score_sql('')}, 9) AS bleu FROM s"""


def _multi(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations"))
    first = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("text")
    )

    def words(text: Column) -> Column:
        return bleu.normalise(bleu.prepare(text)).alias("words")

    scores = bleu.multi_reference_bleu(
        first.select("conv_id", words(F.col("text"))),
        turns.where(F.col("role") == "user").select("conv_id", "turn", words(F.col("text"))),
        "conv_id", "turn", rule,
    )
    return scores.withColumn("bleu", F.round("bleu", 9))


@query(_multi_sql("min(len(r.w))"))
def bleu_multi_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi(spark, sf_dir, "shortest")


@query(_multi_sql("avg(len(r.w))"))
def bleu_multi_ref_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi(spark, sf_dir, "average")


@query(_multi_sql("arg_min(len(r.w), abs(len(r.w) - len(c.w)) * 100000 + r.turn)"))
def bleu_multi_ref_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi(spark, sf_dir, "closest")


_PASSED_SQL = "SELECT *, value < 60 AS passed FROM events"
#: The same outcomes of perturbed prompts, whatever their kind: one variant.
_ONE_VARIANT = ROBUST_SQL.replace("event_type, user_id, event_id % 5 AS seed", "user_id, event_id % 5 AS seed").replace(
    "PARTITION BY event_type, user_id", "PARTITION BY user_id")
_KIND_SQL = pass_sql("SELECT * FROM events", "event_type", "value < 60", (1, 10, 100))


@query(f"""
WITH o AS MATERIALIZED ({_ONE_VARIANT}), kinds AS MATERIALIZED ({_KIND_SQL}),
n AS (SELECT user_id, seed, count(*) AS n, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS rate FROM o GROUP BY ALL),
i AS (SELECT user_id, sample, bool_and(passed) AS ok FROM o GROUP BY ALL),
strict AS (SELECT user_id, count(*) FILTER (ok AND sample < shortest) / any_value(shortest) AS score
  FROM i JOIN (SELECT user_id, min(n) AS shortest FROM n GROUP BY user_id) USING (user_id) GROUP BY user_id)
SELECT 'mbpp' AS task, metric, round(score, 9) AS score FROM ({pass_sql("SELECT *, 0 AS run FROM events", 'run', 'value < 60', (1, 10, 100))})
UNION ALL SELECT 'ds1000-all-completion', 'mean_score', round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 9) FROM ({_PASSED_SQL})
UNION ALL SELECT 'python_bugs', 'exact_match', score FROM ({ORACLES["exact_match"]})
UNION ALL SELECT 'pal-gsm8k-majority_voting', 'accuracy', accuracy FROM ({ORACLES["vote_accuracy"]})
UNION ALL SELECT 'pal-gsm8k-greedy', 'accuracy', accuracy FROM ({ORACLES["first_answer_accuracy"]})
UNION ALL SELECT 'codexglue_code_to_text-java', 'bleu', round(bleu, 9) FROM ({ORACLES["bleu_mean"]})
UNION ALL SELECT 'conala', 'bleu', bleu FROM ({ORACLES["bleu_corpus"]})
UNION ALL SELECT 'perturbed-humaneval-format-num_seeds_3', 'robust-pass-at-1', round(avg(score), 9) FROM strict
UNION ALL SELECT 'perturbed-humaneval-format-num_seeds_3', 'alt-robust-pass-at-1', round(avg(rate), 9)
  FROM (SELECT user_id, product(rate) AS rate FROM n GROUP BY user_id)
UNION ALL SELECT 'parity', (user_id % 5 + 1) || ' bugs/pass@1', round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 9)
  FROM ({_PASSED_SQL}) GROUP BY user_id % 5
UNION ALL SELECT 'quixbugs', event_type || '/' || metric, round(score, 9) FROM kinds
UNION ALL SELECT 'quixbugs', 'all/' || metric, round(avg(score), 9) FROM kinds GROUP BY metric
UNION ALL SELECT 'quixbugs', 'num_correct', round(sum(score), 9) FROM kinds WHERE metric = 'pass@1'""")
def task_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task of each kind of metric, scored by its name alone."""
    pair = {"instruction1": "", "solution1": "", "instruction2": "", "solution2": ""}
    shots = {"questions": [""] * 8, "solutions": [""] * 8, **pair}
    ran = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("problem_idx"), F.col("event_id").alias("sample_idx"),
        (F.col("value") < 60).alias("passed"), F.col("event_type").alias("name"),
        (F.col("user_id") % 5 + 1).alias("bugs"),
    )
    seeds = number_rows(
        perturbed(spark, sf_dir).withColumnRenamed("user_id", "problem_idx"), "event_id",
        into="sample_idx", groups=["problem_idx", "seed"],
    ).withColumn("sample_idx", F.col("sample_idx") - 1)
    said = answers(spark, sf_dir).select(
        F.col("user_id").alias("problem_idx"), F.col("event_id").alias("sample_idx"),
        F.col("result").alias("text"), (F.col("user_id") % 5).alias("target"),
    )
    turns = table(spark, sf_dir, "conversations")
    head = F.left("text", F.floor(F.length("text") / (1 + F.col("turn") % 3)).cast("int"))
    bugs = turns.select(
        F.col("conv_id").alias("problem_idx"), F.col("turn").alias("sample_idx"), head.alias("text"),
        F.when(F.col("turn") % 2 == 0, head).otherwise(F.upper(head)).alias("task_reference"),
    )
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("task_reference"))
    given = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), "text")
    talk = asked.join(given, PAIR).withColumnsRenamed(
        {"conv_id": "problem_idx", "turn": "sample_idx"})
    inputs = {
        "mbpp": ran, "ds1000-all-completion": ran, "python_bugs": bugs,
        "pal-gsm8k-majority_voting": said, "pal-gsm8k-greedy": said,
        "codexglue_code_to_text-java": talk, "conala": talk,
        "perturbed-humaneval-format-num_seeds_3": seeds, "parity": ran, "quixbugs": ran,
    }
    out = None
    for name, rows in inputs.items():
        task = tasks.spec(name, shots=shots if name.startswith(("pal-", "conala")) else None)
        part = scoring.score_task(task, rows).select(
            F.lit(name).alias("task"), "metric", F.round("score", 9).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
