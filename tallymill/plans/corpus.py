"""Corpus queries: filters, rewriting, token accounting, splits, edits, checks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import prompts
from tallymill.functions import text as t
from tallymill.functions import tokens as tok
from tallymill.operators import corpus, edits, grids, packing, selection
from tallymill.operators.numbering import number_rows
from tallymill.plans import sqlkit as k
from tallymill.plans.registry import SOURCE, digest, query, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: some with a meta line or a shebang."""
    return documents(spark, sf_dir).select(
        "doc_id", "lang", "n_chars", F.expr(SOURCE).alias("content")
    )


SOURCES_SQL = f"SELECT doc_id, lang, n_chars, {SOURCE} AS content FROM documents"


@query(f"""
SELECT doc_id, lang, length(body) AS chars, md5(body) AS body_md5
FROM (SELECT doc_id, lang, {k.meta_cut('content')} AS body, {k.reason('content')} AS reason
      FROM ({SOURCES_SQL}) WHERE n_chars > 100) WHERE reason = 'kept'""")
def corpus_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus.clean(sources(spark, sf_dir), popularity="n_chars")
    body = F.col("content")
    return kept.select(
        "doc_id", "lang", F.length(body).cast("long").alias("chars"),
        digest(body).alias("body_md5"),
    )


@query(f"""
SELECT lang, reason, count(*) AS rows FROM (
  SELECT lang, {k.reason('content')} AS reason FROM ({SOURCES_SQL})) GROUP BY ALL""")
def corpus_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.reject_counts(sources(spark, sf_dir), "content", "lang")


@query(f"""
SELECT page_id, CAST(length(body) AS BIGINT) AS chars, md5(body) AS body_md5
FROM (SELECT page_id, {k.meta_cut('html')} AS body FROM pages)""")
def strip_meta_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = corpus.strip_meta_line(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body")).select(
        "page_id", F.length("body").cast("long").alias("chars"),
        digest(F.col("body")).alias("body_md5"),
    )


# The wrapped texts are programs; plain prose is not.
@query(f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, chr(10))) AS tokens_md5
FROM (SELECT doc_id, {k.words('text')} AS w FROM documents)""")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", tok.words(F.col("text")).alias("w"))
    return docs.select(
        "doc_id", F.size("w").cast("long").alias("n_tokens"),
        digest(F.array_join("w", "\n")).alias("tokens_md5"),
    )


_SPECIAL_WORDS = k.q(f"{tok.SPECIALS}|{k.WORDS}")
_SPECIAL_PIECES = k.q(
    rf"{tok.SPECIALS}|[{k.WORD_CLASS}]{{1,4}}|[^{k.SPACE_CLASS}{k.WORD_CLASS}]"
)


@query(f"""
WITH s AS (SELECT lang, content, {k.reason('content')} = 'kept' AS kept,
                  {k.rewritten(f'({k.meta_cut("content")})')} AS new FROM ({SOURCES_SQL})),
r AS (SELECT * FROM (VALUES ('words', {_SPECIAL_WORDS}), ('pieces', {_SPECIAL_PIECES}))
      v(tokenizer, rule)),
c AS (SELECT lang, kept, tokenizer, len(regexp_extract_all(content, {_SPECIAL_WORDS})) AS raw,
        len(regexp_extract_all(new, {_SPECIAL_WORDS})) AS new FROM s, r WHERE tokenizer = 'words'
      UNION ALL
      SELECT lang, kept, tokenizer, len(regexp_extract_all(content, {_SPECIAL_PIECES})),
        len(regexp_extract_all(new, {_SPECIAL_PIECES})) FROM s, r WHERE tokenizer = 'pieces')
SELECT lang, count(*) AS rows, count(*) FILTER (kept) AS kept_rows, tokenizer,
  CAST(sum(raw) AS BIGINT) AS code_tokens,
  CAST(coalesce(sum(raw) FILTER (kept), 0) AS BIGINT) AS filtered_code_tokens,
  CAST(coalesce(sum(new) FILTER (kept), 0) AS BIGINT) AS parsed_tokens,
  round(sum(new) FILTER (kept) / nullif(sum(raw) FILTER (kept), 0), 9) AS ratio
FROM c GROUP BY lang, tokenizer""")
def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = corpus.token_report(sources(spark, sf_dir), by=("lang",))
    return report.withColumn("ratio", F.round("ratio", 9))


@query(f"""
SELECT doc_id, md5(body) AS body_md5, CAST(length(body) AS BIGINT) AS chars
FROM (SELECT doc_id, {k.rewritten('content')} AS body FROM ({SOURCES_SQL}))""")
def corpus_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tok.rewrite_vocabulary(F.col("content")).alias("body")
    return sources(spark, sf_dir).select("doc_id", body).select(
        "doc_id", digest(F.col("body")).alias("body_md5"),
        F.length("body").cast("long").alias("chars"),
    )


@query(f"""
WITH x AS (SELECT doc_id, content, {k.lexemes('content')} AS lex FROM ({SOURCES_SQL})),
m AS (SELECT doc_id, content, {k.kept_marks('lex')} AS kept,
  regexp_split_to_array({k.compacted(k.masked('lex'))}, {k.q('["' + chr(39) + ']MASK["' + chr(39) + ']')}) AS gaps FROM x),
b AS (SELECT doc_id, content, array_to_string(list_transform(range(1, greatest(len(gaps), len(kept)) + 1),
  lambda i: coalesce(gaps[i], '') || coalesce(kept[i], '')), '') AS body FROM m)
SELECT doc_id, CAST(length(content) AS BIGINT) AS raw_chars, CAST(length(body) AS BIGINT) AS chars,
  md5(body) AS body_md5 FROM b""")
def text_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tok.rewrite_compact(F.col("content")).alias("body")
    return sources(spark, sf_dir).select("doc_id", "content", body).select(
        "doc_id", F.length("content").cast("long").alias("raw_chars"),
        F.length("body").cast("long").alias("chars"),
        digest(F.col("body")).alias("body_md5"),
    )


@query(f"""
WITH v AS (SELECT unnest([{', '.join(k.q(x) for x in fixed.grammar_tokens())}]) AS token),
u AS (SELECT token, count(*) AS uses FROM (
  SELECT unnest(regexp_extract_all({k.rewritten('content')}, {k.q(tok.SPECIALS)})) AS token
  FROM ({SOURCES_SQL})) GROUP BY token)
SELECT token, coalesce(uses, 0) AS uses FROM v LEFT JOIN u USING (token)""")
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tok.rewrite_vocabulary(F.col("content")).alias("content")
    return corpus.vocabulary_use(sources(spark, sf_dir).select(body))


@query(f"""
SELECT token, count(*) AS lists, 2 + row_number() OVER (ORDER BY token) - 1 AS token_id FROM (
  SELECT DISTINCT 'documents' AS origin, unnest({k.words('lower(text)')}) AS token FROM documents
  UNION ALL
  SELECT DISTINCT 'conversations', unnest({k.words('lower(text)')}) FROM conversations
  UNION ALL
  SELECT DISTINCT 'benchmark', unnest({k.words('lower(text)')}) FROM benchmark)
GROUP BY token""")
def vocab_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sorted vocabulary of overlapping lists, with ids and how many hold it.

    Ids 0 and 1 stay free for padding and the end of a text.

    A list marks its tokens with its own bit, so one aggregation serves both the
    distinct tokens and the count of lists.
    """
    parts = [
        spread(table(spark, sf_dir, name)).select(
            F.lit(1 << bit).alias("mark"), F.explode(tok.words(F.lower("text"))).alias("token")
        ) for bit, name in enumerate(("documents", "conversations", "benchmark"))
    ]
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    marked = joined.groupBy("token").agg(F.bit_or("mark").alias("marks"))
    counted = marked.select("token", F.bit_count("marks").cast("long").alias("lists"))
    return packing.numbered_names(counted, "token", "token_id", first=2)


# Edits derived from the documents: every 40 characters an outer span, one
# inside it, one overlapping its end, and an empty one.
def derived_edits(docs: DataFrame) -> DataFrame:
    base = (F.col("i") * 40).cast("long")

    def span(low: int, high: int, mark: str) -> Column:
        return F.struct(
            (base + low).alias("start"), (base + high).alias("end"),
            F.concat(F.lit(f"<{mark}"), F.col("i").cast("string"), F.lit(">")).alias("new_str"),
        )

    steps = docs.where(F.length("text") >= 40).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 40) - 1)).alias("i")
    )
    spans = F.array(span(0, 20, "outer"), span(5, 10, "inner"), span(15, 25, "over"),
                    span(30, 30, "empty"))
    return steps.select("doc_id", F.explode(spans).alias("e")).select("doc_id", "e.*")


@query("""
WITH p AS (SELECT doc_id, text, length(text) // 40 AS n FROM documents),
s AS (SELECT doc_id, string_agg(substr('<outer' || i || '>', 1, 5) || '<inner' || i || '>' || substr('<outer' || i || '>', 11)
        || substr(text, i * 40 + 21, 20), '' ORDER BY i) AS head
      FROM (SELECT doc_id, text, n, unnest(range(n)) AS i FROM p) GROUP BY doc_id)
SELECT p.doc_id, md5(coalesce(head, '') || substr(text, n * 40 + 1)) AS body_md5
FROM p LEFT JOIN s USING (doc_id)""")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    edited = edits.apply(docs, derived_edits(docs))
    return edited.select("doc_id", digest(F.col("text")).alias("body_md5"))


# Deeper edits: in every 60 characters three levels and a sibling, one that
# crosses the outer span, and one that crosses only the one left out. Every
# fifth document lies inside one more edit as a whole.
OUTER, INNER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123", "abcdefghij"


def deep_edits(docs: DataFrame) -> DataFrame:
    base = (F.col("i") * 60).cast("long")

    def span(low: int, high: int, new: str) -> Column:
        return F.struct((base + low).alias("start"), (base + high).alias("end"),
                        F.concat(F.lit(new), F.col("i").cast("string")).alias("new_str"))

    steps = docs.where(F.length("text") >= 60).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 60) - 1)).alias("i"))
    spans = F.array(span(0, 30, OUTER), span(5, 15, INNER), span(7, 9, "!"), span(20, 28, "uvw"), span(25, 35, "cross"),
                    span(33, 38, "chain"), span(40, 40, "empty"))
    whole = docs.where((F.col("doc_id") % 5 == 0) & (F.length("text") > 0)).select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"),
        F.replace("text", F.lit("e"), F.lit("E")).alias("new_str"))
    return steps.select("doc_id", F.explode(spans).alias("e")).select("doc_id", "e.*").unionByName(whole)


@query(f"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, 'e', 'E') ELSE text END AS body,
             length(text) // 60 AS n FROM documents),
b AS (SELECT doc_id, body, unnest(range(n)) AS i FROM p),
l AS (SELECT doc_id, body, i, '{INNER}' || i AS inside, '{OUTER}' || i AS outside FROM b),
s AS (SELECT doc_id, string_agg(outside[1:5] || inside[1:2] || '!' || i || inside[5:] || outside[16:20] || 'uvw' || i
        || outside[29:] || substr(body, i * 60 + 31, 30), '' ORDER BY i) AS head FROM l GROUP BY doc_id)
SELECT p.doc_id, md5(coalesce(head, '') || substr(body, n * 60 + 1)) AS body_md5 FROM p LEFT JOIN s USING (doc_id)""")
def fold_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits nested up to four deep, with crossing ones among them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return edits.apply(docs, deep_edits(docs)).select("doc_id", digest(F.col("text")).alias("body_md5"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 5 = 0 AND length(text) > 0 AS whole, length(text) // 60 AS n FROM documents),
t(status, below, each) AS (VALUES ('applied', 0, 1), ('folded', 1, 2), ('folded', 2, 1), ('crossing', NULL, 2), ('empty', NULL, 1)),
e AS (SELECT doc_id, CASE WHEN whole AND status = 'applied' THEN 'folded' ELSE status END AS status,
        below + whole::INTEGER AS depth, n * each AS edits FROM d, t
      UNION ALL SELECT doc_id, 'applied', 0, 1 FROM d WHERE whole)
SELECT doc_id, status, depth::BIGINT AS depth, sum(edits)::BIGINT AS edits FROM e WHERE edits > 0 GROUP BY ALL""")
def edit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each edit: applied, folded at a depth, or left out and why."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return edits.forest(deep_edits(docs)).groupBy("doc_id", "status", "depth").agg(F.count(F.lit(1)).alias("edits"))


@query("""
WITH e AS (SELECT doc_id, unnest(range(length(text) // 40)) AS i FROM documents),
x AS (SELECT doc_id, i, 0 AS low, 20 AS high, '<outer' || i || '>' AS content FROM e
      UNION ALL SELECT doc_id, i, 5, 10, '<inner' || i || '>' FROM e
      UNION ALL SELECT doc_id, i, 15, 25, '<over' || i || '>' FROM e
      UNION ALL SELECT doc_id, i, 30, 30, '<empty' || i || '>' FROM e)
SELECT doc_id, count(*) AS edits, CAST(sum(i * 40 + low) AS BIGINT) AS start_sum FROM x
WHERE NOT (starts_with(content, '<inner') AND i % 2 = 0)
GROUP BY doc_id""")
def cancel_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = derived_edits(docs).withColumnRenamed("new_str", "content")
    inner_even = F.startswith(F.col("content"), F.lit("<inner")) & (
        F.floor(F.col("start") / 40) % 2 == 0
    )
    left = edits.cancel(spans, spans.where(inner_even))
    return left.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("edits"), F.sum("start").alias("start_sum")
    )


@query("""
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.line_count(F.col("text")).alias("n_lines")
    )


@query(f"""
SELECT doc_id, md5(CASE WHEN lang = 'en' THEN {k.rewritten('text')} ELSE text END) AS body_md5
FROM documents""")
def corpus_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten text for the converted variant, original text otherwise."""
    body = F.when(
        F.col("lang") == "en", tok.rewrite_vocabulary(F.col("text"))
    ).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", digest(body).alias("body_md5"))


@query(f"""
SELECT doc_id, lang FROM documents WHERE lang <> 'en' OR {k.share('doc_id')} < 0.57""")
def corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the converted language, everything of the others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return corpus.sample(docs, "doc_id", 0.57, only=F.col("lang") == "en")


@query(f"""
SELECT doc_id, CASE WHEN {k.share('doc_id')} < 0.05 THEN 'valid' ELSE 'train' END AS split
FROM documents""")
def split_train_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", corpus.split_two(F.col("doc_id")).alias("split")
    )


@query(f"""
SELECT doc_id, CASE WHEN {k.share('doc_id')} < 0.8 THEN 'train'
  WHEN {k.share('doc_id')} < 0.9 THEN 'test' ELSE 'valid' END AS split FROM documents""")
def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", corpus.split_three(F.col("doc_id")).alias("split")
    )


@query("""
SELECT c.conv_id, c.turn, md5(b.text) AS ref_md5 FROM conversations c
JOIN benchmark b ON c.conv_id = b.item_id WHERE c.conv_id >= 5 AND c.conv_id < 25""")
def problem_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice is taken on both sides, so completions meet their own problem."""
    completions = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    problems = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "conv_id")
    left = selection.problem_slice(completions, "conv_id", 5, 20)
    right = selection.problem_slice(problems, "conv_id", 5, 20)
    return left.join(right, "conv_id").select(
        "conv_id", "turn", digest(F.col("text")).alias("ref_md5")
    )


_TASKS = fixed.task_names()
TASK_OF = f"CAST(event_id % {len(_TASKS)} AS INT)"


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of the named tasks."""
    names = F.array(*[F.lit(name) for name in _TASKS])
    return table(spark, sf_dir, "events").withColumn("task", F.get(names, F.expr(TASK_OF)))


_TASK_LIST = "[" + ", ".join(k.q(name) for name in _TASKS) + "]"
TASK_EVENTS_SQL = f"SELECT *, {_TASK_LIST}[{TASK_OF} + 1] AS task FROM events"


@query(f"""
SELECT task, count(*) AS rows, count(*) FILTER (event_type <> 'error') AS passed
FROM ({TASK_EVENTS_SQL})
WHERE task LIKE 'multiple-%' OR task LIKE 'ds1000-%-insertion' OR task = 'mbpp'
   OR task LIKE 'multiple-j_'
GROUP BY task""")
def task_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = "multiple-*,ds1000-*-insertion,mbpp,multiple-j?"
    selection.check_patterns(patterns)
    chosen = selection.select_tasks(selection.task_table(spark), patterns).select("task")
    outcomes = task_events(spark, sf_dir).join(F.broadcast(chosen), "task", "left_semi")
    return outcomes.groupBy("task").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("event_type") != "error").alias("passed"),
    )


_STOP_ROWS = ", ".join(
    f"({k.q(name)}, {len(fixed.stops_for(name))}, {k.q(' | '.join(fixed.stops_for(name)))})"
    for name in _TASKS
)


@query(f"""
SELECT task, split_part(task, '-', 1) AS family, n_stops, md5(stops) AS stops_md5, count(*) AS rows
FROM ({TASK_EVENTS_SQL}) JOIN (VALUES {_STOP_ROWS}) v(task, n_stops, stops) USING (task)
GROUP BY ALL""")
def task_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per task with the family and stop strings of the catalogue."""
    counts = task_events(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
    tasks = F.broadcast(selection.task_table(spark))
    return counts.join(tasks, "task").select(
        "task", "family", F.size("stops").cast("int").alias("n_stops"),
        digest(F.array_join("stops", " | ")).alias("stops_md5"), "rows",
    )


_GRID_SQL = """
  SELECT 'apps' AS grid, 'apps-' || unnest(['introductory', 'interview', 'competition']) AS task
  UNION ALL SELECT 'code_to_text', 'codexglue_code_to_text-' || unnest(['python', 'java', 'javascript', 'ruby', 'php', 'go', 'python-left'])
  UNION ALL SELECT 'text_to_text', 'codexglue_text_to_text-' || unnest(['da_en', 'zh_en', 'no_en', 'lv_en'])
  UNION ALL SELECT 'multiple', 'multiple-' || unnest(['py', 'sh', 'cpp', 'cs', 'd', 'go', 'java', 'js', 'jl', 'lua', 'pl', 'php',
    'r', 'rkt', 'rb', 'rs', 'scala', 'swift', 'ts'])
  UNION ALL SELECT 'single', unnest(['conala', 'concode', 'mbpp', 'parity', 'python_bugs', 'quixbugs', 'instruct_wizard_humaneval'])
  UNION ALL SELECT 'humaneval', unnest(['humaneval', 'humaneval-unstripped', 'humaneval-compact'])
  UNION ALL SELECT 'instruct', unnest(['instruct-humaneval', 'instruct-humaneval-nocontext'])
  UNION ALL SELECT 'ds1000', 'ds1000-' || l || '-' || m FROM
    unnest(['all', 'numpy', 'pandas', 'scipy', 'matplotlib', 'sklearn', 'tensorflow', 'pytorch']) a(l), unnest(['completion', 'insertion']) b(m)
    WHERE NOT (l = 'matplotlib' AND m = 'insertion')
  UNION ALL SELECT 'fix', 'humanevalfix' || m || '-' || l FROM
    unnest(['tests', 'docs']) a(m), unnest(['python', 'cpp', 'js', 'java', 'go', 'rust']) b(l)
  UNION ALL SELECT 'explain', 'humanevalexplain' || m || '-' || l FROM
    unnest(['describe', 'synthesize']) a(m), unnest(['python', 'cpp', 'js', 'java', 'go', 'rust']) b(l)
  UNION ALL SELECT 'synthesize', 'humanevalsynthesize-' || unnest(['python', 'cpp', 'js', 'java', 'go', 'rust'])
  UNION ALL SELECT 'pal', 'pal-' || s || '-' || h FROM unnest(['gsm8k', 'gsmhard']) a(s), unnest(['greedy', 'majority_voting']) b(h)
  UNION ALL SELECT 'perturbed', 'perturbed-humaneval-' || c || '-num_seeds_' || n FROM
    unnest(['format', 'func_name', 'natgen', 'nlaugmenter']) a(c), range(1, 10) b(n)"""


# Left out: one pair of values, and one value with any other.
@query(f"""
WITH g AS ({_GRID_SQL})
SELECT grid, task, count(event_id) AS rows, count(*) FILTER (event_type <> 'error') AS passed
FROM g LEFT JOIN ({TASK_EVENTS_SQL}) USING (task) GROUP BY grid, task""")
def task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every task of the grids, those without any included."""
    rules = spark.createDataFrame([
        ("ds1000", "library", "matplotlib", "mode", "insertion"), ("perturbed", "seeds", "10", None, None),
    ], grids.RULES)
    names = grids.expand(*grids.task_grids(spark), rules)
    counts = task_events(spark, sf_dir).groupBy("task").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_type") != "error").alias("passed"))
    met = names.withColumnRenamed("name", "task").join(counts, "task", "left")
    return met.select("grid", "task", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "passed")])


@query("SELECT conv_id, turn FROM conversations WHERE turn < 2")
def sample_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return selection.first_samples(rows, "turn", 2)


@query(f"""
SELECT doc_id, md5({k.strip("coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE source END, ''), text)")}) AS intent_md5,
  CASE WHEN ends_with(f, '.') THEN {k.strip("substr(f, 1, length(f) - 1)")} ELSE f END AS field
FROM (SELECT *, {k.strip(k.before('text', ', '))} AS f FROM documents)""")
def prompt_pick_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(
        F.col("doc_id") % 3 == 2, F.col("source")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(prompts.intent(rewritten, F.col("text"))).alias("intent_md5"),
        prompts.first_field(F.col("text"), ", ").alias("field"),
    )


@query("SELECT count(DISTINCT doc_id) AS rows FROM documents")
def expect_rowcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected count is that of the distinct ids, so repeats would fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return selection.expect_rows(docs, docs.distinct().count())


_LIBRARY = "CASE lang WHEN 'en' THEN 'Numpy' WHEN 'fr' THEN 'Pandas' ELSE 'Matplotlib' END"


@query(f"""
WITH d AS (SELECT doc_id, {_LIBRARY} AS library FROM documents)
SELECT 'All' AS subset, 'Insertion' AS mode, count(*) AS rows FROM d WHERE library <> 'Matplotlib'
UNION ALL SELECT 'All', 'Completion', count(*) FROM d
UNION ALL SELECT 'Matplotlib', 'Completion', count(*) FROM d WHERE library = 'Matplotlib'
UNION ALL SELECT 'Numpy', 'Insertion', count(*) FROM d WHERE library = 'Numpy'""")
def benchmark_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.expr(_LIBRARY).alias("library"))
    parts = [("All", "Insertion"), ("All", "Completion"), ("Matplotlib", "Insertion"),
             ("Numpy", "Insertion")]
    # One pass counts every subset; the counts are then turned into rows.
    asked = [(library, selection.library_mode(library, mode)) for library, mode in parts]
    counts = docs.agg(*(
        F.count_if(selection.in_library(F.col("library"), library, mode)).alias(f"n{i}")
        for i, (library, mode) in enumerate(asked)
    ))
    return counts.select(F.explode(F.array(*(
        F.struct(F.lit(library).alias("subset"), F.lit(mode).alias("mode"), F.col(f"n{i}").alias("rows"))
        for i, (library, mode) in enumerate(asked)
    ))).alias("r")).select("r.*")


@query("""
SELECT min(CASE WHEN contains(text, '[insert]') THEN 'infill' ELSE 'completion' END) AS mode FROM documents""")
def prompt_mode_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(t.contains(F.col("text"), "[insert]"), F.lit("infill")).otherwise(
        F.lit("completion")
    )
    return selection.one_mode(table(spark, sf_dir, "documents"), mode)


@query("""
WITH n AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS label
           FROM (SELECT DISTINCT lang FROM documents))
SELECT doc_id, lang AS class_name, label FROM documents JOIN n USING (lang)""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("class_name"))
    return packing.encode_labels(docs, "class_name", "label")


@query("""
SELECT conv_id, turn, md5('<|prefix|>' || text) AS prompt_md5, md5(substr(text, 11)) AS cut_md5
FROM conversations""")
def prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, text = F.lit("<|prefix|>"), F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", digest(F.concat(prefix, text)).alias("prompt_md5"),
        digest(t.drop_left(text, F.length(prefix))).alias("cut_md5"),
    )


@query("""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_no,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS lang_row FROM documents""", name="number_rows")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    overall = number_rows(docs, "doc_id", into="row_no")
    return number_rows(overall, "doc_id", into="lang_row", groups=["lang"], hot=100).select(
        "doc_id", "row_no", "lang_row"
    )
