"""Packing and training-set queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import text as t
from tallymill.functions import tokens as tok
from tallymill.operators import corpus, dictionary, packing
from tallymill.plans import sqlkit as k
from tallymill.plans.corpus import SOURCES_SQL, sources
from tallymill.plans.registry import digest, query, spread, table

SEQ, END, BATCH = 512, 0, 250


def joined(ids: Column) -> Column:
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").cast("binary"))


#: Ids 0 and 1 are taken: end and padding, separator.
FIRST_ID = 2


def vocabulary_sql(tokens: str, source: str) -> str:
    """(token, id) of the distinct tokens of a source."""
    return (f"SELECT token, {FIRST_ID - 1} + row_number() OVER (ORDER BY token) AS id "
            f"FROM (SELECT DISTINCT unnest({tokens}) AS token FROM {source})")


def ids_sql(key: str, tokens: str, source: str, vocabulary: str) -> str:
    """(key, ids) of a source, by a vocabulary."""
    return (f"SELECT {key}, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS ids FROM ("
            f"SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT {key}, {tokens} AS t FROM {source}) "
            f"UNION ALL SELECT {key}, NULL, NULL FROM {source}) LEFT JOIN {vocabulary} USING (token) GROUP BY {key}")


def md5_ids_sql(ids: str) -> str:
    return f"md5(array_to_string({ids}, ' '))"


@query(f"""
WITH kept AS (SELECT doc_id, {k.meta_cut('content')} AS body FROM ({SOURCES_SQL})
              WHERE {k.reason('content')} = 'kept'),
v AS ({vocabulary_sql(k.words('body'), 'kept')}),
e AS ({ids_sql('doc_id', k.words('body'), 'kept', 'v')}),
rows AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch, doc_id,
           list_append(ids, {END}) AS ids FROM e),
flat AS (SELECT batch, doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM rows),
placed AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS pos,
             count(*) OVER (PARTITION BY batch) AS total FROM flat),
blocks AS (SELECT batch, pos // {SEQ} AS block, list(id ORDER BY pos) AS ids, any_value(total) AS total
           FROM placed GROUP BY ALL)
SELECT batch, block, len(ids) AS n_ids, {md5_ids_sql('ids')} AS ids_md5,
  {md5_ids_sql('ids')} AS labels_md5
FROM blocks WHERE (block + 1) * {SEQ} < total""")
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir)
    kept = corpus.clean(files).select("doc_id", "content")
    words = tok.words(F.col("content"))
    encoded = dictionary.encode(kept, "doc_id", {"ids": words}, dictionary.vocabulary(kept, words, FIRST_ID))
    blocks = packing.pack_blocks(
        encoded, "doc_id", F.col("ids"),
        seq_length=SEQ, end_id=END, batch_rows=BATCH,
    )
    return blocks.select(
        "batch", "block", F.size("input_ids").cast("long").alias("n_ids"),
        joined(F.col("input_ids")).alias("ids_md5"), joined(F.col("labels")).alias("labels_md5"),
    )


# Problems derived from the documents: solutions are the first lines as a JSON
# array (broken JSON for some rows), the function name is set for some rows.
def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.slice(t.lines(F.replace("text", F.lit('"'), F.lit(""))), 1, 3)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("Task of "), "source", F.lit(" "), t.first_line(F.col("text")))
        .alias("question"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("def f():")).otherwise(F.lit("")).alias("starter_code"),
        F.when(F.col("doc_id") % 5 == 4, F.lit("[broken")).otherwise(F.to_json(lines)).alias("solutions"),
        F.when(F.col("doc_id") % 3 == 0, F.lit('{"fn_name": "f"}'))
        .when(F.col("doc_id") % 3 == 1, F.lit('{"inputs": []}'))
        .otherwise(F.lit("not json")).alias("input_output"),
    )


PROBLEMS_SQL = """
SELECT doc_id, 'Task of ' || source || ' ' || string_split(text, chr(10))[1] AS question,
  CASE WHEN doc_id % 2 = 0 THEN 'def f():' ELSE '' END AS starter_code,
  CASE WHEN doc_id % 5 = 4 THEN NULL
       ELSE list_slice(string_split(replace(text, '"', ''), chr(10)), 1, 3) END AS solutions,
  CASE WHEN doc_id % 3 = 0 THEN 'Call-Based' ELSE 'Standard Input' END AS kind FROM documents"""
PAIRS_SQL = f"""
SELECT doc_id, question, starter_code, unnest(range(len(solutions))) AS pos,
  unnest(solutions) AS solution, chr(10) || 'Use ' || kind || ' format' || chr(10) AS answer_type
FROM ({PROBLEMS_SQL}) WHERE solutions IS NOT NULL"""


@query(f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(question) AS question_md5, starter_code,
  md5(solution) AS solution_md5, answer_type FROM ({PAIRS_SQL})""")
def solution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = packing.solution_pairs(problems(spark, sf_dir), "doc_id")
    return pairs.select(
        "doc_id", "pos", digest(F.col("question")).alias("question_md5"), "starter_code",
        digest(F.col("solution")).alias("solution_md5"), "answer_type",
    )


_PROMPT_SQL = (
    "chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || starter_code || chr(10) "
    "|| answer_type || chr(10) || 'ANSWER:' || chr(10)"
)


@query(f"""
SELECT 'json' AS filter, count(*) FILTER (event_id % 4 <> 0) AS kept, count(*) FILTER (event_id % 4 = 0) AS dropped,
  CAST(sum(CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS total
FROM events
UNION ALL
SELECT 'prompt', count(*) FILTER (n < 40), count(*) FILTER (n >= 40), CAST(sum(n) FILTER (n < 40) AS BIGINT)
FROM (SELECT len({k.words(_PROMPT_SQL)}) AS n FROM ({PAIRS_SQL}))""")
def pairs_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed JSON is skipped and counted; long prompts are dropped and counted."""
    text = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props"))
    read = table(spark, sf_dir, "events").select(
        F.lit("json").alias("filter"), F.from_json(text, "k long")["k"].alias("value")
    )
    pairs = packing.solution_pairs(problems(spark, sf_dir), "doc_id")
    sizes = pairs.select(
        F.lit("prompt").alias("filter"),
        F.size(tok.words(packing.pair_prompt(pairs))).cast("long").alias("n"),
    ).select("filter", F.when(F.col("n") < 40, F.col("n")).alias("value"))
    return read.unionByName(sizes).groupBy("filter").agg(
        F.count("value").alias("kept"), F.count_if(F.col("value").isNull()).alias("dropped"),
        F.sum("value").alias("total"),
    )


@query(f"""
SELECT md5(question) AS question_md5, count(*) AS pairs, min(doc_id) AS first_problem,
  CAST(sum(length(solution)) AS BIGINT) AS solution_chars
FROM ({PAIRS_SQL}) WHERE len({k.words(_PROMPT_SQL)}) < 40 GROUP BY question""")
def pairs_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = packing.solution_pairs(problems(spark, sf_dir), "doc_id")
    return packing.pairs_per_question(packing.short_pairs(pairs, 40), "doc_id")


@query(f"""
WITH s AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS o, {k.bucket('doc_id', 16)} AS shard,
  CAST(len({k.words('text')}) AS BIGINT) AS n_tokens FROM documents)
SELECT doc_id, shard, n_tokens, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY shard ORDER BY o
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2048 AS BIGINT) AS pack_id FROM s""")
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack_budget(docs, "doc_id", F.col("text"), budget=2048, shards=16)


@query(f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, CAST(len({k.words('text')}) AS BIGINT) AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, n_tokens, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM s WHERE n_tokens > 0),
p AS (SELECT doc_id AS pack, CAST(0 AS BIGINT) AS place, doc_id, n_tokens, n_tokens AS filled FROM s
  UNION ALL
  SELECT p.pack, p.place + 1, d.doc_id, d.n_tokens, p.filled + d.n_tokens FROM p JOIN d ON d.rank =
    CAST('0x' || substr(md5('7:' || p.pack || ':' || (p.place + 1)), 1, 15) AS BIGINT) % (SELECT count(*) FROM d)
  WHERE p.filled < 2048)
SELECT pack, place, doc_id, n_tokens FROM p""")
def pack_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack_draws(docs, "doc_id", F.size(tok.words(F.col("text"))), budget=2048, seed=7)


_FIRST_LINE_SQL = k.words("string_split(text, chr(10))[1]")
_QA_SQL = f"""
WITH v AS ({vocabulary_sql(k.words('text'), 'documents')}),
q AS ({ids_sql('doc_id', _FIRST_LINE_SQL, 'documents', 'v')}),
a AS ({ids_sql('doc_id', k.words('text'), 'documents', 'v')})
SELECT doc_id, q.ids AS question, a.ids AS answer FROM q JOIN a USING (doc_id)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = tok.words(F.col("text"))
    sides = {"question": tok.words(t.first_line(F.col("text"))), "answer": words}
    return dictionary.encode(docs, "doc_id", sides, dictionary.vocabulary(docs, words, FIRST_ID))


@query(f"""
SELECT doc_id, {md5_ids_sql('list_slice(ids, 1, 256)')} AS ids_md5,
  {md5_ids_sql('list_slice(labels, 1, 256)')} AS labels_md5, least(len(ids), 256) AS n_ids
FROM (SELECT doc_id, list_append(list_concat(question, answer), {END}) AS ids,
  list_append(list_concat(list_transform(question, lambda x: -100), answer), {END}) AS labels
  FROM ({_QA_SQL}))""")
def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.masked_labels(F.col("question"), F.col("answer"), END, 256)
    rows = questions(spark, sf_dir).select("doc_id", made.alias("m"))
    size = F.size("m.input_ids")
    checked = F.when(size == F.size("m.labels"), size).otherwise(
        F.raise_error(F.lit("ids and labels differ in length"))
    )
    return rows.select(
        "doc_id", joined(F.col("m.input_ids")).alias("ids_md5"),
        joined(F.col("m.labels")).alias("labels_md5"), checked.cast("long").alias("n_ids"),
    )


@query(f"""
SELECT doc_id, {md5_ids_sql('list_concat(kept, list_transform(range(128 - len(kept)), lambda x: 0))')} AS ids_md5,
  {md5_ids_sql('list_concat(list_transform(kept, lambda x: 1), list_transform(range(128 - len(kept)), lambda x: 0))')} AS mask_md5,
  {md5_ids_sql('list_concat(kept, list_transform(range(128 - len(kept)), lambda x: -100))')} AS labels_md5
FROM (SELECT doc_id, list_slice(answer, 1, 128) AS kept FROM ({_QA_SQL}))""")
def truncate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("answer")
    padded = packing.padded(ids, 128)
    return questions(spark, sf_dir).select(
        "doc_id", joined(padded).alias("ids_md5"),
        joined(packing.attention(ids, 128)).alias("mask_md5"),
        joined(packing.ignore_padding(padded, F.least(F.size(ids), F.lit(128)))).alias("labels_md5"),
    )


@query(f"""
WITH s AS (SELECT doc_id, question, answer, len(question) AS a, len(answer) AS b, 62 AS room FROM ({_QA_SQL})),
w AS (SELECT *, CASE WHEN a + b <= room THEN a WHEN b < room // 2 THEN room - b
                     WHEN a < room - room // 2 THEN a ELSE room - room // 2 END AS ka FROM s)
SELECT doc_id, {md5_ids_sql('list_concat(list_slice(question, 1, ka), [1, 1], list_slice(answer, 1, least(b, room - ka)))')} AS ids_md5,
  least(a + b, room) + 2 AS n_ids FROM w""")
def pair_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sep = F.array(F.lit(1), F.lit(1))
    both = packing.pair_encoding(F.col("question"), F.col("answer"), sep, 64)
    return questions(spark, sf_dir).select("doc_id", both.alias("ids")).select(
        "doc_id", joined(F.col("ids")).alias("ids_md5"), F.size("ids").cast("long").alias("n_ids")
    )


@query(f"""
SELECT doc_id, md5({k.strip('string_split(s, chr(34) || chr(34) || chr(34))[1]')} ||
  string_split(s, chr(34) || chr(34) || chr(34))[3]) AS body_md5
FROM (SELECT doc_id, replace(text, ', ', ' ' || chr(34) || chr(34) || chr(34) || ' ') AS s
      FROM documents)""")
def drop_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.replace("text", F.lit(", "), F.lit(' """ '))
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(packing.without_docstring(code)).alias("body_md5")
    )


@query("""
SELECT item_id, CAST(copy AS INTEGER) AS copy FROM benchmark, range(7) r(copy)""")
def replicate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty samples in batches of three need seven copies of each problem."""
    problems_ = table(spark, sf_dir, "benchmark").select("item_id")
    copies = packing.copies_needed(20, 3, problems_.count(), 8)
    return packing.replicate(problems_, copies)
