"""One registered query per operator, over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import (alignment, bpe, hard_negatives, knn, line_dedup, packing, quality, quality_model, simhash,
                           token_counts, token_files, toxicity, url_rules)
from tallymill.llm.shared import table, written
from tallymill.llm.vocab import read_ranks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_LIBRARY = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_PLAIN_LINE = r"trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'))"


@query(f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w, {_LINES} AS l
           FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
again AS (SELECT doc_id, i FROM i
          QUALIFY count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
line AS (SELECT DISTINCT host, text, unnest(l) AS line, generate_subscripts(l, 1) AS at FROM d),
norm AS (SELECT host, text, {_PLAIN_LINE} AS p FROM line),
common AS (SELECT host, p FROM norm GROUP BY host, p
           HAVING count(DISTINCT text) > 5 AND count(DISTINCT text) > sqrt((
               SELECT count(DISTINCT text) FROM d WHERE d.host = norm.host))),
gone AS (SELECT host, text, sum(len(string_split(p, ' '))) AS n FROM norm JOIN common USING (host, p)
         GROUP BY host, text),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, strlen('') + len(array_to_string(w, ''))::BIGINT AS word_chars,
                len(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_removed_words
         FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN gone g USING (host, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept
FROM base
""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_LIBRARY, BYTE_RANKS)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_LIBRARY)


@query()
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of the registered query, in their order.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(f"""
WITH p AS (SELECT page_id,
                  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
                  row_number() OVER () AS n
           FROM pages),
rules(h, s, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (SELECT n, h || s AS rule, v,
               row_number() OVER (PARTITION BY n ORDER BY length(h || s) DESC, length(h) DESC, v = 'allow') AS rank
        FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN (FROM fit WHERE rank = 1) USING (n)
""")
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(str(r) for r in RULES)} AS r(host, path, verdict)")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), read_ranks(BYTE_RANKS))


@query(r"""
WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos
           FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT doc_id, pos, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM l),
c AS (SELECT w, len(w) AS n, min((doc_id, pos)) AS first, row_number() OVER () AS id FROM w WHERE len(w) > 0 GROUP BY w),
t AS (SELECT id, n, first, unnest(w) AS t FROM c),
s AS (SELECT y.id FROM t AS y JOIN t AS x ON x.t = y.t AND x.first < y.first AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n
      GROUP BY y.id, x.id, y.n, x.n HAVING 5 * count(*) >= 4 * (y.n + x.n - count(*))),
k AS (SELECT first[1] AS doc_id, first[2] AS pos FROM c WHERE id NOT IN (SELECT id FROM s))
SELECT doc_id, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id AND len(w.w) > 0) AS n_lines, count(k.pos) AS n_kept,
       coalesce(string_agg(k.pos, ',' ORDER BY k.pos), '') AS kept_lines
FROM documents AS d LEFT JOIN k USING (doc_id) GROUP BY doc_id
""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
               embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, e.vec_id, sum(q.x * e.x)::BIGINT AS score
      FROM e AS q JOIN e USING (i) WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id GROUP BY ALL)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""")
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files.token_blocks(table(spark, sf_dir, "documents"), WORD_LIBRARY)
    return token_files.read_tokens(written(blocks, "tokens"), with_ids=False)


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
               embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
k AS (SELECT *, row_number() OVER () AS k FROM r),
e AS (SELECT k, vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k),
s AS (SELECT a.k AS a, a.vec_id AS anchor_id, a.label AS own, e.k AS c, e.vec_id, e.label, sum(a.x * e.x)::BIGINT AS score
      FROM e AS a JOIN e USING (i) WHERE a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id GROUP BY ALL),
p AS (SELECT a, anchor_id, c AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (a)
WHERE own <> label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY a, p ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@query()
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"), BYTE_LIBRARY, PIECE_MODEL)
