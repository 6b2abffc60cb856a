"""Diff queries over documents turned into diff texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import patches
from tallymill.plans.registry import NL, digest, query, table

# Each document becomes a diff that changes its first line. The kinds: fitting,
# wrong text, wrong numbers, foreign line, unreadable numbers, no diff mark,
# new file, and two hunks.
_FIRST = f"split_part(text, '{NL}', 1)"
_HUNK = f"concat('-', {_FIRST}, '{NL}+', reverse({_FIRST}))"
_BODY = f"""CASE doc_id % 8
  WHEN 0 THEN concat('@@ -1,1 +1,1 @@{NL}', {_HUNK})
  WHEN 1 THEN concat('@@ -1,1 +1,1 @@{NL}-no such line{NL}+new')
  WHEN 2 THEN concat('@@ -1,3 +1,1 @@{NL}', {_HUNK})
  WHEN 3 THEN concat('@@ -1,1 +1,1 @@{NL}', {_HUNK}, '{NL}foreign')
  WHEN 4 THEN concat('@@ -x +y @@{NL}', {_HUNK})
  WHEN 5 THEN concat('@@ -1 +1 @@ note{NL}', {_HUNK}, '{NL}')
  WHEN 6 THEN concat('@@ -0,0 +1,1 @@{NL}+', {_FIRST})
  ELSE concat('@@ -1,1 +1,2 @@{NL}', {_HUNK}, '{NL}+added{NL}@@ -9,1 +9,1 @@{NL}-gone{NL}+', {_FIRST}) END"""
_FILE = "CASE doc_id % 8 WHEN 6 THEN 'ADDFILE' ELSE text END"
_DFF = f"CASE doc_id % 16 WHEN 5 THEN '{NL}' ELSE '{NL}<DFF> ' END"
DIFF = f"concat('<NME> ', source, '.py{NL}<BEF> ', {_FILE}, '{NL}<MSG> edit ', lang, {_DFF}, {_BODY})"


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(DIFF).alias("diff_text"), F.expr(_BODY).alias("hunk_text"), "text"
    )


_RULE = "(?s)\\A<NME> ([^\\n]*)\\n<BEF> (.*?)\\n<MSG> (.*?)\\n<DFF> (.*)\\z"


@query(f"""
SELECT doc_id, CASE WHEN ok THEN regexp_extract(d, '{_RULE}', 1) END AS name,
  CASE WHEN ok THEN md5(regexp_extract(d, '{_RULE}', 2)) END AS file_md5,
  CASE WHEN ok THEN regexp_extract(d, '{_RULE}', 3) END AS message,
  CASE WHEN ok THEN md5(regexp_extract(d, '{_RULE}', 4)) END AS diff_md5
FROM (SELECT doc_id, d, regexp_matches(d, '{_RULE}') AS ok FROM (SELECT doc_id, {DIFF} AS d FROM documents))""")
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = patches.fields(F.col("diff_text"))
    return diffs(spark, sf_dir).select("doc_id", parts.alias("p")).select(
        "doc_id", "p.name", digest(F.col("p.file")).alias("file_md5"), "p.message",
        digest(F.col("p.diff")).alias("diff_md5"),
    )


# The published hunk patterns.
_HEADER = "(?m)^(@@ [^\\n]*? @@)[^\\n]*\\n"


@query(f"""
WITH h AS (SELECT doc_id, regexp_extract_all(d, '{_HEADER}', 1) AS heads,
             regexp_split_to_array(d, '{_HEADER}') AS bodies
           FROM (SELECT doc_id, {_BODY} AS d FROM documents)),
x AS (SELECT doc_id, unnest(range(len(heads))) AS hunk, unnest(heads) AS head, unnest(bodies[2:]) AS body FROM h),
n AS (SELECT *, regexp_extract(head, '^@@ -(\\d*),*?(\\d*?) \\+(\\d*),*?(\\d*?) @@', ['x', 'y', 'a', 'b']) AS s,
        list_filter(string_split(body, chr(10)), lambda l: l <> '') AS lines FROM x)
SELECT doc_id, CAST(hunk AS INTEGER) AS hunk,
  CASE WHEN s.x <> '' AND s.a <> '' THEN TRY_CAST(s.x AS BIGINT) END AS old_start,
  CASE WHEN s.x <> '' AND s.a <> '' THEN TRY_CAST(coalesce(nullif(s.y, ''), '1') AS BIGINT) END AS old_size,
  CASE WHEN s.x <> '' AND s.a <> '' THEN TRY_CAST(s.a AS BIGINT) END AS new_start,
  CASE WHEN s.x <> '' AND s.a <> '' THEN TRY_CAST(coalesce(nullif(s.b, ''), '1') AS BIGINT) END AS new_size,
  md5(coalesce(array_to_string(list_transform(list_filter(lines, lambda l: l[1] IN ('-', ' ')), lambda l: l[2:]), chr(10)), '')) AS before_md5,
  md5(coalesce(array_to_string(list_transform(list_filter(lines, lambda l: l[1] IN ('+', ' ')), lambda l: l[2:]), chr(10)), '')) AS after_md5,
  len(list_filter(lines, lambda l: l[1] NOT IN ('+', '-', ' '))) > 0 AS bad_line
FROM n""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffs(spark, sf_dir).select(
        "doc_id", F.posexplode(patches.parsed(F.col("hunk_text"))).alias("hunk", "h")
    )
    return rows.select(
        "doc_id", "hunk", F.col("h.info.x").alias("old_start"), F.col("h.info.y").alias("old_size"),
        F.col("h.info.a").alias("new_start"), F.col("h.info.b").alias("new_size"),
        digest(F.array_join("h.before", "\n")).alias("before_md5"),
        digest(F.array_join("h.after", "\n")).alias("after_md5"), F.col("h.bad").alias("bad_line"),
    )


# Expected texts by kind. Where the hunk fits, the first line is reversed; the
# second hunk of the last kind only lands behind the end of a short file.
@query(f"""
WITH d AS (SELECT doc_id, text, {_FIRST} AS first, len(string_split(text, chr(10))) AS n FROM documents),
e AS (SELECT doc_id, doc_id % 8 AS kind, text, first, n, first || chr(10) || text AS on_top,
  CASE WHEN first = '' THEN chr(10) || text ELSE reverse(first) || substr(text, length(first) + 1) END AS swapped,
  CASE WHEN first = '' THEN chr(10) || 'added' || chr(10) || text
       ELSE reverse(first) || chr(10) || 'added' || substr(text, length(first) + 1) END AS grown FROM d),
r AS (SELECT doc_id, text,
  CASE kind WHEN 1 THEN text WHEN 6 THEN on_top WHEN 7 THEN grown ELSE swapped END AS patched,
  CASE kind WHEN 1 THEN text WHEN 2 THEN text WHEN 4 THEN text WHEN 6 THEN on_top
    WHEN 7 THEN grown || CASE WHEN n + 1 < 10 THEN chr(10) || first ELSE '' END ELSE swapped END AS by_line FROM e)
SELECT doc_id, md5(patched) AS patched_md5, md5(by_line) AS by_line_md5, patched <> text AS changed FROM r""")
def diff_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patches.apply_diffs(diffs(spark, sf_dir), "text", "hunk_text", "patched")
    rows = patches.apply_diffs(rows, "text", "hunk_text", "by_line", use_line_number=True)
    return rows.select(
        "doc_id", digest(F.col("patched")).alias("patched_md5"),
        digest(F.col("by_line")).alias("by_line_md5"),
        (F.col("patched") != F.col("text")).alias("changed"),
    )


# Expected states by kind: the first line is present, so only numbers decide.
@query(f"""
WITH d AS (SELECT doc_id, text, {_FIRST} AS first, {_FILE} AS file FROM documents),
s AS (SELECT doc_id, CASE
  WHEN doc_id % 16 = 5 THEN 4
  WHEN doc_id % 8 = 6 THEN 0
  WHEN doc_id % 8 = 0 OR doc_id % 8 = 5 THEN 0 + misplaced
  WHEN doc_id % 8 = 1 THEN 1
  WHEN doc_id % 8 = 2 THEN 2 + misplaced
  WHEN doc_id % 8 = 3 THEN 5
  WHEN doc_id % 8 = 4 THEN 6
  ELSE 1 END AS state
  FROM (SELECT *, CASE WHEN length(text) = length(first) OR
          substr(text, instr(text, first) + length(first), 1) IN ('', chr(10)) THEN 0 ELSE 1 END AS misplaced FROM d))
SELECT state, count(*) AS docs FROM s GROUP BY state""")
def diff_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patches.validity(diffs(spark, sf_dir), "diff_text", "state")
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("docs"))


@query(f"""
SELECT doc_id, md5(string_split(regexp_split_to_array(d, '\\n[^ +-@]+')[1], '<NME>')[1]) AS clipped_md5
FROM (SELECT doc_id, {_BODY} || chr(10) || ' kept <NME> cut' AS d FROM documents)""")
def diff_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("hunk_text", F.lit("\n kept <NME> cut"))
    return diffs(spark, sf_dir).select(
        "doc_id", digest(patches.clip(text)).alias("clipped_md5")
    )
