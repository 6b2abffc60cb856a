"""Completion clean-up queries over the conversations as generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import fixed, tasks
from tallymill.functions import completions as c
from tallymill.functions import prompts
from tallymill.functions import text as t
from tallymill.plans import sqlkit as k
from tallymill.plans.registry import BRACED, INDENTED, NL, STATEMENTS, digest, query, table
from tallymill.sources import files

KEYS = ("conv_id", "turn")
QUOTE = '"""'


def generations(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """Turns as completions; ``text`` is the expression that shapes them."""
    return table(spark, sf_dir, "conversations").select(
        *KEYS, "role", F.expr(text).alias("text")
    )


def result(df: DataFrame, **texts: Column) -> DataFrame:
    """Keys with length and digest of each text."""
    staged = df.select(*KEYS, *[text.alias(name) for name, text in texts.items()])
    return staged.select(*KEYS, *[
        column for name in texts for column in (
            F.length(name).cast("long").alias(f"{name}_chars"),
            digest(F.col(name)).alias(f"{name}_md5"),
        )
    ])


def result_sql(source: str, **texts: str) -> str:
    """The checking form of ``result``."""
    inner = ", ".join(f"{sql} AS {name}" for name, sql in texts.items())
    outer = ", ".join(
        f"CAST(length({name}) AS BIGINT) AS {name}_chars, md5({name}) AS {name}_md5"
        for name in texts
    )
    return f"SELECT conv_id, turn, {outer} FROM (SELECT conv_id, turn, {inner} FROM ({source}))"


def shaped(text: str = "text") -> str:
    return f"SELECT conv_id, turn, role, {text} AS text FROM conversations"


PROMPTED = f"SELECT c.conv_id, c.turn, b.text || {STATEMENTS.replace('text', 'c.text')} AS text, b.text AS prompt FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark)"


def on_items(turns: DataFrame, bench: DataFrame) -> DataFrame:
    """Deal the conversations out over all benchmark rows."""
    items = bench.agg(F.count(F.lit(1)).alias("n")).scalar()
    return turns.withColumn("item_id", F.col("conv_id") % items)


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that repeat their prompt, joined to their benchmark row."""
    bench = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "prompt")
    turns = on_items(generations(spark, sf_dir, STATEMENTS), bench)
    joined = turns.join(bench, "item_id")
    return joined.withColumn("text", F.concat("prompt", "text"))


@query(result_sql(PROMPTED, body="substr(text, length(prompt) + 1)"))
def gen_strip_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(
        prompted(spark, sf_dir), body=c.drop_prompt(F.col("text"), F.col("prompt"))
    )


_STOPS = fixed.STOPS["humaneval"]


@query(result_sql(
    f"SELECT conv_id, turn, prompt, substr(text, length(prompt) + 1) AS body FROM ({PROMPTED})",
    cut=k.truncate("body", _STOPS),
    program=f"{k.strip('prompt')} || {k.truncate('body', _STOPS)}",
    listed=k.truncate("body", fixed.STOPS["mbpp"]),
))
def gen_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest stop, from literals and from a stop column, and the program."""
    body = c.drop_prompt(F.col("text"), F.col("prompt"))
    df = prompted(spark, sf_dir).withColumn("body", body).withColumn(
        "stops", F.array(*[F.lit(s) for s in fixed.STOPS["mbpp"]])
    )
    cut = c.truncate(F.col("body"), _STOPS)
    return result(
        df, cut=cut, program=F.concat(t.strip(F.col("prompt")), cut),
        listed=c.truncate(F.col("body"), F.col("stops")),
    )


_PARITY = fixed.STOPS["parity"]


@query(result_sql(
    f"SELECT *, 'def' || text AS s FROM ({shaped(STATEMENTS)})",
    block=k.rstrip(f"({k.truncate('s', _PARITY)})"),
))
def gen_first_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(
        generations(spark, sf_dir, STATEMENTS),
        block=c.first_block(F.col("text"), _PARITY, "def"),
    )


_QUIX = fixed.STOPS["quixbugs"]
_QUIX_RULE = k.q("|".join(s.replace("|", "\\|") for s in _QUIX))


@query(result_sql(
    f"""SELECT *, regexp_extract_all(text, {_QUIX_RULE}) AS hits,
        regexp_split_to_array(text, {_QUIX_RULE}) AS parts FROM ({shaped(STATEMENTS)})""",
    body="CASE WHEN len(hits) = 0 THEN '' ELSE "
         "substr(text, 1, length(text) - length(parts[-1]) - length(hits[-1])) END",
))
def gen_drop_last_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(
        generations(spark, sf_dir, STATEMENTS), body=c.drop_last_block(F.col("text"), _QUIX)
    )


_LATER_LINE = rf"(?s)\A(\n*[^\n]+\n(?:.*?\n)??)[^{k.SPACE_CLASS}]"


@query(result_sql(
    shaped(INDENTED),
    body=f"CASE WHEN regexp_matches(text, {k.q(_LATER_LINE)}) "
         f"THEN regexp_extract(text, {k.q(_LATER_LINE)}, 1) ELSE text END",
))
def gen_cut_at_dedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(
        generations(spark, sf_dir, INDENTED), body=c.cut_at_dedent(F.col("text"))
    )


# Indented python text: a first line in front, dedents as in the text.
_PY_BODY = f"concat('    x = 1{NL}', {INDENTED})"
_GO_STOPS = [*fixed.PACK_STOPS["go"], fixed.END_OF_TEXT]
_PY_STOPS = [*fixed.PACK_STOPS["python"], fixed.END_OF_TEXT]


def _to_last_brace_sql(x: str) -> str:
    return (
        f"CASE WHEN contains({x}, '}}') THEN substr({x}, 1, length({x}) - "
        f"length(string_split({x}, '}}')[-1])) ELSE {x} END"
    )


def _balance_sql(opened: int) -> str:
    """Position of the brace that closes the block, by a running sum."""
    return f"""
SELECT conv_id, turn, min(pos) AS cut FROM (
  SELECT conv_id, turn, sum(length(seg)) OVER w AS pos,
    {opened} + sum(CASE WHEN ends_with(seg, '{{') THEN 1 ELSE -1 END) OVER w AS depth
  FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^{{}}]*[{{}}]')) AS seg,
          unnest(range(len(regexp_extract_all(text, '[^{{}}]*[{{}}]')))) AS i FROM g)
  WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)) WHERE depth = 0 GROUP BY ALL"""


_JAVA_REST = _to_last_brace_sql("text")


@query(f"""
WITH g AS ({shaped(BRACED)}), p AS ({shaped(_PY_BODY)}),
j AS ({_balance_sql(2)}), o AS ({_balance_sql(1)}),
lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS i
          FROM (SELECT conv_id, turn, {k.in_order('text', _PY_STOPS)} AS text FROM p)),
firsts AS (SELECT conv_id, turn, min(i) AS first FROM lines
           WHERE length({k.strip('line')}) > 0 AND line[1] NOT IN (' ', chr(9)) GROUP BY ALL),
py AS (SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY i)
         FILTER (first IS NULL OR i < first), '') AS body
       FROM lines LEFT JOIN firsts USING (conv_id, turn) GROUP BY ALL),
jr AS (SELECT conv_id, turn, cut, text, {_JAVA_REST} AS rest FROM g LEFT JOIN j USING (conv_id, turn))
SELECT conv_id, turn,
  md5(CASE WHEN jr.cut IS NOT NULL THEN substr(jr.text, 1, CAST(jr.cut AS BIGINT))
      WHEN {k.count_of('rest', '{')} - 1 = {k.count_of('rest', '}')} THEN rest || chr(10) || '}}'
      ELSE rest END) AS java_md5,
  md5(CASE WHEN o.cut IS NOT NULL THEN substr(jr.text, 1, CAST(o.cut AS BIGINT)) ELSE rest END) AS cpp_md5,
  md5(py.body) AS python_md5
FROM jr LEFT JOIN o USING (conv_id, turn) JOIN py USING (conv_id, turn)""")
def gen_balance_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    braced = generations(spark, sf_dir, f"struct({BRACED} AS b, {_PY_BODY} AS p)")
    return braced.select(
        *KEYS,
        digest(c.cut_function(text["b"], "java", [fixed.END_OF_TEXT])).alias("java_md5"),
        digest(c.cut_function(text["b"], "cpp", [fixed.END_OF_TEXT])).alias("cpp_md5"),
        digest(c.cut_function(text["p"], "python", _PY_STOPS)).alias("python_md5"),
    )


@query(f"""
SELECT conv_id, turn,
  regexp_matches(braced, '\\n//|\\nfunc main\\(|struct|\\nfunc|<\\|endoftext\\|>')
    OR {k.count_of('braced', '{')} + 1 = {k.count_of('braced', '}')} AS go_done,
  {k.count_of('braced', '{')} + 2 = {k.count_of('braced', '}')} AS java_done,
  len(list_filter(string_split(ptext, chr(10)), lambda x: regexp_matches(x, '^[^ \\t]')
      AND length({k.strip('x')}) > 0)) > 0 AS python_done
FROM (SELECT conv_id, turn, {BRACED} AS braced, {_PY_BODY} AS ptext FROM conversations)""")
def gen_is_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = generations(spark, sf_dir, f"struct({BRACED} AS b, {_PY_BODY} AS p)")
    return rows.select(
        *KEYS, c.is_complete(text["b"], "go", _GO_STOPS).alias("go_done"),
        c.is_complete(text["b"], "java", [fixed.END_OF_TEXT]).alias("java_done"),
        c.is_complete(text["p"], "python", [fixed.END_OF_TEXT]).alias("python_done"),
    )


@query(f"""
SELECT conv_id, turn, length(text) > CAST(floor(length(prompt) * 3) AS BIGINT) AS over_3,
  length(text) > CAST(floor(length(prompt) * 2.25) AS BIGINT) AS over_2_25 FROM ({PROMPTED})""")
def gen_too_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, size = F.col("text"), F.length("prompt")
    return prompted(spark, sf_dir).select(
        *KEYS, c.is_too_long(text, size, 3).alias("over_3"),
        c.is_too_long(text, size, 2.25).alias("over_2_25"),
    )


_MARKED = f"concat(replace(text, '. ', '{NL}ANSWER:'), replace(text, ', ', 'Solution:{NL}'))"


@query(result_sql(
    f"SELECT *, string_split(text, 'Solution:' || chr(10)) AS parts FROM ({shaped(_MARKED)})",
    answer=k.after("text", "\nANSWER:"),
    solution=k.strip(
        "CASE WHEN len(parts) > 4 THEN array_to_string(parts[4:], 'Solution:' || chr(10)) "
        "ELSE parts[-1] END"
    ),
))
def gen_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return result(
        generations(spark, sf_dir, _MARKED), answer=c.answer_section(text),
        solution=c.last_section(text, "Solution:\n", 3),
    )


_MATH = "replace(replace(text, ', ', ' # solution in Python:'), '. ', ' Q: ')"


@query(result_sql(
    f"SELECT *, string_split(text, '# solution in Python:') AS parts FROM ({shaped(_MATH)})",
    program="string_split(" + k.strip(
        "CASE WHEN len(parts) > 10 THEN array_to_string(parts[10:], '# solution in Python:') "
        "ELSE parts[-1] END"
    ) + ", 'Q:')[1] || chr(10) || 'print(solution())'",
))
def gen_math_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(
        generations(spark, sf_dir, _MATH), program=c.math_program(F.col("text"))
    )


_TAGGED = f"replace(replace(concat('# SOLUTION START{NL}', text), ', ', '</code>'), '. ', ' BEGIN SOLUTION{NL}<code> ')"


@query(result_sql(
    shaped(_TAGGED),
    body=k.strip(k.in_order(
        "(" + k.after("(" + k.after("text", "BEGIN SOLUTION\n<code>") + ")", "# SOLUTION START") + ")",
        ["</code>", "# SOLUTION END"],
    )),
))
def gen_between_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(generations(spark, sf_dir, _TAGGED), body=c.between_tags(F.col("text")))


_FENCED = f"replace(replace(text, '. ', ' ```python{NL}'), ', ', ' ``` ')"


@query(result_sql(
    shaped(_FENCED),
    code="CASE WHEN contains(text, '```') "
         "THEN regexp_extract(text, '(?s)```(?:python)?(.*?)(?:```|\\z)', 1) ELSE text END",
))
def gen_fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(generations(spark, sf_dir, _FENCED), code=c.fenced_code(F.col("text")))


# A function called f, its return lines, and a fence in some answers.
_FUNCTION = (
    f"concat(CASE WHEN turn % 3 = 0 THEN 'Here: ```python{NL}' ELSE '' END, "
    f"'import os{NL}def f(x):{NL}    ', {INDENTED}, "
    f"CASE WHEN turn % 2 = 0 THEN '{NL}```{NL}done' ELSE '{NL}end' END)"
)
_INSTRUCT = fixed.STOPS["instruct-humaneval"]
_CONTEXT = "import re\n\ndef f(x):\n"
_WINDOW_FROM = f"""
SELECT conv_id, turn, code, strpos(code, 'def f') AS start, fence FROM (
  SELECT conv_id, turn, {k.truncate('code', _INSTRUCT)} AS code, instr({k.truncate('code', _INSTRUCT)}, '```') AS fence
  FROM (SELECT conv_id, turn, CASE WHEN contains(text, '```')
          THEN regexp_replace({k.after('text', '```')}, '\\Apython', '') ELSE text END AS code
        FROM ({shaped(_FUNCTION)})))"""


@query(result_sql(
    f"""SELECT *, CASE WHEN contains(code[start:], '  return ') THEN
          start + length(code[start:]) - length(string_split(code[start:], '  return ')[-1]) - 9
          ELSE start END AS last FROM (SELECT * REPLACE (greatest(start, 1) AS start) FROM ({_WINDOW_FROM}))""",
    body="""'import re' || chr(10) || substr(code, start, greatest(0, least(
      CASE WHEN instr(code[last:], chr(10)) > 0 THEN last + instr(code[last:], chr(10)) - 1 ELSE length(code) + 1 END,
      CASE WHEN fence > 0 THEN fence ELSE length(code) + 1 END) - start))""",
))
def gen_function_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(
        generations(spark, sf_dir, _FUNCTION),
        body=c.function_window(F.col("text"), F.lit(_CONTEXT), F.lit("f"), _INSTRUCT),
    )


@query(result_sql(
    f"""SELECT *, instr(code, 'def f') AS pos FROM (
          SELECT conv_id, turn, {k.truncate('text', _INSTRUCT)} AS code FROM ({shaped(_FUNCTION)}))""",
    body=f"""CASE WHEN pos = 0 THEN code
      WHEN regexp_matches(code[pos:], {k.q(_LATER_LINE)})
      THEN substr(code, 1, pos - 1) || regexp_extract(code[pos:], {k.q(_LATER_LINE)}, 1)
      ELSE code END""",
))
def gen_definition_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(
        generations(spark, sf_dir, _FUNCTION),
        body=c.definition_body(F.col("text"), F.lit("f"), _INSTRUCT),
    )


# The greeting's apostrophe is set afterwards: a bare quote differs per dialect.
_CHAT = (
    f"concat('ask ### Response:', CASE turn % 3 WHEN 0 THEN concat('Here is ```python{NL}', "
    f"replace(text, '. ', '{NL}'), '``` bye') WHEN 1 THEN concat('Here!s{NL}', text, '# Example usage ', text) "
    f"ELSE concat(text, '{NL}if __name__ == \"__main__\":{NL}  main()</s>', text) END)"
)


@query(f"""
WITH a AS (SELECT conv_id, turn, replace(string_split(string_split(replace(text, 'Here!s', 'Here''s'), '### Response:')[-1], '</s>')[1], chr(9), '    ') AS x FROM ({shaped(_CHAT)})),
b AS (SELECT conv_id, turn, CASE WHEN contains(x, '```python')
  THEN {k.strip("string_split(" + k.strip("replace(substr(x, instr(x, '```python')), '```python', '')") + ", '```')[1]")} ELSE x END AS x FROM a),
d AS (SELECT conv_id, turn, CASE WHEN contains(x, 'if __name__ == "__main__":')
  THEN {k.strip("string_split(x, 'if __name__ == \"__main__\":')[1]")} ELSE x END AS x FROM b),
e AS (SELECT conv_id, turn, CASE WHEN contains(x, '# Example usage')
  THEN {k.strip("string_split(x, '# Example usage')[1]")} ELSE x END AS x FROM d)
SELECT conv_id, turn, CAST(length(y) AS BIGINT) AS code_chars, md5(y) AS code_md5 FROM (
  SELECT conv_id, turn, CASE WHEN starts_with(x, 'Here''s')
    THEN array_to_string(string_split(x, chr(10))[2:], chr(10)) ELSE x END AS y FROM e)""")
def gen_chat_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("Here!s"), F.lit("Here's"))
    return result(generations(spark, sf_dir, _CHAT), code=c.chat_code(text))


@query(f"""
WITH s AS (SELECT conv_id, turn, string_split(text, '. ')[1] AS p, string_split(text, '. ')[-1] AS s, text FROM conversations)
SELECT conv_id, turn,
  md5('<fim_prefix>' || p || '<fim_suffix>' || s || '<fim_middle>') AS star_md5,
  md5('<fim-prefix>' || p || '<fim-suffix>' || s || '<fim-middle>') AS santa_md5,
  md5(p || '<|mask:0|>' || s || '<|mask:0|>') AS coder_md5,
  md5(text) AS middle_md5 FROM s""")
def gen_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infill prompts of the three families; a completion gives its middle back."""
    prefix, suffix = t.before(F.col("text"), ". "), t.after_last(F.col("text"), ". ")
    made = {family: prompts.infill(prefix, suffix, family) for family in fixed.INFILL_MARKS}
    ends = {f: marks[3] for f, marks in fixed.INFILL_MARKS.items()}

    def middle(family: str) -> Column:
        whole = F.concat(made[family], F.col("text"), F.lit("<pad>" + ends[family] + " tail"))
        return c.infill_middle(whole, family, ["<pad>"])

    star, santa, coder = (middle(f) for f in ("starcoder", "santacoder", "incoder"))
    same = F.when((star == santa) & (star == coder), star)
    return generations(spark, sf_dir).select(
        *KEYS, digest(made["starcoder"]).alias("star_md5"),
        digest(made["santacoder"]).alias("santa_md5"), digest(made["incoder"]).alias("coder_md5"),
        digest(same).alias("middle_md5"),
    )


_ASSISTANT = f"replace(replace(text, '. ', '<|assistant|>'), ', ', ' ```python{NL}')"


@query(result_sql(
    shaped(_ASSISTANT),
    plain=k.after("text", "<|assistant|>"), ended=k.after("text", "```"), bare="text",
))
def gen_after_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return result(
        generations(spark, sf_dir, _ASSISTANT),
        plain=c.after_assistant(text, "<|end|>", "<|assistant|>"),
        ended=c.after_assistant(text, "```", ""), bare=c.after_assistant(text, "", ""),
    )


_DOC_SUFFIX = fixed.DOC_SUFFIX["other"]
_DOCUMENTED = f"concat('code', '{_DOC_SUFFIX}', text, '{_DOC_SUFFIX}', text)"
_QUOTED = f"replace(replace(text, '. ', ' \"\"\" '), ' and ', ' {NL} ')"


@query(f"""
WITH g AS ({shaped(_DOCUMENTED)}), h AS (SELECT conv_id, turn, {_QUOTED} AS text FROM conversations),
r AS (SELECT conv_id, turn, text AS whole, CASE WHEN contains(text, '\"\"\"') THEN {k.after('text', '\"\"\"')} ELSE text END AS rest FROM h)
SELECT conv_id, turn, md5(string_split({k.strip(f"string_split(g.text, {k.q(_DOC_SUFFIX)})[2]")}, chr(10))[1]) AS line_md5,
  md5(CASE WHEN contains(whole, '\"\"\"')
    THEN string_split({k.strip(f"string_split({k.strip('rest')}, chr(10))[1]")}, '\"\"\"')[1]
    ELSE {k.strip(f"string_split({k.strip('whole')}, chr(10))[1]")} END) AS left_md5
FROM g JOIN r USING (conv_id, turn)""")
def gen_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generations(spark, sf_dir, f"struct({_DOCUMENTED} AS d, {_QUOTED} AS q)")
    return rows.select(
        *KEYS, digest(c.doc_line(F.col("text")["d"], "java")).alias("line_md5"),
        digest(c.doc_line_left(F.col("text")["q"])).alias("left_md5"),
    )


@query(f"""
WITH s AS (SELECT conv_id, turn, text FROM conversations),
g AS (SELECT conv_id, turn, {k.rstrip(f"substr({k.strip('text || chr(10) || text')}, 1, CAST(length(text) AS BIGINT))")} AS body,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: {k.strip('x')}), lambda x: length(x) > 20) AS leaks FROM s)
SELECT conv_id, turn, md5(CASE WHEN len(leaks) = 0 THEN body ELSE
  list_reduce(leaks, lambda acc, x: replace(acc, x, ''), body) END) AS body_md5 FROM g""")
def gen_remove_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description that repeats solution lines loses the long ones."""
    text = F.col("text")
    body = c.description(
        F.concat(text, F.lit("\n"), text), F.length(text), [fixed.END_OF_TEXT], text
    )
    return generations(spark, sf_dir).select(*KEYS, digest(body).alias("body_md5"))


_COMPACT = "replace(replace(replace(text, '. ', '<block_end>'), ' the ', '<def_stmt>'), ' le ', '@')"


@query(f"""
WITH g AS (SELECT conv_id, turn, {_COMPACT} AS a, {STATEMENTS} AS b FROM conversations),
w AS (SELECT conv_id, turn, b, CASE WHEN contains(a, '<block_end>')
   THEN substr(a, 1, length(a) - length(string_split(a, '<block_end>')[-1])) ELSE a END AS a FROM g)
SELECT conv_id, turn, md5({k.truncate('a', fixed.STOPS['humaneval-compact'])}) AS block_md5,
  md5({k.in_order('b', fixed.COMPACT_STOPS)}) AS program_md5 FROM w""")
def gen_compact_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generations(spark, sf_dir, f"struct({_COMPACT} AS a, {STATEMENTS} AS b)")
    return rows.select(
        *KEYS, digest(c.compact_block(F.col("text")["a"])).alias("block_md5"),
        digest(c.compact_program(F.col("text")["b"])).alias("program_md5"),
    )


_ENTRY = (
    f"concat(text, CASE turn % 4 WHEN 0 THEN '{NL}def sumOfTwo(a):{NL}' WHEN 1 THEN '{NL}def sum_of_two(a):{NL}' "
    f"WHEN 2 THEN '```{NL}def SumOfTwo(a):{NL}  x```' ELSE '' END, text)"
)


@query(f"""
WITH g AS ({shaped(_ENTRY)}),
f AS (SELECT conv_id, turn, CASE WHEN contains(text, '```') THEN string_split(text, '```')[2] ELSE text END AS x FROM g),
n AS (SELECT conv_id, turn, CASE WHEN contains(x, 'SumOfTwo') THEN string_split(x, 'SumOfTwo')[-1]
   WHEN contains(x, 'sum_of_two') THEN string_split(x, 'sum_of_two')[-1]
   WHEN contains(x, 'sumOfTwo') THEN string_split(x, 'sumOfTwo')[-1] END AS x FROM f)
SELECT conv_id, turn, md5(CASE WHEN contains(x, chr(10)) THEN substr(x, instr(x, chr(10)) + 1)
  WHEN x IS NOT NULL THEN '' END) AS body_md5, x IS NULL AS failed FROM n""")
def gen_entry_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = c.body_after_entry(F.col("text"), F.lit("SumOfTwo"))
    return generations(spark, sf_dir, _ENTRY).select(
        *KEYS, digest(body).alias("body_md5"), body.isNull().alias("failed")
    )


_PROGRAM = f"concat(replace(text, '. ', '{NL}int main() '), 'public class Main {{{NL}    }}', text)"
_LANGUAGE = "CASE turn % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' ELSE 'java' END"


@query(result_sql(
    f"SELECT *, {_LANGUAGE} AS language FROM ({shaped(_PROGRAM)})",
    program="CASE language WHEN 'python' THEN "
    + k.strip(f"({k.q(chr(10).join(fixed.PYTHON_IMPORTS) + chr(10))} || text)")
    + " WHEN 'cpp' THEN "
    + k.strip(f"({k.q(chr(10).join(fixed.CPP_IMPORTS) + chr(10))} || {k.before('text', 'int main')})")
    + " ELSE " + k.strip(f"replace(text, {k.q('public class Main {' + chr(10) + '    }')}, '')") + " END",
))
def program_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generations(spark, sf_dir, _PROGRAM).withColumn("language", F.expr(_LANGUAGE))
    none = F.lit("")
    return result(rows, program=c.program_for(
        F.col("language"), F.col("text"), setup=none, reference=none, declaration=none
    ))


_GO = f"concat('package main{NL}// strings.ToUpper(x){NL}', replace(text, ', ', ' fmt.Println(x){NL}'))"
_GO_SETUP = f"concat('package main{NL}import ({NL}    \"math\"{NL}    \"fmt\"{NL}){NL}', role)"


def _go_import_sql() -> str:
    """Import lines of the packages used outside comment lines but not quoted."""
    cases = []
    for package in fixed.GO_PACKAGES:
        name = package.rsplit("/", 1)[-1]
        cases.append(
            f"CASE WHEN NOT contains(whole, {k.q(chr(34) + package + chr(34))}) AND "
            f"len(list_filter(string_split(whole, chr(10)), lambda l: contains(l, {k.q(name + '.')}) "
            f"AND NOT starts_with({k.strip('l')}, '//'))) > 0 THEN {k.q('    ' + chr(34) + name + chr(34))} END"
        )
    return f"list_filter([{', '.join(cases)}], lambda p: p IS NOT NULL)"


@query(result_sql(
    f"""SELECT *, {_go_import_sql()} AS used FROM (
          SELECT *, setup || text || chr(10) || 'sort.Ints(x)' AS whole FROM (
            SELECT conv_id, turn, {_GO} AS text, {_GO_SETUP} || chr(10) AS setup FROM conversations))""",
    program="setup || CASE WHEN len(used) > 0 THEN 'import (' || chr(10) || array_to_string(used, chr(10)) "
            "|| chr(10) || ')' || chr(10) ELSE '' END || replace(text, 'package main', '')",
))
def program_assemble_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        *KEYS, F.expr(_GO).alias("text"), F.expr(_GO_SETUP).alias("setup")
    )
    return result(rows, program=c.program(
        F.col("text"), "go", setup=F.col("setup"), reference=F.lit("sort.Ints(x)")
    ))


_RUST = f"concat('fn f(x: i32) {{{NL}', replace(text, '. ', '{NL}fn main() {{}}{NL}'))"


@query(result_sql(
    f"SELECT *, string_split(text, 'fn main()') AS parts FROM ({shaped(_RUST)})",
    program="CASE WHEN len(parts) = 1 THEN 'fn main(){}' || chr(10) ELSE '' END || "
            "CASE WHEN contains(text, 'use std::io;') THEN '' ELSE 'use std::io;' || chr(10) END || "
            "CASE WHEN contains(text, 'fn g') THEN '' ELSE 'fn g() {' || chr(10) END || "
            "array_to_string(parts[1:2], 'fn main()')",
))
def program_assemble_rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    declaration = F.lit("use std::io;\nfn f(x: i32) -> i32 {\nfn g() {\n")
    return result(
        generations(spark, sf_dir, _RUST),
        program=c.program(F.col("text"), "rust", declaration=declaration),
    )


#: What a model wrote: indented lines, statements at line starts, and the marks that families cut at.
_TAIL = (
    f"concat(' s{NL}    ', {INDENTED.replace('text', STATEMENTS)}, "
    f"'{NL}if c <block_end> Q: x </code> {QUOTE} y # Example usage z')"
)
_CORRECT = "def f(x):\n    return x + 1"
_RUN_COLUMNS = {
    "test_list": ["assert f(1) == 2"], "question": "Q?", "starter_code": "", "input_output": "{}",
    "stop_tokens": list(fixed.MULTI_STOPS), "declaration": "def f(x):\n", "buggy_solution": "  return x\n",
    "test": "assert f(1)", "entry_point": "f", "docstring": "Adds one to a number, whatever it is.",
    "canonical_solution": "  return x + 1\n", "instruction": "Write f.", "context": _CONTEXT, "bugs": 2,
    "prompt_code": "def g(): pass", "task": "bin-op", "correct_code": _CORRECT,
    "name": "gcd", "buggy_program": "def gcd(): pass", "intent": "do it", "rewritten_intent": "do this",
    "nl": "get x. concode_field_sep y", "source": "hej",
    "code": 'def f(x):\n  """Adds one to a number, whatever it is."""\n  return x',
}
_RUN_SHOTS = {
    "questions": [f"q{i}" for i in range(8)], "solutions": [f"    return {i}" for i in range(8)],
    "instruction1": "a", "solution1": "b", "instruction2": "c", "solution2": "d",
    "danish": {"source1": "a", "target1": "b", "source2": "c", "target2": "d"},
}
_QUOTED_TAIL = f"string_split({k.strip('tail')}, chr(10))[1]"
_FIRST_UNINDENTED = r"(?s)\A((?:.*?\n)??)[^ \t\n]"
#: Each task of the run with its clean text in SQL, from the tail behind the prompt: one per family and shape.
_RUN_SQL = {
    "humaneval": f"{k.strip('prompt')} || {k.truncate('tail', fixed.STOPS['humaneval'])}",
    "humaneval-unstripped": f"prompt || {k.truncate('tail', fixed.STOPS['humaneval'])}",
    "humaneval-compact": k.in_order(
        f"({k.rewritten(k.strip('prompt'))} || {k.truncate('block', fixed.STOPS['humaneval-compact'])})",
        fixed.COMPACT_STOPS),
    "mbpp": "QQQ || chr(10) || prompt || chr(10) || 'assert f(1) == 2' || chr(10) || QQQ || chr(10) || ".replace(
        "QQQ", k.q(QUOTE)) + k.truncate("tail", fixed.STOPS["mbpp"]),
    "apps-interview": "chr(10) || tail",
    "multiple-py": f"{k.strip('prompt')} || {k.truncate('tail', fixed.MULTI_STOPS)}",
    "perturbed-humaneval-format-num_seeds_1":
        f"{k.strip('prompt')} || {k.truncate('tail', fixed.STOPS['perturbed-humaneval'])}",
    "ds1000-numpy-completion": k.strip(k.in_order("(prompt || tail)", ["</code>", "# SOLUTION END"])),
    "ds1000-numpy-insertion": k.strip(k.in_order("tail", ["</code>", "# SOLUTION END"])),
    "humanevalfixtests-python": "'def f(x):' || body",
    "humanevalsynthesize-python": f"{k.rstrip('prompt')} || body",
    "humanevalexplaindescribe-python": k.rstrip(k.in_order(f"substr({k.strip('tail')}, 1, 37)", _PY_STOPS)),
    "instruct-humaneval": f"""CASE WHEN instr(asked, 'def f') = 0 THEN asked
      WHEN regexp_matches(asked[instr(asked, 'def f'):], {k.q(_LATER_LINE)})
      THEN substr(asked, 1, instr(asked, 'def f') - 1) || regexp_extract(asked[instr(asked, 'def f'):], {k.q(_LATER_LINE)}, 1)
      ELSE asked END""",
    "instruct_wizard_humaneval": k.strip(k.before("replace(tail, chr(9), '    ')", "# Example usage")),
    "parity": k.rstrip(f"({k.truncate('defined', fixed.STOPS['parity'])})"),
    "python_bugs": "substr(defined, 1, 26)",
    "quixbugs": f"""CASE WHEN len(regexp_extract_all(defined, {_QUIX_RULE})) = 0 THEN '' ELSE
      substr(defined, 1, length(defined) - length(regexp_split_to_array(defined, {_QUIX_RULE})[-1])
        - length(regexp_extract_all(defined, {_QUIX_RULE})[-1])) END""",
    "pal-gsm8k-greedy": f"{k.before(k.strip('tail'), 'Q:')} || chr(10) || 'print(solution())'",
    "conala": k.strip("tail"), "concode": k.strip("tail"), "codexglue_text_to_text-da_en": k.strip("tail"),
    "codexglue_code_to_text-java": _QUOTED_TAIL,
    "codexglue_code_to_text-python-left": k.before(k.strip(_QUOTED_TAIL), QUOTE),
}
_RUN = tuple(_RUN_SQL)
_RUN_LIST = "[" + ", ".join(k.q(name) for name in _RUN) + "]"


@query(f"""
WITH g AS (SELECT conv_id, turn, {_RUN_LIST}[(conv_id * 7 + turn) % {len(_RUN)} + 1] AS task,
    {_TAIL.replace('text', 'c.text')} AS tail, b.text AS prompt
  FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark)),
h AS (SELECT *, 'def' || tail AS defined, {k.in_order(k.rstrip('tail'), _PY_STOPS)} AS whole,
    CASE WHEN contains(tail, '<block_end>')
      THEN substr(tail, 1, length(tail) - length(string_split(tail, '<block_end>')[-1])) ELSE tail END AS block,
    'Write f.' || chr(10) || {k.q(_CONTEXT)} || tail AS told FROM g),
x AS (SELECT *, {k.truncate('told', _INSTRUCT)} AS asked,
    CASE WHEN regexp_matches(whole, {k.q(_FIRST_UNINDENTED)})
      THEN regexp_extract(whole, {k.q(_FIRST_UNINDENTED)}, 1)[:-2] ELSE whole END AS body FROM h)
SELECT conv_id, turn, task, md5(CASE task
  {' '.join(f"WHEN {k.q(name)} THEN {sql}" for name, sql in _RUN_SQL.items())} END) AS clean_md5 FROM x""")
def task_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of every family, each made behind its own prompt and cleaned by its own spec."""
    names = F.array(*[F.lit(name) for name in _RUN])
    turns = generations(spark, sf_dir, _TAIL).withColumnRenamed("text", "tail").withColumn(
        "run", F.get(names, ((F.col("conv_id") * 7 + F.col("turn")) % len(_RUN)).cast("int"))
    )
    turns = on_items(turns, table(spark, sf_dir, "benchmark"))

    def constant(value) -> Column:
        return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)

    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    joined = turns.join(bench, "item_id").select(
        *KEYS, "run", "tail", "text", F.col("text").alias("prompt"),
        *[constant(value).alias(name) for name, value in _RUN_COLUMNS.items()],
    )
    prompt, clean = F.lit("").cast("string"), F.lit(None).cast("string")
    for name in _RUN:
        task = tasks.spec(name, shots=_RUN_SHOTS)
        if not name.endswith("-insertion"):  # its prompt is two texts around the answer
            prompt = F.when(F.col("run") == name, task.prompt()).otherwise(prompt)
        clean = F.when(F.col("run") == name, task.clean(F.col("made"))).otherwise(clean)
    made = joined.withColumn("made", F.concat(prompt, "tail"))
    return made.select(*KEYS, F.col("run").alias("task"), digest(clean).alias("clean_md5"))


@query("""
WITH t AS (SELECT conv_id, turn, unnest([0, 0, 2]) AS problem_idx, unnest([0, 1, 0]) AS sample_idx,
             unnest([text, role, role]) AS body FROM conversations)
SELECT conv_id, turn, problem_idx::BIGINT AS problem_idx, sample_idx::INTEGER AS sample_idx, md5(body) AS body_md5 FROM t""")
def generations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a nested file of three problems, the second without samples, read in byte ranges of four cuts."""
    rows = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    nested = F.to_json(F.array(F.array("text", "role"), none, F.array("role")))
    segments = rows.select(
        F.concat("conv_id", F.lit(":"), "turn").alias("file"), F.posexplode(F.split(nested, '"', -1)).alias("place", "value")
    ).withColumn("block", F.floor(F.col("place") / 4))
    texts = files.nested_texts(segments)
    return texts.select(
        F.split("file", ":")[0].cast("long").alias("conv_id"), F.split("file", ":")[1].cast("long").alias("turn"),
        "problem_idx", "sample_idx", digest(F.col("text")).alias("body_md5"))
