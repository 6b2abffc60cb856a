"""Prompt and reference queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import prompts as p
from tallymill.functions import text as t
from tallymill.functions import tokens as tok
from tallymill.operators import selection
from tallymill.operators.numbering import number_rows
from tallymill.plans import sqlkit as k
from tallymill.plans.corpus import documents
from tallymill.plans.packing import PROBLEMS_SQL, problems
from tallymill.plans.registry import NL, digest, query, table


@query(f"""
SELECT doc_id, md5({k.strip("chr(10) || '  ' || text || ' ' || chr(9)")}) AS stripped_md5,
  md5(chr(10) || '  ' || text || ' ' || chr(9)) AS raw_md5 FROM documents""")
def prompt_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("\n  "), F.col("text"), F.lit(" \t"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(p.plain(text)).alias("stripped_md5"),
        digest(p.plain(text, stripped=False)).alias("raw_md5"),
    )


@query("""
SELECT doc_id, md5('\"\"\"' || chr(10) || source || chr(10) || string_split(text, chr(10))[1]
  || chr(10) || '\"\"\"' || chr(10)) AS prompt_md5 FROM documents""")
def prompt_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(p.docstring_with_test(F.col("source"), t.lines(F.col("text"))))
        .alias("prompt_md5"),
    )


@query(f"""
SELECT doc_id, chr(10) || 'QUESTION:' || chr(10) || question || starter_code || chr(10) || 'Use '
  || kind || ' format' || chr(10) || 'ANSWER:' || chr(10) AS prompt FROM ({PROBLEMS_SQL})""")
def prompt_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = p.question(F.col("question"), F.col("starter_code"), F.col("input_output"))
    return problems(spark, sf_dir).select("doc_id", made.alias("prompt"))


def shots(spark: SparkSession, sf_dir: str, count: int) -> Column:
    """Texts of the first worked examples as one array, from a subquery of one row."""
    first = table(spark, sf_dir, "benchmark").select("item_id", "text").orderBy("item_id").limit(count)
    listed = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    return first.agg(F.transform(listed, lambda shot: shot["text"]).alias("seen")).scalar()


NLQ = "chr(10)"
_GAP = "repeat(' ', 19)"
_MATH_TAIL = f"chr(10) || chr(10) || '{fixed.MATH_MARK}' || chr(10) || chr(10) || chr(10)"


def _two_shot_sql(entry: str, ask: str, answer: str) -> str:
    pieces = [k.q(entry)]
    for slot in ("s1", "s3"):
        pieces += [f"{NLQ} || '{ask}:' || {NLQ} || {slot} || {_GAP}",
                   f"{NLQ} || '{answer}:' || {NLQ} || {'s2' if slot == 's1' else 's4'} || {_GAP}"]
    pieces.append(f"{NLQ} || '{ask}:' || {NLQ} || text || {_GAP} || {NLQ} || '{answer}:' || {NLQ}")
    return " || ".join(pieces)


@query(f"""
WITH s AS (SELECT list(text ORDER BY item_id) AS l FROM benchmark WHERE item_id < 8),
b AS (SELECT d.doc_id, d.text, l[1] AS s1, l[2] AS s2, l[3] AS s3, l[4] AS s4, l FROM documents d, s)
SELECT doc_id, md5({_two_shot_sql(fixed.CONALA_ENTRY, 'Instruction', 'Solution')}) AS intent_md5,
  md5({_two_shot_sql(fixed.CONCODE_ENTRY, 'Instruction', 'Solution')}) AS code_md5,
  md5({_two_shot_sql('Translate the following documentation from Danish to English:' + NL, 'Danish', 'English')}) AS translate_md5,
  md5(array_to_string(list_transform(l, lambda x: 'Q: ' || x || chr(10) || chr(10) || '{fixed.MATH_MARK}'
    || chr(10) || chr(10) || chr(10) || 'def solution():' || chr(10) || '    \"\"\"' || x || '\"\"\"' || chr(10)
    || x || repeat(chr(10), 6)), '') || 'Q: ' || text || {_MATH_TAIL}) AS math_md5
FROM b""")
def prompt_fewshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, text = F.col("seen"), F.col("text")
    pair = F.struct(*[
        F.get(seen, F.lit(at)).alias(name) for at, name in enumerate(["ask1", "answer1", "ask2", "answer2"])])
    conala = p.two_shot_from(pair, text, fixed.CONALA_ENTRY, "Instruction", "Solution")
    concode = p.two_shot_from(pair, text, fixed.CONCODE_ENTRY, "Instruction", "Solution")
    language = fixed.TRANSLATION_LANGUAGES["da_en"].title()
    entry = f"Translate the following documentation from {language} to English:\n"
    return documents(spark, sf_dir).withColumn("seen", shots(spark, sf_dir, 8)).select(
        "doc_id", digest(p.require_marks(conala, "Solution:\n", 3)).alias("intent_md5"),
        digest(p.require_marks(concode, "Solution:\n", 3)).alias("code_md5"),
        digest(p.two_shot_from(pair, text, entry, language, "English")).alias("translate_md5"),
        digest(p.math_shots(text, seen, seen)).alias("math_md5"),
    )


@query(f"""
SELECT doc_id, md5({k.strip('text')} || chr(10)) AS prefix_md5,
  md5(chr(10) || {k.strip("source || ' ' || text")} || chr(10)) AS suffix_md5 FROM documents""")
def prompt_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat("text", F.lit("\n[insert] "), "source", F.lit(" "), "text")
    parts = p.insertion(prompt)
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(parts["prefix"]).alias("prefix_md5"),
        digest(parts["suffix"]).alias("suffix_md5"),
    )


@query("""
SELECT doc_id, md5('>> <user>' || text || '</s><bot>' || source) AS marked_md5,
  md5(text || chr(10) || source) AS plain_md5, 3 AS n_stops FROM documents""")
def prompt_instruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    option = "<user>,</s>,<bot>"
    text, context = F.col("text"), F.col("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest(p.instruct(text, context, option, ">> ")).alias("marked_md5"),
        digest(p.instruct(text, context)).alias("plain_md5"),
        F.lit(len(p.instruction_stops(option))).alias("n_stops"),
    )


def _render_sql(template: str, **parts: str) -> str:
    out, rest = [], template
    while "{" in rest:
        literal, rest = rest.split("{", 1)
        slot, rest = rest.split("}", 1)
        out += [k.q(literal), parts[slot]] if literal else [parts[slot]]
    return " || ".join([*out, k.q(rest)])


def _template_checks() -> dict[str, str]:
    """Checking SQL of every template, over a document's text, source and lang."""
    out: dict[str, str] = {}
    for style, template in fixed.ANSWER_TEMPLATES.items():
        first = style in fixed.CONTEXT_FIRST
        inp = "(lang || chr(10) || source)" if first else "(source || chr(10) || lang)"
        sql = _render_sql(template, inp=inp, inp_stripped=inp, base="text")
        out[f"answer:{style}"] = k.strip(f"({sql})")
    ask = "('Fix bugs in ' || source || '.')"
    for style, template in fixed.FIX_TEMPLATES.items():
        sql = _render_sql(
            template, file="(source || '.rs')", context="(lang || text || chr(10) || source)",
            instruction=ask, base="lang",
        )
        out[f"fix:{style}"] = k.strip(f"({sql})")
    sql = _render_sql(
        fixed.ANSWER_TEMPLATES["octocoder"], inp=f"({ask} || chr(10) || lang || text)", base="lang"
    )
    out["fix:octocoder"] = k.strip(f"({sql})")
    describe = (
        "('Provide a concise natural language description of the code using at most ' "
        "|| length(source) || ' characters.')"
    )
    out["describe:instruct"] = k.strip(
        f"(text || chr(10) || {describe} || chr(10) || chr(10))"
    )
    sql = _render_sql(
        fixed.ANSWER_TEMPLATES["wizardcoder"], base="lang",
        inp="('Write functional code in C++ according to the description.' || chr(10) || text)",
    )
    out["synthesize:wizardcoder"] = k.strip(f"({sql})")
    for style, template in fixed.MUTATION_TEMPLATES.items():
        out[f"mutation:{style}"] = _render_sql(template, task="'parity'", code="text")
    for style, template in fixed.PROGRAM_TEMPLATES.items():
        sql = _render_sql(template, code="text", name="source")
        out[f"program:{style}"] = sql if style == "edit-openai" else k.strip(f"({sql})")
    for style, template in fixed.BUG_TEMPLATES.items():
        words = fixed.BUG_INSTRUCTIONS[style]
        asked = (
            f"(CASE WHEN lang = 'en' THEN {k.q(words['bin-op'])} "
            f"ELSE {k.q(words['var-misuse'])} END)"
        )
        out[f"bug:{style}"] = _render_sql(template, code="text", instruction=asked)
    out["script"] = _render_sql(fixed.SCRIPT_TEMPLATE, inp="replace(text, '    ', chr(9))")
    return out


def _template_columns() -> dict[str, Column]:
    text, name, lang = F.col("text"), F.col("source"), F.col("lang")
    out: dict[str, Column] = {}
    for style in fixed.ANSWER_TEMPLATES:
        context = () if style == "continue" else (lang,)
        out[f"answer:{style}"] = p.answer_prompt(style, text, name, *context)
    for style in fixed.FIX_TEMPLATES:
        out[f"fix:{style}"] = p.fix_prompt(style, "rust", lang, text, name, tests=name)
    out["fix:octocoder"] = p.fix_prompt("octocoder", "python", lang, text, name)
    out["describe:instruct"] = p.describe_prompt("instruct", text, name)
    out["synthesize:wizardcoder"] = p.synthesize_prompt("wizardcoder", "cpp", lang, text)
    for style in fixed.MUTATION_TEMPLATES:
        out[f"mutation:{style}"] = p.mutation(style, text)
    for style in fixed.PROGRAM_TEMPLATES:
        out[f"program:{style}"] = p.program_fix(style, text, name)
    kind = F.when(lang == "en", "bin-op").otherwise("var-misuse")
    for style in fixed.BUG_TEMPLATES:
        out[f"bug:{style}"] = p.bug_fix(style, text, kind)
    out["script"] = p.script(text)
    return out


@query(" UNION ALL ".join(
    f"SELECT doc_id, {k.q(name)} AS template, md5({sql}) AS prompt_md5 FROM documents"
    for name, sql in _template_checks().items()
))
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All templates of every document from one scan."""
    made = F.explode(F.array(*[
        F.struct(F.lit(name).alias("template"), digest(column).alias("prompt_md5"))
        for name, column in _template_columns().items()
    ])).alias("m")
    return documents(spark, sf_dir).select("doc_id", made).select("doc_id", "m.*")


# A function whose first line of text is its docstring, in three quote styles.
_TRIPLE, _SINGLE = "repeat(chr(34), 3)", "repeat(chr(39), 3)"
_CODE = (
    f"concat('def f(x):{NL}    ', CASE doc_id % 3 WHEN 0 THEN {_TRIPLE} "
    f"WHEN 1 THEN concat('r', chr(39)) ELSE {_SINGLE} END, split_part(text, '{NL}', 1), "
    f"CASE doc_id % 3 WHEN 0 THEN {_TRIPLE} WHEN 1 THEN chr(39) ELSE {_SINGLE} END, "
    f"'{NL}    return x{NL}')"
)


@query(f"""
WITH s AS (SELECT doc_id, split_part(text, chr(10), 1) AS doc, {_CODE} AS code FROM documents),
h AS (SELECT *, substr(code, 1, instr(code, doc) - 1) AS pre,
  replace(replace(substr(code, instr(code, doc) + length(doc)), {_TRIPLE}, ''), {_SINGLE}, '') AS tail
  FROM s WHERE doc <> ''),
l AS (SELECT *, CASE WHEN contains(pre, {_TRIPLE}) THEN string_split(pre, {_TRIPLE})[1]
  WHEN contains(pre, {_SINGLE}) THEN string_split(pre, {_SINGLE})[1]
  WHEN ends_with(pre, 'r' || chr(39)) THEN substr(pre, 1, length(pre) - 2) ELSE pre END AS head FROM h)
SELECT doc_id, md5({k.strip('head')} || tail || {k.q(fixed.DOC_SUFFIX['python'])}) AS python_md5,
  md5(code || {k.q(fixed.DOC_SUFFIX['ruby'])}) AS ruby_md5,
  md5(code || {k.q(fixed.DOC_SUFFIX['other'])}) AS java_md5,
  md5(head || {_TRIPLE}) AS left_md5 FROM l""")
def prompt_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-to-text prompts: the docstring goes, the opener is added."""
    staged = table(spark, sf_dir, "documents").select(
        "doc_id", t.first_line(F.col("text")).alias("doc"), F.expr(_CODE).alias("code")
    ).where(F.col("doc") != "")
    return staged.select("doc_id", *[
        digest(p.code_to_text(language, F.col("code"), F.col("doc"))).alias(f"{language}_md5")
        for language in ("python", "ruby", "java")
    ], digest(p.code_to_text_left(F.col("code"), F.col("doc"))).alias("left_md5"))


@query(f"""
SELECT doc_id, md5(chr(10) || text || chr(10) || 'check(' || source || ')') AS check_md5,
  md5(array_to_string(string_split(text, '. '), chr(10))) AS tests_md5,
  md5(source || text) AS solution_md5,
  md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(
    array_to_string(w, ' '), '^r', ''), '[{k.SPACE_CLASS}]+'), lambda x: x <> ''), ' ')) AS doc_md5
FROM (SELECT *, {k.words('text')} AS w FROM documents)""")
def reference_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, name = F.col("text"), F.col("source")
    return documents(spark, sf_dir).select(
        "doc_id", digest(p.check_call(text, name)).alias("check_md5"),
        digest(p.joined_tests(F.split(text, t.quoted(". "), -1))).alias("tests_md5"),
        digest(p.canonical(name, text)).alias("solution_md5"),
        digest(p.doc_reference(tok.words(text))).alias("doc_md5"),
    )


_ANSWER = (
    "concat(event_type, ' #### ', props, ' #### ', CASE event_id % 9 "
    "WHEN 0 THEN concat('1,', CAST(user_id AS STRING)) WHEN 1 THEN '1_000' WHEN 2 THEN 'nan' "
    "WHEN 3 THEN '1d' WHEN 4 THEN concat(' ', CAST(user_id AS STRING), ' ') WHEN 5 THEN '-1.5e3' "
    "WHEN 6 THEN event_type WHEN 7 THEN '' ELSE concat(CAST(user_id AS STRING), '.25') END)"
)
_NUMBER_RULE = k.q(
    "(?i)^[+-]?(([0-9][0-9_]*(\\.[0-9_]*)?|\\.[0-9][0-9_]*)(e[+-]?[0-9_]+)?|nan|inf|infinity)$"
)


@query(f"""
WITH a AS (SELECT event_id, {k.strip(f"string_split({_ANSWER.replace('STRING', 'VARCHAR')}, '#### ')[-1]")} AS raw FROM events),
b AS (SELECT event_id, raw, {k.strip("replace(raw, ',', '')")} AS bare FROM a),
v AS (SELECT event_id, raw, bare, CASE WHEN regexp_matches(bare, {_NUMBER_RULE})
  AND NOT regexp_matches(bare, '__|_$|^_|[^0-9]_|_[^0-9]')
  THEN TRY_CAST(replace(bare, '_', '') AS DOUBLE) END AS value FROM b)
SELECT event_id, CASE WHEN value IS NULL THEN raw ELSE bare END AS text, value,
  CASE WHEN value IS NULL THEN 'text' WHEN regexp_matches(bare, '^[+-]?[0-9][0-9_]*$') THEN 'int'
       ELSE 'float' END AS kind FROM v""")
def numeric_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = p.numeric_target(F.expr(_ANSWER)).alias("n")
    return table(spark, sf_dir, "events").select("event_id", made).select("event_id", "n.*")


@query("""
WITH d AS (SELECT conv_id AS item_id, turn, text FROM conversations)
SELECT d.item_id, CAST(row_number() OVER (PARTITION BY d.item_id ORDER BY d.turn) - 1 AS INTEGER) AS candidate,
  md5(d.text) AS description_md5, md5(b.text) AS problem_md5
FROM d JOIN benchmark b ON b.item_id = d.item_id""")
def explode_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems once per description; turns are numbered as candidates."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("item_id"), "turn", F.col("text").alias("description")
    )
    listed = number_rows(turns, "turn", into="place", groups=["item_id"])
    rows = selection.explode_descriptions(listed, table(spark, sf_dir, "benchmark"), "item_id")
    return rows.select(
        "item_id", (F.col("place") - 1).cast("int").alias("candidate"),
        digest(F.col("description")).alias("description_md5"),
        digest(F.col("text")).alias("problem_md5"),
    )
