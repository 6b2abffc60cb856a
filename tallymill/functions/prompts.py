"""Prompt and reference builders over benchmark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import text as t


def render(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a template with columns."""
    out, rest = [], template
    while "{" in rest:
        literal, rest = rest.split("{", 1)
        slot, rest = rest.split("}", 1)
        out += [F.lit(literal), parts[slot]] if literal else [parts[slot]]
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out)


def plain(prompt: Column, stripped: bool = True) -> Column:
    return t.strip(prompt) if stripped else prompt


def docstring_with_test(text: Column, tests: Column) -> Column:
    return F.concat(
        F.lit('"""\n'), text, F.lit("\n"), F.get(tests, F.lit(0)), F.lit('\n"""\n')
    )


def function_name(input_output: Column) -> Column:
    """Function name inside a JSON text; null when absent or malformed."""
    parsed = F.from_json(input_output, "fn_name string")
    return F.nullif(parsed["fn_name"], F.lit(""))


def call_format(input_output: Column) -> Column:
    return F.when(
        function_name(input_output).isNull(), F.lit(fixed.STANDARD_INPUT)
    ).otherwise(F.lit(fixed.CALL_BASED))


def question(text: Column, starter: Column, input_output: Column) -> Column:
    return F.concat(
        F.lit(fixed.QUESTION_MARK), text, F.coalesce(starter, F.lit("")),
        call_format(input_output), F.lit(fixed.ANSWER_MARK),
    )


def two_shot(text: Column, shots: dict[str, str], entry: str, ask: str, answer: str) -> Column:
    """Two worked examples, then the text; keys are (asked, answered) twice."""
    gap = fixed.SHOT_GAP
    (ask1, answer1), (ask2, answer2) = shots["first"], shots["second"]
    head = (
        f"{entry}\n{ask}:\n{ask1}{gap}\n{answer}:\n{answer1}{gap}"
        f"\n{ask}:\n{ask2}{gap}\n{answer}:\n{answer2}{gap}\n{ask}:\n"
    )
    return F.concat(F.lit(head), text, F.lit(f"{gap}\n{answer}:\n"))


def two_shot_from(examples: Column, text: Column, entry: str, ask: str, answer: str) -> Column:
    """``two_shot`` with the examples in a struct of four texts."""
    gap = F.lit(fixed.SHOT_GAP)
    asked, answered = F.lit(f"\n{ask}:\n"), F.lit(f"\n{answer}:\n")
    return F.concat(
        F.lit(entry),
        asked, examples["ask1"], gap, answered, examples["answer1"], gap,
        asked, examples["ask2"], gap, answered, examples["answer2"], gap,
        asked, text, gap, answered,
    )


def require_marks(prompt: Column, mark: str, count: int) -> Column:
    """The prompt, or an error when a mark does not occur ``count`` times."""
    return F.when(t.count_of(prompt, mark) == count, prompt).otherwise(
        F.raise_error(F.lit(f"prompt must hold {count} marks"))
    )


def math_shots(text: Column, questions: Column, solutions: Column) -> Column:
    """Up to eight worked questions, then the text."""
    shots = F.slice(F.arrays_zip(questions.alias("q"), solutions.alias("s")), 1, fixed.MATH_SHOTS)
    shown = F.transform(
        shots,
        lambda shot: F.concat(
            F.lit("Q: "), shot["q"],
            F.lit(f'\n\n{fixed.MATH_MARK}\n\n\ndef solution():\n    """'),
            shot["q"], F.lit('"""\n'), shot["s"], F.lit("\n\n\n\n\n\n"),
        ),
    )
    return F.concat(
        F.array_join(shown, ""), F.lit("Q: "), text, F.lit(f"\n\n{fixed.MATH_MARK}\n\n\n")
    )


def intent(rewritten: Column, original: Column) -> Column:
    return t.strip(t.first_filled(rewritten, original))


def first_field(text: Column, separator: str = "concode_field_sep") -> Column:
    """First field, stripped, without one trailing period."""
    field = t.strip(t.before(text, separator))
    short = t.strip(F.left(field, F.length(field) - 1))
    return F.when(F.endswith(field, F.lit(".")), short).otherwise(field)


def insertion(prompt: Column, mark: str = "[insert]") -> Column:
    """Prefix and suffix around the insertion mark."""
    return F.struct(
        F.concat(t.strip(t.before(prompt, mark)), F.lit("\n")).alias("prefix"),
        F.concat(F.lit("\n"), t.strip(t.after(prompt, mark)), F.lit("\n")).alias("suffix"),
    )


def infill(prefix: Column, suffix: Column, family: str, preprefix: str = "") -> Column:
    if family not in fixed.INFILL_MARKS:
        raise ValueError(f"no infill marks for {family}")
    start, to_suffix, to_middle, _ = fixed.INFILL_MARKS[family]
    return F.concat(
        F.lit(start + preprefix), prefix, F.lit(to_suffix), suffix, F.lit(to_middle)
    )


def instruction_tokens(option: str | None) -> tuple[str, str, str]:
    """User, end and assistant tokens from a comma-separated option."""
    if not option:
        return "", "", "\n"
    tokens = option.split(",")
    if len(tokens) != 3:
        raise ValueError("instruction tokens must be three, separated by commas")
    return tokens[0], tokens[1], tokens[2]


def instruction_stops(option: str | None) -> list[str]:
    return [token for token in instruction_tokens(option) if option and token.strip()]


def instruct(text: Column, context: Column, option: str | None = None, prefix: str = "") -> Column:
    user, end, assistant = instruction_tokens(option)
    return F.concat(F.lit(prefix + user), text, F.lit(end + assistant), context)


def answer_prompt(style: str, base: Column, text: Column, context: Column | None = None) -> Column:
    """Instruction prompt in one of the published answer templates."""
    if style not in fixed.ANSWER_TEMPLATES:
        raise ValueError(f"unknown prompt style {style}")
    if context is None:
        inp = text
    elif style == "continue":
        raise ValueError("the continue style takes no context")
    elif style in fixed.CONTEXT_FIRST:
        inp = F.concat(context, F.lit("\n"), text)
    else:
        inp = F.concat(text, F.lit("\n"), context)
    return t.strip(render(
        fixed.ANSWER_TEMPLATES[style], inp=inp, inp_stripped=t.strip(inp), base=base
    ))


def pack_base(language: str, declaration: Column, prompt: Column, with_docs: bool) -> Column:
    if with_docs:
        return prompt
    if language == "rust":
        return F.concat(F.lit("fn main(){}\n"), declaration)
    return declaration


def fix_prompt(
    style: str, language: str, base: Column, buggy: Column, entry_point: Column,
    tests: Column | None = None,
) -> Column:
    """Bug-fix prompt; tests join the context when there is no docstring."""
    ask = render(fixed.ASK_FIX, name=entry_point)
    context = F.concat(base, buggy)
    if tests is not None:
        context = F.concat(context, F.lit("\n"), tests)
    if style in fixed.FIX_TEMPLATES:
        file = F.concat(entry_point, F.lit("." + fixed.PACK_EXTENSIONS[language]))
        return t.strip(render(
            fixed.FIX_TEMPLATES[style],
            file=file, context=context, instruction=ask, base=base,
        ))
    return answer_prompt(style, base, ask, context)


def describe_prompt(style: str, code: Column, docstring: Column) -> Column:
    ask = render(fixed.ASK_DESCRIBE, n=F.length(docstring).cast("string"))
    return answer_prompt(style, F.lit(""), ask, code)


def synthesize_prompt(style: str, language: str, base: Column, text: Column) -> Column:
    ask = F.lit(fixed.ASK_WRITE.format(language=fixed.PACK_LANGUAGE_NAMES[language]))
    return answer_prompt(style, base, ask, text)


def parity_source(bugs: int) -> str:
    """The seeded toy program: each bug renames one variable or the modulus."""
    names = ["c" if seat < bugs else "b" for seat in range(4)]
    modulus = 3 if bugs > 4 else 2
    terms = ",".join(f"{name}{seat}" for seat, name in enumerate(names, 1))
    return fixed.PARITY_PROGRAM.format(terms=terms, modulus=modulus)


def mutation(style: str, code: Column, task: str = "parity") -> Column:
    return render(fixed.MUTATION_TEMPLATES[style], task=F.lit(task), code=code)


def program_fix(style: str, code: Column, name: Column) -> Column:
    prompt = render(fixed.PROGRAM_TEMPLATES[style], code=code, name=name)
    return prompt if style == "edit-openai" else t.strip(prompt)


def bug_fix(style: str, code: Column, kind: Column) -> Column:
    """Bug-fix prompt whose instruction depends on the bug type."""
    ask = F.lit(None).cast("string")
    for name, words in fixed.BUG_INSTRUCTIONS[style].items():
        ask = F.when(kind == name, F.lit(words)).otherwise(ask)
    return render(fixed.BUG_TEMPLATES[style], code=code, instruction=ask)


def script(prompt: Column) -> Column:
    tabs = F.replace(prompt, F.lit("    "), F.lit("\t"))
    return render(fixed.SCRIPT_TEMPLATE, inp=tabs)


def _cut_open_quote(text: Column, quote: str) -> Column:
    """Drop a single dangling quote, the character before it and what follows."""
    rule = rf"(?s)\A(.*?)[^'\"]{quote}[{t.BLANK_CLASS}]*\z"
    return F.when(text.rlike(rule), F.regexp_extract(text, rule, 1)).otherwise(text)


def doc_prefix(prefix: Column) -> Column:
    """Code in front of a docstring, closed with our own delimiter."""
    triple = F.when(t.contains(prefix, '"""'), t.before(prefix, '"""')).otherwise(
        t.before(prefix, "'''")
    )
    return F.concat(_cut_open_quote(_cut_open_quote(triple, "'"), '"'), F.lit('"""'))


def _without_suffix(text: Column, suffix: str) -> Column:
    return F.when(
        F.endswith(text, F.lit(suffix)), F.left(text, F.length(text) - len(suffix))
    ).otherwise(text)


def code_to_text(language: str, code: Column, docstring: Column) -> Column:
    """Function body without its docstring, then the description opener."""
    if language != "python":
        suffix = fixed.DOC_SUFFIX["ruby" if language == "ruby" else "other"]
        return F.concat(code, F.lit(suffix))
    at = t.find(code, docstring)
    head = doc_prefix(F.left(code, at - 1))
    tail = F.substr(code, at + F.length(docstring))
    for mark in ('"""', "'''"):
        tail = F.replace(tail, F.lit(mark), F.lit(""))
        head = _without_suffix(t.strip(head), mark)
    return F.concat(head, tail, F.lit(fixed.DOC_SUFFIX["python"]))


def code_to_text_left(code: Column, docstring: Column) -> Column:
    """Only the code in front of the docstring."""
    return doc_prefix(F.left(code, t.find(code, docstring) - 1))


def check_call(test: Column, entry_point: Column) -> Column:
    return F.concat(F.lit("\n"), test, F.lit("\ncheck("), entry_point, F.lit(")"))


def joined_tests(tests: Column) -> Column:
    return F.array_join(tests, "\n")


def canonical(prompt: Column, solution: Column) -> Column:
    return F.concat(prompt, solution)


def doc_reference(tokens: Column) -> Column:
    """Docstring tokens as text, without line breaks and a leading raw mark."""
    joined = F.replace(F.array_join(tokens, " "), F.lit("\n"), F.lit(""))
    return F.array_join(
        F.filter(
            F.split(F.regexp_replace(joined, "^r", ""), f"[{t.BLANK_CLASS}]+"),
            lambda word: word != "",
        ),
        " ",
    )


NUMBER = (
    r"(?i)\A[+-]?(?:(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:e[+-]?[0-9_]+)?"
    r"|nan|inf|infinity)\z"
)
INTEGER = r"\A[+-]?[0-9][0-9_]*\z"
_STRAY_UNDERSCORE = "(?<![0-9])_|_(?![0-9])"


def number(text: Column) -> Column:
    """Value of a number as Python reads it (underscores between digits), else null."""
    clean = t.strip(text)
    fits = clean.rlike(NUMBER) & ~clean.rlike(_STRAY_UNDERSCORE)
    return F.when(fits, F.replace(clean, F.lit("_"), F.lit("")).try_cast("double"))


def numeric_target(answer: Column, mark: str = "#### ") -> Column:
    """Parsed answer behind the last mark: text form, value and kind."""
    raw = t.strip(t.after_last(answer, mark))
    bare = F.replace(raw, F.lit(","), F.lit(""))
    value = number(bare)
    kind = F.when(value.isNull(), F.lit("text")).when(
        t.strip(bare).rlike(INTEGER), F.lit("int")
    ).otherwise(F.lit("float"))
    return F.struct(
        F.when(value.isNull(), raw).otherwise(bare).alias("text"),
        value.alias("value"), kind.alias("kind"),
    )
