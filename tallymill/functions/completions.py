"""Completion clean-up: each builder maps a completion column to a text column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import text as t


def drop_prompt(completion: Column, prompt: Column) -> Column:
    """Cut as many leading characters as the prompt has; no equality check."""
    return t.drop_left(completion, F.length(prompt))


def stop_position(text: Column, stops: Sequence[str] | Column) -> Column:
    """Earliest position of any stop string, or null."""
    if isinstance(stops, Column):
        return t.let(text, lambda bound: F.array_min(F.filter(
            F.transform(stops, lambda w: F.call_function("position", w, bound)),
            lambda p: p > 0,
        )))
    hits = [F.nullif(t.find(text, word), F.lit(0)) for word in stops]
    if not hits:
        return F.lit(None).cast("int")
    return F.least(*hits) if len(hits) > 1 else hits[0]


def truncate(text: Column, stops: Sequence[str] | Column) -> Column:
    """Text in front of the earliest stop string."""
    # The position appears once, so the stops are searched once.
    return F.left(text, F.coalesce(stop_position(text, stops) - 1, F.length(text)))


def truncate_in_order(text: Column, stops: Sequence[str]) -> Column:
    """Cut at each stop string in turn, in list order."""
    return reduce(t.before, stops, text)


def first_block(text: Column, stops: Sequence[str], keyword: str = "") -> Column:
    """Right-stripped text in front of the first stop string."""
    return t.rstrip(truncate(F.concat(F.lit(keyword), text), stops))


def drop_last_block(text: Column, stops: Sequence[str]) -> Column:
    """Text in front of the last stop string; empty when there is none."""
    rule = t.regex_any(stops)
    tail = F.element_at(F.split(text, rule, -1), -1)
    hit = F.try_element_at(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), F.lit(-1))
    kept = F.left(text, F.length(text) - F.length(tail) - F.length(hit))
    return F.coalesce(kept, F.lit(""))


def cut_at_dedent(text: Column) -> Column:
    """Cut at the first later line that starts with a visible character."""
    return F.coalesce(t.unindented_head(text, blanks_inside=False), text)


def _open_braces(language: str) -> int:
    return 2 if language == "java" else 1


def _closing_cut(text: Column, opened: int) -> Column:
    """Length up to the brace that closes the block, or null."""
    steps = F.regexp_extract_all(text, F.lit(r"[^{}]*[{}]"), F.lit(0))
    start = F.struct(
        F.lit(opened).alias("depth"), F.lit(0).alias("seen"),
        F.lit(None).cast("int").alias("cut"),
    )

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(F.endswith(part, F.lit("{")), 1).otherwise(-1)
        seen = state["seen"] + F.length(part)
        cut = F.coalesce(state["cut"], F.when(depth == 0, seen))
        return F.struct(depth.alias("depth"), seen.alias("seen"), cut.alias("cut"))

    return F.aggregate(steps, start, step, lambda state: state["cut"])


def _to_last_brace(text: Column) -> Column:
    return F.when(
        t.contains(text, "}"), F.concat(F.left(text, t.rfind(text, "}") - 1), F.lit("}"))
    ).otherwise(text)


def _without_main(text: Column) -> Column:
    main = t.find(text, "public static void main")
    return F.when(main > 0, F.concat(F.left(text, main - 1), F.lit("}"))).otherwise(text)


def _close_class(text: Column) -> Column:
    short = t.count_of(text, "{") - 1 == t.count_of(text, "}")
    return F.when(short, F.concat(text, F.lit("\n}"))).otherwise(text)


def _indented_head(text: Column) -> Column:
    head = t.unindented_head(text, blanks_inside=True)
    trimmed = F.left(head, F.greatest(F.length(head) - 1, F.lit(0)))
    return F.coalesce(trimmed, text)


def cut_function(text: Column, language: str, stops: Sequence[str]) -> Column:
    """Keep the completed function of a language."""
    text = truncate_in_order(text, stops)
    if language == "python":
        return t.let(text, _indented_head)
    repairs = [_to_last_brace]
    if language == "java":
        repairs = [_without_main, _to_last_brace, _close_class]

    def balanced(code: Column) -> Column:
        cut = _closing_cut(code, _open_braces(language))
        return t.let(cut, lambda at: F.when(at.isNotNull(), F.left(code, at)).otherwise(
            t.chain(code, *repairs)
        ))

    return t.let(text, balanced)


def is_complete(text: Column, language: str, stops: Sequence[str], style: str = "") -> Column:
    """Whether the completion already holds a finished function."""
    stopped = stop_position(text, stops).isNotNull()
    if style.startswith("diff"):
        return stopped
    if language == "python":
        done = t.unindented_head(text, blanks_inside=True).isNotNull()
    else:
        done = t.count_of(text, "{") + _open_braces(language) == t.count_of(text, "}")
    return stopped | done


def is_too_long(text: Column, input_length: Column, multiplier: float) -> Column:
    return F.length(text) > F.floor(input_length * F.lit(multiplier))


def answer_section(text: Column, mark: str = "\nANSWER:") -> Column:
    return t.after(text, mark)


def last_section(text: Column, mark: str, splits: int) -> Column:
    return t.strip(t.after_splits(text, mark, splits))


def math_program(text: Column) -> Column:
    """Last worked solution, cut at the next question, plus the print call."""
    body = last_section(text, fixed.MATH_MARK, fixed.MATH_SHOTS + 1)
    return F.concat(t.before(body, "Q:"), F.lit("\n" + fixed.MATH_POST_SCRIPT))


def cut_to_reference(text: Column, reference: Column) -> Column:
    return F.left(text, F.length(reference))


def between_tags(
    text: Column,
    starts: Sequence[str] = ("BEGIN SOLUTION\n<code>", "# SOLUTION START"),
    stops: Sequence[str] = tuple(fixed.STOPS["ds1000"]),
) -> Column:
    return t.strip(truncate_in_order(reduce(t.after, starts, text), stops))


def after_fence(text: Column) -> Column:
    """Text behind the first fence, without its language tag."""
    return F.when(
        t.contains(text, "```"),
        F.regexp_replace(t.after(text, "```"), r"\Apython", ""),
    ).otherwise(text)


def fenced_code(text: Column) -> Column:
    """Content of the first fenced block; the whole text without a fence."""
    return t.before(after_fence(text), "```")


def function_window(text: Column, context: Column, name: Column, stops: Sequence[str]) -> Column:
    """From the definition to the end of its last return line, behind the imports."""
    define = F.concat(F.lit("def "), name)
    at = t.find(context, define)
    imports = F.left(context, F.when(at > 0, at - 1).otherwise(F.length(context) - 1))

    def window(code: Column) -> Column:
        start = F.greatest(t.find(code, define), F.lit(1))
        last_return = F.greatest(t.rfind(F.substr(code, start), "  return "), F.lit(1))
        line_end = t.find(code, "\n", start + last_return - 1)
        fence = t.find(code, "```")
        end = F.when(line_end > 0, line_end).otherwise(F.length(code) + 1)
        end = F.when(fence > 0, F.least(end, fence)).otherwise(end)
        return F.substr(code, start, F.greatest(end - start, F.lit(0)))

    code = t.chain(text, after_fence, lambda x: truncate(x, stops))
    return F.concat(t.strip(imports), F.lit("\n"), t.let(code, window))


def definition_body(text: Column, name: Column, stops: Sequence[str]) -> Column:
    """Text up to the definition plus the definition cut at its dedent."""
    code = truncate(text, stops)
    at = t.find(code, F.concat(F.lit("def "), name))
    return F.when(
        at > 0, F.concat(F.left(code, at - 1), cut_at_dedent(F.substr(code, at)))
    ).otherwise(code)


def _opened_fence(text: Column) -> Column:
    """Content of a python fence; an unclosed one runs to the end."""
    fence = t.find(text, "```python")
    opened = F.replace(t.strip(F.substr(text, fence)), F.lit("```python"), F.lit(""))
    inner = F.when(
        t.contains(opened, "```"), t.strip(t.before(opened, "```"))
    ).otherwise(opened)
    return F.when(fence > 0, inner).otherwise(text)


def _cut_at(mark: str):
    return lambda text: F.when(
        t.contains(text, mark), t.strip(t.before(text, mark))
    ).otherwise(text)


def _without_greeting(text: Column) -> Column:
    rest = F.when(t.contains(text, "\n"), t.after(text, "\n")).otherwise(F.lit(""))
    return F.when(F.startswith(text, F.lit("Here's")), rest).otherwise(text)


def chat_code(text: Column) -> Column:
    """Code out of a chat answer: marker, fence, guard, usage and greeting."""
    text = t.after_last(text, "### Response:")
    text = t.before(F.replace(text, F.lit("\t"), F.lit("    ")), "</s>")
    return t.chain(
        text, _opened_fence, _cut_at('if __name__ == "__main__":'),
        _cut_at("# Example usage"), _without_greeting,
    )


def infill_middle(text: Column, family: str, specials: Sequence[str] = ()) -> Column:
    """The infilled middle of a completion, without special tokens."""
    _, to_suffix, to_middle, end = fixed.INFILL_MARKS[family]
    middle = t.before(t.after(t.after(text, to_suffix), to_middle), end)
    return reduce(lambda out, s: F.replace(out, F.lit(s), F.lit("")), specials, middle)


def after_assistant(text: Column, end_token: str, assistant_token: str) -> Column:
    """Text behind the assistant mark, or behind its code fence."""
    mark = assistant_token or end_token
    if not mark:
        return text
    if "```python" not in mark:
        return t.after(text, mark)
    at = t.find(text, mark)
    fence = t.find(text, "```python", at)
    return F.when(at > 0, F.substr(text, fence + len("```python"))).otherwise(text)


def doc_line(text: Column, language: str) -> Column:
    """First line of a generated description; null without its delimiter."""
    mark = fixed.DOC_SUFFIX.get(language, fixed.DOC_SUFFIX["other"])
    section = F.get(F.split(text, t.quoted(mark), -1), F.lit(1))
    return t.first_line(t.strip(section))


def doc_line_left(text: Column) -> Column:
    """First line of a description that may sit inside triple quotes."""

    def shown(rest: Column) -> Column:
        return t.strip(t.first_line(t.strip(rest)))

    def inside(mark: str):
        def step(state: Column) -> Column:
            found = t.contains(state["rest"], mark)
            rest = t.after(state["rest"], mark)
            return F.struct(
                F.when(found, rest).otherwise(state["rest"]).alias("rest"),
                F.when(found, t.before(shown(rest), mark)).otherwise(state["line"]).alias("line"),
            )
        return step

    start = F.struct(text.alias("rest"), shown(text).alias("line"))
    return t.chain(start, inside('"""'), inside("'''"))["line"]


def description(text: Column, limit: Column, stops: Sequence[str], solution: Column) -> Column:
    """Description of at most ``limit`` characters with leaked code removed."""
    kept = t.rstrip(truncate_in_order(F.left(t.strip(text), limit), stops))
    leaks = F.filter(F.transform(t.lines(solution), t.strip), lambda x: F.length(x) > 20)
    return F.aggregate(leaks, kept, lambda out, x: F.replace(out, x, F.lit("")))


def compact_block(text: Column) -> Column:
    """Compact-grammar completion: up to its last block end, then stops."""
    end = "<block_end>"
    at = t.rfind(text, end)
    whole = F.when(at > 0, F.left(text, at + len(end) - 1)).otherwise(text)
    return truncate(whole, fixed.STOPS["humaneval-compact"])


def compact_program(program: Column) -> Column:
    """Cut a decoded program at the trailing top-level statements."""
    return truncate_in_order(program, fixed.COMPACT_STOPS)


def to_snake(name: Column) -> Column:
    split = F.regexp_replace(name, "([a-zA-Z])([0-9])", "$1_$2")
    return F.lower(F.regexp_replace(split, "([a-z0-9])([A-Z])", "$1_$2"))


def entry_spellings(name: Column) -> list[Column]:
    lowered = F.concat(F.lower(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))
    return [name, to_snake(name), lowered]


def body_after_entry(text: Column, name: Column) -> Column:
    """Lines below the last mention of the entry point; null if unmentioned."""
    content = F.when(
        t.contains(text, "```"), F.get(F.split(text, "```", -1), F.lit(1))
    ).otherwise(text)
    tails = [
        F.when(t.contains(content, spelling), t.after_last(content, spelling))
        for spelling in entry_spellings(name)
    ]
    tail = F.coalesce(*tails)
    return F.when(t.contains(tail, "\n"), t.after(tail, "\n")).when(
        tail.isNotNull(), F.lit("")
    )


def _called_outside_comments(program: Column, mark: str) -> Column:
    return t.contains(program, mark) & F.exists(
        t.lines(program),
        lambda line: t.contains(line, mark) & ~F.startswith(t.strip(line), F.lit("//")),
    )


def _go_imports(program: Column) -> Column:
    """Import block for packages used outside comment lines but not quoted yet."""

    def block(code: Column) -> Column:
        used = []
        for package in fixed.GO_PACKAGES:
            name = package.rsplit("/", 1)[-1]
            missing = ~t.contains(code, f'"{package}"')
            call = _called_outside_comments(code, name + ".")
            used.append(F.when(missing & call, F.lit(f'    "{name}"')))
        names = F.array_distinct(F.array_compact(F.array(*used)))
        return F.when(
            F.size(names) > 0,
            F.concat(F.lit("import (\n"), F.array_join(names, "\n"), F.lit("\n)\n")),
        ).otherwise(F.lit(""))

    return t.let(program, block)


def _go_setup(setup: Column, code: Column) -> Column:
    """Setup lines without the quoted imports the completion already has."""
    names = F.transform(
        t.lines(setup),
        lambda line: t.strip(F.regexp_replace(line, r"import|\(|\)", "")),
    )
    doubled = F.filter(
        names, lambda x: F.startswith(x, F.lit('"')) & t.contains(code, x)
    )
    return F.aggregate(doubled, setup, lambda out, x: F.replace(out, x, F.lit("")))


def program(
    text: Column,
    language: str,
    *,
    setup: Column | None = None,
    reference: Column | None = None,
    declaration: Column | None = None,
) -> Column:
    """The program to run: imports, declarations and mains put in order."""
    if language == "python":
        return t.strip(F.concat(F.lit("\n".join(fixed.PYTHON_IMPORTS) + "\n"), text))
    if language == "cpp":
        imports = F.lit("\n".join(fixed.CPP_IMPORTS) + "\n")
        return t.strip(F.concat(imports, t.before(text, "int main")))
    if language == "java":
        empty = F.lit("public class Main {\n    }")
        return t.strip(F.replace(text, empty, F.lit("")))
    if language == "go":
        def assembled(head: Column) -> Column:
            imports = _go_imports(F.concat(head, text, F.lit("\n"), reference))
            both = t.contains(text, "package main") & t.contains(head, "package main")
            body = F.when(both, F.replace(text, F.lit("package main"), F.lit(""))).otherwise(text)
            return F.concat(head, imports, body)

        return t.let(_go_setup(F.concat(setup, F.lit("\n")), text), assembled)
    if language == "rust":
        trimmed = F.transform(t.lines(declaration), t.strip)
        missing = F.filter(
            trimmed,
            lambda line: ~t.contains(text, line)
            & ~(F.startswith(line, F.lit("fn")) & t.contains(text, t.before(line, "("))),
        )
        lines = F.array_join(F.transform(missing, lambda x: F.concat(x, F.lit("\n"))), "")
        main = F.when(t.contains(text, "fn main()"), F.lit("")).otherwise(F.lit("fn main(){}\n"))
        once = F.call_function("substring_index", text, F.lit("fn main()"), F.lit(2))
        return F.concat(main, lines, once)
    return text


def program_for(language: Column, text: Column, **parts: Column) -> Column:
    """``program`` chosen by a language column."""
    out = F.when(F.lit(False), text)
    for name in fixed.PACK_LANGUAGES:
        out = out.when(language == name, program(text, name, **parts))
    return out.otherwise(text)
