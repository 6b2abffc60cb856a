"""Tasks by name: how to prompt, what to compare with, how to clean, how to score.

A spec holds column builders over the benchmark columns of its family, so a
task runs on any table with those columns. Completions arrive as rows; nothing
here runs a model or a program.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import completions as c
from tallymill.functions import prompts as p
from tallymill.functions import text as t
from tallymill.functions import tokens as tok
from tallymill.operators import patches

Build = Callable[[], Column]


@dataclass(frozen=True)
class TaskSpec:
    """Builders of one task.

    ``prompt`` and ``reference`` read benchmark columns; ``clean`` maps a
    completion column, and may read benchmark columns too. ``group`` is the
    column whose values are scored one by one, where the task has such.
    """

    name: str
    prompt: Build
    reference: Build
    clean: Callable[[Column], Column]
    metric: str
    stops: Sequence[str] = ()
    ks: Sequence[int] = (1, 10, 100)
    columns: Sequence[str] = field(default_factory=tuple)
    group: str = ""


def _col(name: str) -> Build:
    return lambda: F.col(name)


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _check() -> Column:
    return p.check_call(F.col("test"), F.col("entry_point"))


def _after_prompt(prompt: Build, stops: Sequence[str] | Build) -> Callable[[Column], Column]:
    """Cut the prompt, stop, and put the prompt back in front."""

    def clean(text: Column) -> Column:
        words = stops() if callable(stops) else stops
        return F.concat(prompt(), c.truncate(c.drop_prompt(text, prompt()), words))

    return clean


def _humaneval(name: str) -> TaskSpec:
    def prompt() -> Column:
        return p.plain(F.col("prompt"), stripped=name != "humaneval-unstripped")

    stops = fixed.stops_for(name)
    return TaskSpec(
        name, prompt, _check, _after_prompt(prompt, stops), "pass", stops,
        columns=("prompt", "test", "entry_point"),
    )


def _compact(name: str) -> TaskSpec:
    end = "<block_end>"

    def prompt() -> Column:
        text = tok.rewrite_vocabulary(t.strip(F.col("prompt")))
        return F.when(
            F.endswith(text, F.lit(end)), F.left(text, F.length(text) - len(end))
        ).otherwise(text)

    def clean(text: Column) -> Column:
        body = c.compact_block(c.drop_prompt(text, prompt()))
        return c.compact_program(F.concat(prompt(), body))

    return TaskSpec(name, prompt, _check, clean, "pass", fixed.stops_for(name),
                    columns=("prompt", "test", "entry_point"))


def _mbpp(name: str) -> TaskSpec:
    def prompt() -> Column:
        return p.docstring_with_test(F.col("text"), F.col("test_list"))

    stops = fixed.stops_for(name)
    return TaskSpec(
        name, prompt, lambda: p.joined_tests(F.col("test_list")),
        _after_prompt(prompt, stops), "pass", stops, columns=("text", "test_list"),
    )


def _apps(name: str) -> TaskSpec:
    return TaskSpec(
        name, lambda: p.question(*(F.col(x) for x in ("question", "starter_code", "input_output"))),
        _nothing, c.answer_section, "pass", fixed.stops_for(name),
        columns=("question", "starter_code", "input_output"),
    )


def _multiple(name: str) -> TaskSpec:
    def prompt() -> Column:
        return p.plain(F.col("prompt"))

    return TaskSpec(
        name, prompt, _col("tests"), _after_prompt(prompt, _col("stop_tokens")), "pass",
        columns=("prompt", "tests", "name", "stop_tokens"),
    )


def _perturbed(name: str) -> TaskSpec:
    def prompt() -> Column:
        return p.plain(F.col("prompt"))

    def reference() -> Column:
        return F.struct("task_id", "seed", "perturbation_name", _check().alias("test_code"))

    stops = fixed.stops_for(name)
    return TaskSpec(
        name, prompt, reference, _after_prompt(prompt, stops), "robust", stops,
        columns=("prompt", "test", "entry_point", "task_id", "seed", "perturbation_name"),
    )


def _library(name: str) -> TaskSpec:
    insertion = name.endswith("-insertion") and "matplotlib" not in name
    starts = () if insertion else ("BEGIN SOLUTION\n<code>", "# SOLUTION START")
    stops = fixed.stops_for(name)
    return TaskSpec(
        name, (lambda: p.insertion(F.col("prompt"))) if insertion else _col("prompt"),
        _col("reference_code"), lambda text: c.between_tags(text, starts, stops), "accuracy", stops,
        columns=("prompt", "reference_code"),
    )


def _pack(name: str, style: str) -> TaskSpec:
    kind, language = name.removeprefix("humaneval").rsplit("-", 1)
    stops = fixed.stops_for(name, style)
    with_docs = kind in ("fixdocs", "synthesize")

    def base() -> Column:
        return p.pack_base(language, F.col("declaration"), F.col("prompt"), with_docs)

    def reference() -> Column:
        return F.concat(F.lit("\n"), F.col("test"))

    def function_of(text: Column, prompt: Build) -> Column:
        return c.cut_function(t.rstrip(c.drop_prompt(text, prompt())), language, stops)

    if kind.startswith("fix"):
        tests = None if with_docs else "test"

        def prompt() -> Column:
            return p.fix_prompt(
                style, language, base(), F.col("buggy_solution"), F.col("entry_point"),
                None if tests is None else F.col(tests),
            )

        def clean(text: Column) -> Column:
            kept = function_of(text, prompt)
            if style == "diff-carper":
                return patches.carried_diff(F.concat(prompt(), kept))
            return kept if style.startswith("diff") else F.concat(t.rstrip(base()), kept)

        extra = ("buggy_solution", "entry_point")
    elif kind == "explaindescribe":

        def prompt() -> Column:
            code = F.concat(base(), F.col("canonical_solution"))
            return p.describe_prompt(style, code, F.col("docstring"))

        def clean(text: Column) -> Column:
            return c.description(
                c.drop_prompt(text, prompt()), F.length("docstring"), stops,
                F.col("canonical_solution"),
            )

        return TaskSpec(
            name, prompt, _nothing, clean, "none", stops,
            columns=("declaration", "canonical_solution", "docstring"),
        )
    else:
        described = kind == "explainsynthesize"

        def prompt() -> Column:
            if described:
                return p.synthesize_prompt(style, language, base(), F.col("description"))
            return p.answer_prompt(style, base(), t.strip(F.col("instruction")))

        def clean(text: Column) -> Column:
            return F.concat(t.rstrip(F.col("prompt")), function_of(text, prompt))

        extra = ("description",) if described else ("instruction",)
    return TaskSpec(
        name, prompt, reference, clean, "pass", stops,
        columns=("declaration", "prompt", "test", *extra),
    )


def _instruct(name: str, option: str | None) -> TaskSpec:
    plain = name.endswith("-nocontext")
    stops = fixed.stops_for(name)

    def prompt() -> Column:
        context = F.lit("") if plain else F.col("context")
        return p.instruct(F.col("instruction"), context, option)

    def clean(text: Column) -> Column:
        if plain:
            return c.function_window(text, F.col("context"), F.col("entry_point"), stops)
        return c.definition_body(text, F.col("entry_point"), stops)

    return TaskSpec(
        name, prompt, _check, clean, "pass", stops,
        columns=("instruction", "context", "test", "entry_point"),
    )


def _parity(name: str, style: str) -> TaskSpec:
    stops = fixed.stops_for(name)

    def prompt() -> Column:
        sources = F.array(*[F.lit(p.parity_source(bugs)) for bugs in range(1, 6)])
        return p.mutation(style, F.get(sources, F.col("bugs") - 1))

    def clean(text: Column) -> Column:
        keyword = "def" if style.startswith("prompt") else ""
        return c.first_block(c.drop_prompt(text, prompt()), stops, keyword)

    return TaskSpec(name, prompt, _nothing, clean, "group_pass", stops, columns=("bugs",),
                    group="bugs")


def _python_bugs(name: str, style: str) -> TaskSpec:
    def prompt() -> Column:
        return p.bug_fix(style, F.col("prompt_code"), F.col("task"))

    def clean(text: Column) -> Column:
        keyword = F.lit("def" if style.startswith("prompt") else "")
        whole = F.concat(keyword, c.drop_prompt(text, prompt()))
        return c.cut_to_reference(whole, F.col("correct_code"))

    return TaskSpec(
        name, prompt, _col("correct_code"), clean, "exact_match", fixed.stops_for(name),
        columns=("prompt_code", "task", "correct_code"),
    )


def _quixbugs(name: str, style: str) -> TaskSpec:
    stops = fixed.stops_for(name, style)

    def prompt() -> Column:
        return p.program_fix(style, F.col("buggy_program"), F.col("name"))

    def clean(text: Column) -> Column:
        keyword = F.lit("def" if style == "prompt" else "")
        return c.drop_last_block(F.concat(keyword, c.drop_prompt(text, prompt())), stops)

    return TaskSpec(
        name, prompt, lambda: F.struct("name", t.strip(F.col("tests")).alias("tests")), clean,
        "group_pass", stops, columns=("name", "buggy_program", "tests"), group="name",
    )


def _math(name: str, shots: dict) -> TaskSpec:
    hard = "gsmhard" in name

    def prompt() -> Column:
        listed = [F.array(*[F.lit(x) for x in shots[key]]) for key in ("questions", "solutions")]
        return p.math_shots(F.col("input" if hard else "question"), *listed)

    def reference() -> Column:
        return F.col("target") if hard else p.numeric_target(F.col("answer"))

    return TaskSpec(
        name, prompt, reference, c.math_program,
        "vote" if name.endswith("majority_voting") else "first_answer", fixed.stops_for(name),
        columns=("input", "target") if hard else ("question", "answer"),
    )


def _pair(shots: dict, ask: str, answer: str) -> dict[str, tuple[str, str]]:
    return {
        "first": (shots[f"{ask}1"], shots[f"{answer}1"]),
        "second": (shots[f"{ask}2"], shots[f"{answer}2"]),
    }


def _intent(name: str, shots: dict) -> TaskSpec:
    java = name == "concode"
    entry = fixed.CONCODE_ENTRY if java else fixed.CONALA_ENTRY
    pair = _pair(shots, "instruction", "solution")

    def prompt() -> Column:
        text = p.first_field(F.col("nl")) if java else p.intent(
            F.col("rewritten_intent"), F.col("intent")
        )
        made = p.two_shot(text, pair, entry, "Instruction", "Solution")
        return p.require_marks(made, "Solution:\n", 3)

    return TaskSpec(
        name, prompt, _col("code" if java else "snippet"),
        lambda text: c.last_section(text, "Solution:\n", 3), "corpus_bleu", fixed.stops_for(name),
        columns=("nl", "code") if java else ("intent", "rewritten_intent", "snippet"),
    )


def _translation(name: str, shots: dict) -> TaskSpec:
    language = fixed.TRANSLATION_LANGUAGES[name.rsplit("-", 1)[1]]
    shown = language.title()
    entry = f"Translate the following documentation from {shown} to English:\n"
    pair = _pair(shots[language], "source", "target")
    return TaskSpec(
        name, lambda: p.two_shot(F.col("source"), pair, entry, shown, "English"),
        lambda: t.strip(F.col("target")),
        lambda text: c.last_section(text, "\nEnglish:\n", 3), "corpus_bleu",
        fixed.stops_for(name), columns=("source", "target"),
    )


def _code_to_text(name: str) -> TaskSpec:
    left = name.endswith("-left")
    language = "python" if left else name.rsplit("-", 1)[1]
    builder = p.code_to_text_left if left else (
        lambda code, doc: p.code_to_text(language, code, doc)
    )
    return TaskSpec(
        name, lambda: builder(F.col("code"), F.col("docstring")),
        lambda: p.doc_reference(F.col("docstring_tokens")),
        c.doc_line_left if left else (lambda text: c.doc_line(text, language)),
        "sentence_bleu", fixed.stops_for(name),
        columns=("code", "docstring", "docstring_tokens"),
    )


def spec(
    name: str, style: str | None = None, *, shots: dict | None = None,
    instruction_tokens: str | None = None,
) -> TaskSpec:
    """The spec of a task name.

    ``style`` is the prompt style of the families that have one; ``shots`` is
    the example store of the few-shot families.
    """
    if name not in fixed.task_names():
        raise KeyError(f"unknown task {name}")
    family = name.split("-", 1)[0]
    if name.startswith(("humanevalfix", "humanevalexplain", "humanevalsynthesize")):
        return _pack(name, style or "instruct")
    if family in ("pal", "conala", "concode", "codexglue_text_to_text"):
        if shots is None:
            raise ValueError(f"{name} needs its example store")
        make = {"pal": _math, "codexglue_text_to_text": _translation}.get(family, _intent)
        return make(name, shots)
    styled = {"parity": _parity, "python_bugs": _python_bugs, "quixbugs": _quixbugs}
    if family in styled:
        return styled[family](name, style or "prompt")
    if name in ("instruct-humaneval", "instruct-humaneval-nocontext"):
        return _instruct(name, instruction_tokens)
    if name == "instruct_wizard_humaneval":
        return TaskSpec(
            name, lambda: p.script(F.col("prompt")), _check, c.chat_code, "pass",
            columns=("prompt", "test", "entry_point"),
        )
    plain = {
        "humaneval-compact": _compact, "mbpp": _mbpp, "apps": _apps, "multiple": _multiple,
        "perturbed": _perturbed, "ds1000": _library, "codexglue_code_to_text": _code_to_text,
    }
    return plain.get(name, plain.get(family, _humaneval))(name)


def prompted(benchmark: DataFrame, task: TaskSpec, prefix: str = "") -> DataFrame:
    """Benchmark rows with their prompt and reference."""
    prompt = task.prompt()
    if prefix:
        prompt = F.concat(F.lit(prefix), prompt)
    return benchmark.withColumn("task_prompt", prompt).withColumn(
        "task_reference", task.reference()
    )


def cleaned(
    generations: DataFrame, benchmark: DataFrame, task: TaskSpec, key: str, text: str = "text"
) -> DataFrame:
    """Completions joined to their benchmark row by key, cleaned in place.

    The benchmark is broadcast by Spark when it is under the size limit; beyond
    it the join is sorted and skewed problems are split at run time.
    """
    held = generations.select(key, F.struct(*generations.columns).alias("__row"))
    joined = held.join(benchmark.select(key, *task.columns), key)
    done = joined.select("__row", task.clean(F.col("__row")[text]).alias("__clean"))
    return done.select(*[
        F.col("__clean").alias(x) if x == text else F.col("__row")[x].alias(x)
        for x in generations.columns
    ])
