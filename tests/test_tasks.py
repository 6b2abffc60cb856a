from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymill import fixed, tasks

MATH = {"questions": [f"q{i}" for i in range(8)], "solutions": [f"    return {i}" for i in range(8)]}
PAIR = {"instruction1": "a", "solution1": "b", "instruction2": "c", "solution2": "d"}
TRANSLATION = {lang: {"source1": "a", "target1": "b", "source2": "c", "target2": "d"}
               for lang in fixed.TRANSLATION_LANGUAGES.values()}

ROW = {
    "key": 0, "prompt": "def f(x):\n", "test": "def check(g):\n  assert g(1)\n", "entry_point": "f",
    "text": "Add one.", "test_list": ["assert f(1) == 2", "assert f(2) == 3"], "question": "Q?",
    "starter_code": "", "input_output": "{}", "tests": " assert f(1) ", "name": "gcd",
    "stop_tokens": ["\nEND"], "task_id": "t/0", "seed": 1, "perturbation_name": "n",
    "reference_code": "x = 1", "declaration": "def f(x):\n", "buggy_solution": "  return x\n",
    "canonical_solution": "  return x + 1\n", "docstring": "Adds one to a number.",
    "instruction": " Write f. ", "description": "It adds one.", "context": "import os\ndef f(x):\n",
    "bugs": 2, "prompt_code": "def g(): pass", "task": "bin-op", "correct_code": "def f(x):",
    "buggy_program": "def gcd(): pass", "input": "How many?", "target": 4.0, "answer": "so #### 1,234",
    "intent": "do it", "rewritten_intent": None, "snippet": "x()", "nl": "get x. concode_field_sep y",
    "code": 'def f(x):\n  """Adds one to a number."""\n  return x', "source": "hej", "docstring_tokens": ["Adds", "one"],
}
SCHEMA = ", ".join(
    f"`{k}` " + ("array<string>" if isinstance(v, list) else "double" if isinstance(v, float)
                 else "long" if isinstance(v, int) else "string") for k, v in ROW.items()
)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([tuple(ROW.values())], SCHEMA)


def make(name, **options):
    if name.startswith("pal-"):
        options["shots"] = MATH
    elif name in ("conala", "concode"):
        options["shots"] = PAIR
    elif name.startswith("codexglue_text_to_text"):
        options["shots"] = TRANSLATION
    return tasks.spec(name, **options)


@pytest.mark.parametrize("group", range(3))
def test_every_task_builds(bench, group):
    names = fixed.task_names()[group::3]
    specs = [make(name) for name in names]
    row = bench.select(*[
        column for i, s in enumerate(specs) for column in (
            s.prompt().alias(f"p{i}"), s.clean(F.lit("x")).alias(f"c{i}"),
            s.reference().alias(f"r{i}"),
        )
    ]).first()
    for i, s in enumerate(specs):
        assert row[f"p{i}"], s.name


def run(bench, name, text, **options):
    task = make(name, **options)
    gens = bench.select("key", F.lit(3).alias("sample_idx"), F.lit("mine").alias("task"), F.lit(text).alias("text"))
    row = tasks.cleaned(gens, bench, task, "key").first()
    assert row["sample_idx"] == 3 and row["task"] == "mine"
    prompt = tasks.prompted(bench, task).first()
    return prompt["task_prompt"], prompt["task_reference"], row["text"]


def test_function_completion(bench):
    prompt, reference, text = run(bench, "humaneval", "def f(x):  return x\ndef g():")
    assert prompt == "def f(x):" and text == "def f(x):  return x"
    assert reference == "\n" + ROW["test"] + "\ncheck(f)"
    prompt, _, text = run(bench, "humaneval-unstripped", "def f(x):\n  return x\n#")
    assert prompt == "def f(x):\n" and text == "def f(x):\n  return x"


def test_compact_function_completion(bench):
    prompt, _, text = run(bench, "humaneval-compact", "<def_stmt> f(x):  a<block_end>b\nif c")
    assert prompt == "<def_stmt> f(x):"
    assert text == "<def_stmt> f(x):  a<block_end>"


def test_short_problems(bench):
    prompt, reference, text = run(bench, "mbpp", '"""\nAdd one.\nassert f(1) == 2\n"""\ndef f(x): pass\nassert x')
    assert prompt == '"""\nAdd one.\nassert f(1) == 2\n"""\n'
    assert reference == "assert f(1) == 2\nassert f(2) == 3"
    assert text == prompt + "def f(x): pass"


def test_stop_column(bench):
    _, reference, text = run(bench, "multiple-js", "def f(x): a\nEND b")
    assert text == "def f(x): a" and reference == ROW["tests"]


def test_fix_styles(bench):
    prompt, _, text = run(bench, "humanevalfixtests-python", "", style="octocoder")
    assert prompt.startswith("Question: Fix bugs in f.\ndef f(x):\n  return x\n\ndef check")
    assert prompt.endswith("Answer:\ndef f(x):")
    prompt, *_ = run(bench, "humanevalfixdocs-rust", "", style="diff-carper")
    assert prompt.startswith("<NME> f.rs\n<BEF> def f(x):\n  return x\n") and prompt.endswith("<DFF>")
    _, _, text = run(bench, "humanevalfixdocs-rust", prompt + " @@ -2,1 +2,1 @@\n-  return x\n+  return x + 1\n<MSG>", style="diff-carper")
    assert text == "@@ -2,1 +2,1 @@\n-  return x\n+  return x + 1\n"
    prompt, *_ = run(bench, "humanevalfixdocs-python", "")
    assert prompt == "def f(x):\n  return x\n\nFix bugs in f.\n\ndef f(x):"
    _, _, text = run(bench, "humanevalfixdocs-python", prompt + "\n  return x + 1\nprint(f)")
    assert text == "def f(x):\n  return x + 1"


def test_describe_and_synthesize(bench):
    prompt, _, text = run(bench, "humanevalexplaindescribe-python", "")
    assert "at most 21 characters" in prompt
    _, _, text = run(bench, "humanevalexplaindescribe-python", prompt + " It adds one to all of the numbers")
    assert text == "It adds one to all of"
    prompt, *_ = run(bench, "humanevalexplainsynthesize-go", "")
    assert prompt.startswith("It adds one.\nWrite functional code in Go")
    prompt, *_ = run(bench, "humanevalsynthesize-java", "", style="codellama")
    assert prompt == "[INST] Write f. [/INST] def f(x):"


def test_bug_tasks(bench):
    prompt, reference, text = run(bench, "python_bugs", "")
    assert prompt.endswith("# Fixed binary operator\ndef")
    _, _, text = run(bench, "python_bugs", prompt + " f(x): return 1")
    assert text == "def f(x):" == reference
    prompt, _, text = run(bench, "parity", "")
    assert "c1,c2,b3,b4" in prompt
    _, _, text = run(bench, "parity", prompt + " parity():\n  x\n\ndef g")
    assert text == "def parity():\n  x"
    prompt, reference, _ = run(bench, "quixbugs", "")
    assert reference["tests"] == "assert f(1)"
    _, _, text = run(bench, "quixbugs", prompt + " gcd():\n  x\n\n# end")
    assert text == "def gcd():\n  x\n"


def test_few_shot_tasks(bench):
    prompt, reference, text = run(bench, "pal-gsm8k-greedy", "")
    assert prompt.count("def solution():") == 8 and reference["value"] == 1234.0
    _, _, text = run(bench, "pal-gsm8k-greedy", prompt + "def solution():\n  return 1\nQ: more")
    assert text == "def solution():\n  return 1\n\nprint(solution())"
    assert run(bench, "pal-gsmhard-majority_voting", "")[1] == 4.0
    prompt, reference, _ = run(bench, "conala", "")
    assert "do it" in prompt and reference == "x()"
    assert run(bench, "conala", prompt + " y()\n")[2] == "y()"
    assert "\nget x" + " " * 19 in run(bench, "concode", "")[0]
    assert "Danish:\nhej" in run(bench, "codexglue_text_to_text-da_en", "")[0]
    with pytest.raises(ValueError):
        tasks.spec("conala")


def test_library_tasks(bench):
    rows = bench.withColumn("prompt", F.lit("a\n[insert]\nb"))
    prompt, reference, _ = run(rows, "ds1000-numpy-insertion", "")
    assert (prompt["prefix"], prompt["suffix"]) == ("a\n", "\nb\n") and reference == "x = 1"
    assert run(rows, "ds1000-matplotlib-insertion", "")[0] == "a\n[insert]\nb"
    assert run(bench, "ds1000-all-completion", "p # SOLUTION START\n y </code>")[2] == "y"
    assert run(rows, "ds1000-numpy-insertion", "# SOLUTION START y")[2] == "# SOLUTION START y"


def test_instruction_tasks(bench):
    prompt, *_ = run(bench, "instruct-humaneval", "", instruction_tokens="<u>,</s>,<a>")
    assert prompt == "<u> Write f. </s><a>import os\ndef f(x):\n"
    assert run(bench, "instruct-humaneval-nocontext", "")[0] == " Write f. \n"
    assert "\t" not in run(bench, "instruct_wizard_humaneval", "")[0]


def test_code_to_text(bench):
    prompt, reference, _ = run(bench, "codexglue_code_to_text-python", "")
    assert prompt == "def f(x):\n  return x" + fixed.DOC_SUFFIX["python"] and reference == "Adds one"
    assert run(bench, "codexglue_code_to_text-python", prompt + "Adds.\nmore")[2] == "Adds."
    assert run(bench, "codexglue_code_to_text-python-left", ' x """')[2] == ""


def test_unknown_task():
    with pytest.raises(KeyError):
        tasks.spec("no-such-task")
