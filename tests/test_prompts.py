from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import prompts as p


def test_question_prompt(apply):
    rows = [("Q", "", '{"fn_name": "f"}'), ("Q", "s", "{}"), ("Q", None, "broken"), ("Q", "", '{"fn_name": ""}')]
    got = apply(lambda d: p.question(d.q, d.s, d.j), rows, "i long, q string, s string, j string")
    assert got == [
        "\nQUESTION:\nQ\nUse Call-Based format\nANSWER:\n",
        "\nQUESTION:\nQs\nUse Standard Input format\nANSWER:\n",
        "\nQUESTION:\nQ\nUse Standard Input format\nANSWER:\n",
        "\nQUESTION:\nQ\nUse Standard Input format\nANSWER:\n",
    ]


def test_numbers_are_read_like_python(apply):
    texts = ["1", " 2.5 ", "1_000", "_1", "1_", "1__0", "1d", "1e3", ".5", "5.", "", "x", "-7", "+3",
             "1e", "0x1", "inf", "NaN", "1 2", "1_000.2_5"]

    def plain(s):
        try:
            return repr(float(s))
        except ValueError:
            return None

    got = apply(lambda d: p.number(d.text), texts)
    assert [None if x is None else repr(x) for x in got] == [plain(s) for s in texts]


def test_numeric_target(apply):
    got = apply(lambda d: p.numeric_target(d.text), [
        "so #### 1,234", "a #### b #### 7.50", "none at all", "#### 1_000 "
    ])
    assert [(r["text"], r["value"], r["kind"]) for r in got] == [
        ("1234", 1234.0, "int"), ("7.50", 7.5, "float"), ("none at all", None, "text"),
        ("1_000", 1000.0, "int"),
    ]


def test_two_shots_need_three_marks(spark, apply):
    shots = {"first": ("a", "b"), "second": ("c", "d")}
    made = lambda d: p.require_marks(
        p.two_shot(d.text, shots, fixed.CONALA_ENTRY, "Instruction", "Solution"), "Solution:\n", 3
    )
    (got,) = apply(made, ["ask"])
    gap = " " * 19
    assert got == (
        fixed.CONALA_ENTRY + f"\nInstruction:\na{gap}\nSolution:\nb{gap}\nInstruction:\nc{gap}"
        f"\nSolution:\nd{gap}\nInstruction:\nask{gap}\nSolution:\n"
    )
    with pytest.raises(Exception, match="3 marks"):
        apply(made, ["ask\nSolution:\n"])


def test_shots_from_a_table_equal_literal_shots(spark):
    row = spark.createDataFrame([("t", ("a", "b", "c", "d"))],
                                "text string, e struct<ask1:string,answer1:string,ask2:string,answer2:string>")
    shots = {"first": ("a", "b"), "second": ("c", "d")}
    one, two = row.select(
        p.two_shot(F.col("text"), shots, "E", "A", "B"), p.two_shot_from(F.col("e"), F.col("text"), "E", "A", "B")
    ).first()
    assert one == two


def test_math_shots_stop_at_eight(apply):
    many = F.array(*[F.lit(f"q{i}") for i in range(10)])
    (got,) = apply(lambda d: p.math_shots(d.text, many, many), ["last"])
    assert got.count("def solution():") == 8 and "q8" not in got
    assert got.endswith("Q: last\n\n# solution in Python:\n\n\n")


def test_instruction_tokens():
    assert p.instruction_tokens(None) == ("", "", "\n")
    assert p.instruction_stops("<u>,,<a>") == ["<u>", "<a>"]
    with pytest.raises(ValueError):
        p.instruction_tokens("a,b")


def test_styles_are_checked():
    with pytest.raises(ValueError):
        p.infill(None, None, "unknown")


def test_parity_source_counts_bugs():
    assert "sum([b1,b2,b3,b4])\n    return bit_sum % 2" in p.parity_source(0)
    assert "sum([c1,c2,c3,b4])\n    return bit_sum % 2" in p.parity_source(3)
    assert "sum([c1,c2,c3,c4])\n    return bit_sum % 3" in p.parity_source(5)


def test_doc_prefix_drops_dangling_quotes(apply):
    texts = ['def f():\n  """', "def f():\n  r'''", "def f():\n  r'  ", 'def f():\n  u"', "def f():"]
    assert apply(lambda d: p.doc_prefix(d.text), texts) == [
        'def f():\n  """', 'def f():\n  r"""', 'def f():\n  """', 'def f():\n  """', 'def f():"""'
    ]


def test_code_to_text(apply):
    code = 'def f(x):\n    """Doc."""\n    return x'
    assert apply(lambda d: p.code_to_text("python", d.text, F.lit("Doc.")), [code]) == [
        "def f(x):\n    return x" + fixed.DOC_SUFFIX["python"]
    ]
    assert apply(lambda d: p.code_to_text("ruby", d.text, F.lit("")), ["x"]) == ["x" + fixed.DOC_SUFFIX["ruby"]]
    assert apply(lambda d: p.code_to_text_left(d.text, F.lit("Doc.")), [code]) == ['def f(x):\n    """']


def test_first_field(apply):
    texts = ["a . concode_field_sep b", "x.", "y", " z.. "]
    assert apply(lambda d: p.first_field(d.text), texts) == ["a", "x", "y", "z."]


def test_references(apply):
    rows = [(["a", "b"],)]
    assert apply(lambda d: p.joined_tests(d.l), rows, "i long, l array<string>") == ["a\nb"]
    words = [(["Return", "it", "\n", "now"],), (["r", "x"],)]
    assert apply(lambda d: p.doc_reference(d.l), words, "i long, l array<string>") == ["Return it now", "x"]
