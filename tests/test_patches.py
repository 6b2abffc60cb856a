from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import patches

FILE = "one\ntwo\nthree\nfour\ntwo"
DIFFS = [
    "@@ -2,1 +2,1 @@\n-two\n+TWO\n",
    "@@ -1,2 +1,3 @@ f()\n one\n-two\n+2\n+two and\n@@ -4,1 +5,1 @@\n-two\n+last\n",
    "@@ -1 +1 @@\n-on\n+x",
    "@@ -1,1 +1,1 @@\n-absent\n+x\n@@ -1,1 +1,1 @@\n-four\n+4\n",
    "@@ -0,0 +1,1 @@\n+top\n",
    "@@ -2,1 +2,1 @@\n-two\n+2\n@@ -0,0 +1,1 @@\n+not on top\n",
    "note\n@@ -2,1 +2,1 @@\n-two\n+TWO\n",
    "@@ -5,1 +5,1 @@\n-two\n\\ No newline at end of file\n+2\n\\ No newline at end of file\n",
    "no header", "", "@@ broken @@\n-one\n+1\n", "@@ -1,1 +1,1 @@\n one\n", "@@ -1,1 +1,0 @@\n-one\n",
]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, f, d) for i, (f, d) in enumerate(rows)], "i int, f string, d string")
    out = patches.apply_diffs(df, "f", "d", "out", **options)
    return [r["out"] for r in out.orderBy("i").collect()]


#: The file after each diff, and what a diff makes of a file that is new.
AFTER = [
    "one\nTWO\nthree\nfour\ntwo", "one\n2\ntwo and\nthree\nfour\nlast", FILE,
    "one\ntwo\nthree\n4\ntwo", "top\n" + FILE, "one\n2\nthree\nfour\ntwo", "\n" + FILE,
    "one\n2\nthree\nfour\ntwo", FILE, FILE, "1\ntwo\nthree\nfour\ntwo", FILE, "\ntwo\nthree\nfour\ntwo",
]
ADDED = ["TWO", "one\n2\ntwo and", "x", "x", "top", "2", "", "2", "ADDFILE", "ADDFILE", "1", "one", ""]


def test_apply_forward(spark):
    assert run(spark, [(FILE, d) for d in DIFFS]) == AFTER
    assert run(spark, [("ADDFILE", d) for d in DIFFS]) == ADDED
    assert run(spark, [("é\n😀 x\ny", "@@ -2 +2 @@\n-😀 x\n+z")]) == ["é\nz\ny"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_matches_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(patches, "CHUNK", chunk)
    assert run(spark, [(FILE, d) for d in DIFFS]) == AFTER
    assert run(spark, [("", d) for d in DIFFS[:5]]) == ["", "", "", "", "top\n"]
    assert run(spark, [("é\n😀 x\ny", "@@ -2 +2 @@\n-😀 x\n+z"), (None, DIFFS[0]), (FILE, None)]) == [
        "é\nz\ny", None, None]


def edited(seed, lines, share):
    """A file, its edited version and their diff with a line of context."""
    rng = random.Random(seed)
    old = [f"{i} {rng.choice('abc')}" for i in range(lines)]
    new = []
    for line in old:
        kind = rng.random() / share
        new += [] if kind < 0.3 else [line + "!"] if kind < 0.7 else [line, "+1"] if kind < 1 else [line]
    diff = "\n".join(list(difflib.unified_diff(old, new, n=1, lineterm=""))[2:])
    return "\n".join(old), "\n".join(new), diff


def test_patched_files_are_the_edited_ones(spark):
    cases = [edited(seed, 60, 0.2) for seed in range(20)] + [edited(99, 6_000, 0.1)]
    rows = [(old, diff) for old, _, diff in cases]
    for by_number in (False, True):
        assert run(spark, rows, use_line_number=by_number) == [new for _, new, _ in cases]


def test_hunks_by_number_in_any_order_or_none(spark):
    """Hunks that fit or not, behind the file or over its end: in order, each for itself is as one by one."""
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        file = "\n".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        hunks, at = [], 0
        for _ in range(rng.randrange(1, 5)):
            at += rng.randrange(1, 4)
            old = [rng.choice("ab") for _ in range(rng.randrange(0, 3))]
            size = len(old) if rng.random() < 0.8 else 3
            body = "".join(f"-{x}\n" for x in old) + "".join("+new\n" for _ in range(rng.randrange(0, 3)))
            hunks.append(f"@@ -{at},{size} +1,1 @@\n{body}")
            at += len(old) - 1
        rows.append((file, "".join(hunks)))
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, f string, d string")
    hunks = patches.parsed(F.col("d"))
    got = df.select(patches._by_line(F.col("f"), hunks).alias("a"), patches._line_fold(F.col("f"), hunks).alias("b"), "f")
    made = got.collect()
    assert [r["a"] for r in made] == [r["b"] for r in made]
    assert sum(r["a"] != r["f"] for r in made) > 50


def test_a_diff_of_two_files_gives_the_new_one(spark):
    old = [f"line {i}" for i in range(40)]
    new = old[:10] + ["added", "two"] + old[12:30] + old[33:]
    diff = (
        "@@ -10,3 +10,3 @@\n line 9\n-line 10\n-line 11\n+added\n+two\n"
        "@@ -30,4 +30,1 @@\n line 29\n-line 30\n-line 31\n-line 32\n"
    )
    rows = [("\n".join(old), diff)]
    assert run(spark, rows) == ["\n".join(new)]
    diff = diff.replace("-10,3 +10,3", "-10,3 +10,3")
    assert run(spark, rows, use_line_number=True) == ["\n".join(new)]


#: The same diffs taken at their line numbers: a hunk that doesn't fit there does nothing.
BY_LINE = [
    "one\nTWO\nthree\nfour\ntwo", "one\n2\ntwo and\nthree\nfour\ntwo", FILE, FILE, "top\n" + FILE,
    "not on top\none\n2\nthree\nfour\ntwo", FILE, "one\ntwo\nthree\nfour\n2", FILE, FILE, FILE, FILE,
    "two\nthree\nfour\ntwo",
]


def test_apply_by_line(spark):
    assert run(spark, [(FILE, d) for d in DIFFS], use_line_number=True) == BY_LINE
    assert run(spark, [("ADDFILE", DIFFS[0])], use_line_number=True) == [""]


def document(file, diff):
    return f"<NME> a.py\n<BEF> {file}\n<MSG> fix\n<DFF> {diff}"


STATES = [
    (document(FILE, "@@ -2,1 +2,1 @@\n-two\n+TWO"), 0),
    (document(FILE, "@@ -2,1 +2,1 @@\n-absent\n+TWO"), 1),
    (document(FILE, "@@ -2,1 +2,1 @@\n-tw\n+TWO"), 1),
    (document(FILE, "@@ -2,2 +2,1 @@\n-two\n+TWO"), 2),
    (document(FILE, "@@ -0,0 +2,1 @@\n+TWO"), 3),
    (document("", "@@ -0,0 +2,1 @@\n+TWO"), 2),
    (document(FILE, "@@ -2,2 +2,1 @@\n-absent\n+TWO"), 3),
    ("plain text", 4),
    (document(FILE, "x").replace("<DFF>", "<DIFF>"), 4),
    (document(FILE, "@@ -2,1 +2,1 @@\n-two\n+TWO\nforeign"), 5),
    (document(FILE, "@@ - + @@\n-two\n+TWO"), 6),
    (document(FILE, "@@ - + @@\n-two\nforeign"), 7),
    (document("ADDFILE", "@@ -0,0 +1,2 @@\n+a\n+b"), 0),
    (document("ADDFILE", "@@ -0,0 +1,1 @@\n+a\n+b"), 6),
    (document("ADDFILE", "@@ -0,0 +1,1 @@\n+a\n@@ -0,0 +1,1 @@\n+a"), 6),
    (document("ADDFILE", "nothing"), 0),
    (document(FILE, "nothing"), 0),
    (document(FILE, "pre\n@@ -2,1 +2,1 @@\n-two\n+TWO"), 7),
    (document("<MSG> x\n" + FILE, "@@ -3,1 +3,1 @@\n-two\n+TWO"), 0),
]


def test_states(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(STATES)], "i int, d string")
    rows = patches.validity(df, "d", "s").orderBy("i").collect()
    assert [r["s"] for r in rows] == [s for _, s in STATES]
    names = df.select(patches.state_name(F.lit(5)).alias("n")).first()["n"]
    assert names == "BAD_DIFF_HUNK_FORMAT"


def test_fields(spark, apply):
    text = document("a\nb\n<MSG> fake\nc", "d\ne")
    (got, none, empty) = apply(lambda d: patches.fields(d.text), [text, "<NME> a\nx", document("", "")])
    assert got.asDict() == {
        "name": "a.py", "file": "a\nb", "message": "fake\nc\n<MSG> fix", "diff": "d\ne",
    }
    assert none is None
    assert empty.asDict() == {"name": "a.py", "file": "", "message": "fix", "diff": ""}


def test_clip(apply):
    texts = ["@@ -1 +1 @@\n-a\n+b\nforeign\n+c", "+a\n/b\n=c", "a <NME> b", "x\n\ny", "+é\né"]
    want = ["@@ -1 +1 @@\n-a\n+b", "+a\n/b\n=c", "a ", "x", "+é"]
    assert apply(lambda d: patches.clip(d.text), texts) == want


def test_carried_diff(apply):
    got = apply(lambda d: patches.carried_diff(d.text), [document("f", "@@ -1 +1 @@\n-f\n+g\nend"), "none"])
    assert got == ["@@ -1 +1 @@\n-f\n+g", None]


@pytest.mark.parametrize("info,want", [
    ("@@ -1,2 +3,4 @@", (1, 2, 3, 4)), ("@@ -1 +3 @@", (1, 1, 3, 1)), ("@@ - +3 @@", None), ("x", None),
    ("@@ -1,, +3 @@", (1, 1, 3, 1)),
])
def test_line_info(apply, info, want):
    (got,) = apply(lambda d: patches.line_info(d.text), [info])
    assert (got and tuple(got)) == want
