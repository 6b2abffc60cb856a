from __future__ import annotations

import fnmatch
import re

from pyspark.sql import functions as F

from tallymill.functions import text as t
from tallymill.functions import tokens as tok

ODD = [
    "", "\n", "\n\n\n", " \t a b \r\n", "  x　", "é\x85", "no newline",
    "a\rb\nrest", "😀 tail 😀", "\x1cx\x1f", "​kept​",
]


def test_strip_equals_python(apply):
    assert apply(lambda d: t.strip(d.text), ODD) == [s.strip() for s in ODD]
    assert apply(lambda d: t.rstrip(d.text), ODD) == [s.rstrip() for s in ODD]
    assert apply(lambda d: t.lstrip(d.text), ODD) == [s.lstrip() for s in ODD]


def test_find_and_cuts(apply):
    texts = ["", "ab", "a--b--c", "--", "x--", "--x", "😀--😀"]
    assert apply(lambda d: t.find(d.text, "--"), texts) == [s.find("--") + 1 for s in texts]
    assert apply(lambda d: t.rfind(d.text, "--"), texts) == [s.rfind("--") + 1 for s in texts]
    assert apply(lambda d: t.before(d.text, "--"), texts) == [s.split("--")[0] for s in texts]
    assert apply(lambda d: t.after_last(d.text, "--"), texts) == [s.split("--")[-1] for s in texts]
    assert apply(lambda d: t.after(d.text, "--"), texts) == [s.split("--", 1)[-1] for s in texts]
    assert apply(lambda d: t.count_of(d.text, "--"), texts) == [s.count("--") for s in texts]
    for n in (1, 2):
        assert apply(lambda d, n=n: t.after_splits(d.text, "--", n), texts) == [
            s.split("--", n)[-1] for s in texts
        ]


def test_glob_matches_the_shell_rules(apply):
    names = ["mbpp", "multiple-py", "multiple-js", "ds1000-all", "a[b", "MBPP", "x\ny"]
    for pattern in ["*", "m*", "multiple-??", "multiple-[jp]?", "multiple-[!j]*", "a[[]b", "x?y", "a["]:
        want = [fnmatch.fnmatchcase(name, pattern) for name in names]
        assert apply(lambda d, p=pattern: t.matches_glob(d.text, p), names) == want, pattern


def test_first_filled(apply):
    rows = [("", "b"), (None, "b"), ("a", "b")]
    got = apply(lambda d: t.first_filled(d.a, d.b), rows, "i long, a string, b string")
    assert got == ["b", "b", "a"]


def test_hash_bucket_is_even_and_repeatable(spark):
    df = spark.range(20_000).select(t.hash_bucket(F.col("id"), 10).alias("b"))
    counts = [r["count"] for r in df.groupBy("b").count().collect()]
    assert len(counts) == 10 and min(counts) > 1800 and max(counts) < 2200


def test_words_equal_python(apply):
    texts = ODD + ["don't stop_me 3.14 é-ü", "a\xa0b", "x²½", "日本 語"]
    want = [re.findall(r"[\w]+|[^\s\w]", s) for s in texts]
    assert apply(lambda d: tok.words(d.text), texts) == want


def test_rewrite_changes_only_vocabulary(apply):
    code = {
        "if a not in b:\n    return x is not None\n":
            "<if_stmt> a <notin> b:\n    <return> x <isnot> <none>\n",
        "x = 1 if y else 2": "x = 1 <if> y <else> 2",
        "for i in z:\n  pass\nelse:\n  pass": "<for_stmt> i <in> z:\n  <pass>\n<else_stmt>:\n  <pass>",
        "s = 'if not in' # is not and\n": "s = 'if not in' # is not and\n",
        'd = """\nfor x\n"""\nimport a\nfrom b import c':
            'd = """\nfor x\n"""\n<import_stmt> a\n<import_from_stmt> b import c',
        "a //= 2 // 3 >>= 1 -> ...": "a <augfloordiv> 2 <floordiv> 3 <augrshift> 1 <arrow> <ellipsis>",
        r"t = 'it\'s if' + \"x\"": r"t = 'it\'s if' + \"x\"",
        "notin = island + forge": "notin = island + forge",
        "async def f(): await g(lambda: 1)":
            "<async_keyword> <def_stmt> f(): <await> g(<lambda>: 1)",
        "print(match, case)\nmatch x:": "print(match, case)\n<match_stmt> x:",
        "a < b <= c == d != e": "a <l> b <le> c <eq> d <ne> e",
        "": "",
    }
    assert apply(lambda d: tok.rewrite_vocabulary(d.text), list(code)) == list(code.values())


def test_rewrite_survives_long_texts(apply):
    long = "'" + "\\'" * 50_000 + "' if x" + " " * 50_000 + "y"
    (got,) = apply(lambda d: tok.rewrite_vocabulary(d.text), [long])
    assert got == long.replace("' if x", "' <if> x")


COMPACTED = [
    "a+b", "a b", "x=[1,2];y", "f g", "a * b c", "<def_stmt>x", "x<if_stmt>y", "x<line_sep>y", " ", "éa",
    'say "x" "y"',
]


def test_compaction(apply):
    texts = [
        "a  +  b", "a \\\n b", "x = [1,  2] ;  y", "f <SPACE> g", "a * b  c",
        "<def_stmt> <line_sep><line_sep> x", "x <line_sep> <if_stmt> y", "x <line_sep> y",
        "   ", "é  a", 'say "x"  "y"',
    ]

    assert apply(lambda d: tok.compact(d.text), texts) == COMPACTED


def test_rewrite_compact_restores_strings_and_comments(apply):
    texts = ["x = 'a   b'  +  y", "x  =  1 # keep   this\ny = 2", "z"]
    got = apply(lambda d: tok.rewrite_compact(d.text), texts)
    assert got[0] == "x='a   b'+y"
    assert "# keep   this\n" in got[1]
    assert got[2] == "z"
