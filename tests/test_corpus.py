from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import tokens as tok
from tallymill.operators import corpus, edits, selection
from tallymill.operators.numbering import number_rows, running_total

TEXTS = [
    (0, "one line"), (1, ""), (2, "\n\n"), (3, "#!/bin/sh\nx"), (4, "<meta>\n#!/bin/sh\n"),
    (5, "<meta>\nx = 1\n"), (6, "<only"), (7, "<a\rb\nrest"), (8, "x = 1\n<b>"), (9, "if (:\n"),
]


@pytest.fixture()
def files(spark):
    return spark.createDataFrame(TEXTS, "id long, content string")


def test_reject_reasons(files):
    got = {r["reason"]: r["rows"] for r in corpus.reject_counts(files).collect()}
    assert got == {"no_newline": 3, "shebang": 2, "kept": 5}


def test_clean_cuts_only_the_meta_line(files):
    got = {r["id"]: r["content"] for r in corpus.clean(files).collect()}
    assert got == {2: "\n\n", 5: "x = 1\n", 7: "rest", 8: "x = 1\n<b>", 9: "if (:\n"}


def test_popularity_is_strict(spark):
    df = spark.createDataFrame([(100, "a\n"), (101, "b\n")], "stars long, content string")
    assert [r["content"] for r in corpus.clean(df, popularity="stars").collect()] == ["b\n"]


def test_parseable(files):
    kept = corpus.parseable(corpus.clean(files))
    assert sorted(r["id"] for r in kept.collect()) == [2, 5, 7]


def test_token_report(files):
    rows = corpus.token_report(files).collect()
    words = {r["tokenizer"]: r for r in rows}["words"]
    assert words["rows"] == 10 and words["kept_rows"] == 5
    import re

    rule = re.compile(f"{tok.SPECIALS}|\\w+|[^\\s\\w]")
    assert words["code_tokens"] == sum(len(rule.findall(s)) for _, s in TEXTS)
    kept = [s for i, s in TEXTS if i in (2, 5, 7, 8, 9)]
    assert words["filtered_code_tokens"] == sum(len(rule.findall(s)) for s in kept)


def test_token_report_without_kept_rows(spark):
    df = spark.createDataFrame([("x",)], "content string")
    assert {r["ratio"] for r in corpus.token_report(df).collect()} == {None}


def test_vocabulary_has_every_token(files):
    got = {r["token"]: r["uses"] for r in corpus.vocabulary_use(
        files.select(tok.rewrite_vocabulary(F.col("content")).alias("content"))
    ).collect()}
    assert len(got) == 78 and got["<if_stmt>"] == 1 and got["<try_stmt>"] == 0


def test_splits(spark):
    ids = spark.range(20_000)
    two = {r["s"]: r["count"] for r in ids.groupBy(corpus.split_two(F.col("id")).alias("s")).count().collect()}
    assert abs(two["valid"] - 1000) < 120
    three = {r["s"]: r["count"] for r in ids.groupBy(corpus.split_three(F.col("id")).alias("s")).count().collect()}
    assert abs(three["train"] - 16_000) < 300 and abs(three["test"] - three["valid"]) < 250


def test_apply_edits(spark):
    docs = spark.createDataFrame([(1, "0123456789"), (2, "é😀xyz"), (3, "same"), (4, "")], "doc_id long, text string")
    rows = [
        (1, 2, 6, "AB"), (1, 3, 4, "inner"), (1, 5, 8, "overlap"), (1, 8, 8, "empty"), (1, 9, 10, ""),
        (2, 0, 1, "e"), (2, 1, 2, "_"), (2, 1, 2, "_"),
    ]
    spans = spark.createDataFrame(rows, "doc_id long, start long, end long, new_str string")
    got = {r["doc_id"]: r["text"] for r in edits.apply(docs, spans).collect()}
    assert got == {1: "01Ainner678", 2: "e_xyz", 3: "same", 4: ""}


def test_contained_edits_fold_into_their_container(spark):
    docs = spark.createDataFrame([(1, "0123456789")], "doc_id long, text string")
    rows = [(1, 2, 6, "ABCD"), (1, 3, 4, "x"), (1, 5, 6, "y"), (1, 8, 9, "Z")]
    spans = spark.createDataFrame(rows, "doc_id long, start long, end long, new_str string")
    assert edits.apply(docs, spans).first()["text"] == "01AxCy67Z9"
    beyond = spark.createDataFrame([(1, 0, 9, "ab"), (1, 1, 2, "-"), (1, 6, 7, "+")], spans.schema)
    assert edits.apply(docs, beyond).first()["text"] == "a-+9"


def test_apply_edits_on_a_long_text(spark):
    text = "abcdé" * 1000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = spark.createDataFrame(
        [(1, i, i + 2, f"<{i}>") for i in range(0, 5000, 3)], "doc_id long, start long, end long, new_str string"
    )
    want, at = [], 0
    for i in range(0, 5000, 3):
        want += [text[at:i], f"<{i}>"]
        at = i + 2
    want.append(text[at:])
    assert edits.apply(docs, spans).first()["text"] == "".join(want)


SPANS = "doc_id long, start long, end long, new_str string"


def folded_by_hand(text, rows):
    """Left out: what starts inside another edit and ends behind it. The rest folds from the inside out."""
    kept = sorted({r for r in rows if 0 <= r[0] < r[1]}, key=lambda r: (r[0], -r[1], r[2]))
    kept = [e for e in kept if not any(f[0] < e[0] < f[1] < e[1] for f in kept)]

    def replaced(base, first, inside):
        out, at = "", 0
        while inside:
            low, high, new = inside[0]
            own = [e for e in inside[1:] if e[1] <= high]
            inside = [e for e in inside[1:] if e[1] > high]
            out += base[at:max(low - first, at)] + replaced(new, low, own)
            at = high - first
        return out + base[at:]

    return replaced(text, 0, kept)


def test_edits_of_three_levels_and_crossing_ones(spark):
    docs = spark.createDataFrame([(1, "0123456789"), (2, "0123456789"), (3, None)], "doc_id long, text string")
    rows = [(1, 2, 10, "ABCDEFGH"), (1, 3, 8, "vwxyz"), (1, 4, 6, "!"), (2, 2, 6, "ABCD"), (2, 4, 8, "late"), (3, 0, 1, "x"),
            (2, 8, 8, "none"), (2, None, 3, "x"), (2, -1, 2, "y"), (2, 2, 6, "ABCD"), (9, 0, 1, "no text")]
    spans = spark.createDataFrame(rows, SPANS)
    got = {r["doc_id"]: r["text"] for r in edits.apply(docs, spans).collect()}
    assert got == {1: "01Av!yzGH", 2: "01ABCD6789", 3: None}
    states = sorted((r["doc_id"], r["status"], r["depth"]) for r in edits.forest(spans).where("doc_id = 2").collect())
    assert states == [(2, "applied", 0), (2, "crossing", None), (2, "empty", None), (2, "empty", None), (2, "outside", None)]


def test_random_forests(spark, monkeypatch):
    import random

    random.seed(11)
    monkeypatch.setattr(edits, "SWEEP", 7)
    monkeypatch.setattr(edits, "CHUNK", 5)
    docs, rows = [], []
    for doc in range(60):
        text = "".join(random.choices("abé😀z", k=random.randint(0, 40)))
        docs.append((doc, text))
        for _ in range(random.randint(0, 25)):
            start = random.randint(-1, 42)
            rows.append((doc, start, start + random.choice([0, 1, 2, 3, 5, 9, 20]), "".join(random.choices("XYZ", k=random.randint(0, 12)))))
    got = edits.apply(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, SPANS)).collect()
    for r in got:
        assert r["text"] == folded_by_hand(docs[r["doc_id"]][1], {x[1:] for x in rows if x[0] == r["doc_id"]})
    assert len(got) == 60


def test_edits_of_one_range_are_swept_and_folded_once(spark, monkeypatch):
    names, staged = [], edits.staged
    monkeypatch.setattr(edits, "staged", lambda df, name: names.append(name) or staged(df, name))
    docs = spark.createDataFrame([(1, "0123456789"), (None, "as it is"), (2, "plain")], "doc_id long, text string")
    rows = [(1, 2, 10, "ABCDEFGH"), (1, 3, 8, "vwxyz"), (1, 4, 6, "!"), (1, 4, 6, "!")]
    got = edits.apply(docs, spark.createDataFrame(rows, SPANS)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: "01Av!yzGH", None: "as it is", 2: "plain"}
    assert names == ["spans"]


def test_a_million_edits_of_one_document(spark):
    n = 500_000
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("0123456789"), n).alias("text"))
    at = (F.col("id") * 10)
    outer = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), at.alias("start"), (at + 4).alias("end"), F.lit("ABCD").alias("new_str"))
    inner = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (at + 1).alias("start"), (at + 2).alias("end"), F.lit("-").alias("new_str"))
    text = edits.apply(docs, outer.union(inner)).first()["text"]
    assert text == "A-CD456789" * n


def test_cancel(spark):
    schema = "doc_id long, start long, end long, content string"
    spans = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "b"), (2, 0, 1, "a")], schema)
    gone = spark.createDataFrame([(1, 0, 1, "a")], schema)
    assert edits.cancel(spans, gone).count() == 2


@pytest.mark.parametrize("ranges,hot", [(1, 1), (3, 100), (64, 1), (64, 10**6)])
def test_numbering_with_a_hot_group(spark, ranges, hot):
    import random

    random.seed(1)
    keys = random.sample(range(10**12), 500)
    rows = [(k, "hot" if i % 3 else f"g{i % 7}", i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    got = {r["k"]: (r["n"], r["m"]) for r in number_rows(
        number_rows(df, "k", into="n", ranges=ranges), "k", into="m", groups=["g"], ranges=ranges, hot=hot
    ).collect()}
    seen: dict[str, int] = {}
    for n, (k, g, _) in enumerate(sorted(rows), 1):
        seen[g] = seen.get(g, 0) + 1
        assert got[k] == (n, seen[g])


def test_numbering_with_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k long, g string")
    for hot in (1, 10):
        got = {r["k"]: r["n"] for r in number_rows(df, "k", into="n", groups=["g"], hot=hot).collect()}
        assert got == {1: 1, 2: 2, 3: 1}


def test_running_total(spark):
    df = spark.createDataFrame([(3.5, 2), (1.0, 5), (2.0, 1)], "k double, v long")
    got = {r["k"]: r["front"] for r in running_total(df, "k", "v", into="front").collect()}
    assert got == {1.0: 0, 2.0: 5, 3.5: 6}


def test_problem_slice(spark):
    df = spark.range(10)
    assert selection.problem_slice(df, "id", 7).count() == 3
    assert selection.problem_slice(df, "id", 2, 3).count() == 3
    assert selection.problem_slice(df, "id", 8, 5).count() == 2


def test_head_needs_a_key(spark):
    df = spark.range(50).repartition(8)
    assert [r["id"] for r in selection.head(df, "id", 3).orderBy("id").collect()] == [0, 1, 2]


def test_task_table(spark):
    table = selection.task_table(spark)
    assert table.count() == 135 == len(set(fixed.task_names()))
    picked = selection.select_tasks(table, "mbpp,multiple-*,multiple-p?")
    assert picked.count() == 20
    with pytest.raises(ValueError):
        selection.check_patterns("mbpp,no-such-*")


def test_stops_by_style():
    assert fixed.stops_for("humanevalfixtests-python", "starchat")[-2:] == ["<|end|>", "<|endoftext|>"]
    assert fixed.stops_for("humanevalfixtests-go", "diff") == [
        "<commit_before>", "<commit_msg>", "<commit_after>", "<|endoftext|>"
    ]
    assert fixed.stops_for("quixbugs", "edit")[0] == "<commit_before>"
    # The shared lists are never changed by a style.
    assert "<|endoftext|>" not in fixed.PACK_STOPS["python"]


def test_expectations(spark):
    assert selection.expect_rows(spark.range(3), 3).first()["rows"] == 3
    with pytest.raises(Exception, match="expected 4 rows"):
        selection.expect_rows(spark.range(3), 4).collect()
    modes = spark.createDataFrame([("infill",), ("completion",)], "mode string")
    with pytest.raises(Exception, match="mixed"):
        selection.one_mode(modes, F.col("mode")).collect()


def test_first_seeds(spark):
    df = spark.range(6).withColumnRenamed("id", "seed")
    assert selection.first_seeds(df, "seed", 4).count() == 4


def test_library_subsets(spark):
    df = spark.createDataFrame([("Numpy",), ("Matplotlib",)], "library string")
    assert selection.library_subset(df, "All", "Insertion").count() == 1
    assert selection.library_subset(df, "All", "Completion").count() == 2
    assert selection.library_mode("Matplotlib", "Insertion") == "Completion"
