from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from tallymill.functions import tokens as tok
from tallymill.operators import bleu, metrics


def outcomes(spark, counts):
    rows = [(p, s, s < c) for p, (n, c) in enumerate(counts) for s in range(n)]
    return spark.createDataFrame(rows, "p long, s long, ok boolean")


def test_pass_at_k_is_the_combinatorial_chance(spark):
    for n in range(1, 9):
        counts = [(n, c) for c in range(n + 1)]
        got = {r["metric"]: r["score"] for r in metrics.pass_at_k(
            outcomes(spark, counts), ["p"], F.col("ok"), ks=tuple(range(1, n + 3))
        ).collect()}
        assert set(got) == {f"pass@{k}" for k in range(1, n + 1)}
        for k in range(1, n + 1):
            want = sum(1 - comb(n - c, k) / comb(n, k) for _, c in counts) / len(counts)
            assert math.isclose(got[f"pass@{k}"], want, abs_tol=1e-12)
        assert sorted(got.values()) == [got[f"pass@{k}"] for k in range(1, n + 1)]


def test_pass_at_100(spark):
    got = metrics.pass_at_k(outcomes(spark, [(200, 3)]), ["p"], F.col("ok"), ks=(100,)).first()
    assert math.isclose(got["score"], 1 - comb(197, 100) / comb(200, 100), rel_tol=1e-12)


def test_golden_scores(spark):
    one_in_four = outcomes(spark, [(1, 1), (1, 0), (1, 0), (1, 0)])
    assert metrics.pass_at_k(one_in_four, ["p"], F.col("ok")).first()["score"] == 0.25
    canonical = outcomes(spark, [(1, 1)] * 4)
    assert metrics.pass_at_k(canonical, ["p"], F.col("ok")).first()["score"] == 1.0


def test_pass_needs_status_and_exit_code(spark):
    df = spark.createDataFrame([("OK", 0), ("OK", 1), ("Exception", 0)], "s string, e int")
    assert [r[0] for r in df.select(metrics.is_pass(F.col("s"), F.col("e"))).collect()] == [True, False, False]


def test_macro_average(spark):
    scores = spark.createDataFrame(
        [("a", "pass@1", 0.5), ("b", "pass@1", 1.0), ("a", "pass@10", 1.0)], "g string, metric string, score double"
    )
    got = {(r["g"], r["metric"]): r["score"] for r in metrics.macro_average(scores, "g", "metric", "score").collect()}
    assert got["all", "pass@1"] == 0.75 and got["num_correct", "pass@1"] == 1.5 and got["all", "pass@10"] == 1.0


def test_robust_pass(spark):
    rows = [
        ("t", 1, 0, 0, True), ("t", 1, 0, 1, True), ("t", 1, 1, 0, True), ("t", 1, 1, 1, False),
        ("t", 2, 0, 0, True), ("t", 2, 0, 1, False), ("t", 2, 1, 0, True),
        ("u", 1, 0, 0, False),
    ]
    df = spark.createDataFrame(rows, "v string, p long, seed long, s long, ok boolean")
    got = {r["v"]: r for r in metrics.robust_pass(
        df, variant="v", problem="p", seed="seed", sample="s", passed=F.col("ok")
    ).collect()}
    assert got["t"]["score"] == (0.5 + 1.0) / 2 and got["t"]["uneven"] == 1
    assert got["u"]["score"] == 0.0
    alt = {r["v"]: r["score"] for r in metrics.alt_robust_pass(
        df, variant="v", problem="p", seed="seed", passed=F.col("ok")
    ).collect()}
    assert alt["t"] == (1.0 * 0.5 + 0.5 * 1.0) / 2


def plain_vote(answers):
    good = [a for _, a in sorted(answers, key=lambda x: x[0]) if a is not None and not a.startswith("failed:")]
    good = good or [""]
    return Counter(good).most_common()[0][0], good[0]


def test_votes_and_first_answers(spark):
    random.seed(5)
    pool = ["1", "2", "3", None, "failed: x", "nan", "1_000", "1d", ""]
    rows = [(task, i, random.choice(pool)) for task in range(60) for i in range(random.randrange(1, 9))]
    rows += [(60, 0, None), (60, 1, "failed:")]
    df = spark.createDataFrame(rows, "task long, i long, a string")
    by_task = defaultdict(list)
    for task, i, a in rows:
        by_task[task].append((i, a))
    votes = {r["task"]: r["a"] for r in metrics.voted_answers(df, "task", "i", "a").collect()}
    first = {r["task"]: r["a"] for r in metrics.first_answers(df, "task", "i", "a").collect()}
    for task, answers in by_task.items():
        assert (votes[task], first[task]) == plain_vote(answers)


def test_answer_accuracy(spark):
    chosen = spark.createDataFrame(
        [(0, "1.0005"), (1, "x"), (2, "nan"), (3, "1_000"), (4, "")], "task long, a string"
    )
    targets = spark.createDataFrame([(i, t) for i, t in enumerate([1.0, 1.0, 1.0, 1000.0, 0.0])], "task long, t double")
    row = metrics.answer_accuracy(chosen, targets, "task", "a", "t").first()
    assert row["accuracy"] == 0.4 and row["num_failed_execution"] == 2


def test_exact_match(spark):
    df = spark.createDataFrame([(0, "a", "a"), (0, "b", "a"), (1, "c", "c"), (1, "c", "c")], "p long, g string, r string")
    row = metrics.exact_match(df, "p", F.col("g"), F.col("r")).first()
    assert row["score"] == 0.75 and row["equal_samples"]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([2.0, 1.0], 1)], "s array<double>, l int")
    assert [r[0] for r in df.select(metrics.argmax(F.col("s"))).collect()] == [1, 0]
    assert metrics.accuracy(df, metrics.argmax(F.col("s")), F.col("l")).first()["accuracy"] == 0.5


def test_first_by_text(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "t string, i long, v string")
    got = {r["t"]: r["v"] for r in metrics.first_by_text(df, "t", "i", ["v"]).collect()}
    assert got == {"a": "y", "b": "z"}


def test_reference_counts(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "p long")
    b = spark.createDataFrame([(2, "r"), (3, "s")], "p long, ref string")
    rows = metrics.reference_counts(a, b, ["p"]).collect()
    got = sorted((r["p"], r["samples"], r["ref"], r["side"]) for r in rows)
    assert got == [(1, 1, None, "completions"), (2, 2, "r", "both"), (3, 0, "s", "references")]
    joined = metrics.join_references(a, b, ["p"])
    assert [(r["p"], r["ref"]) for r in joined.collect()] == [(2, "r"), (2, "r")]


TINY = 2.2250738585072014e-308


def plain_counts(words):
    return Counter(tuple(words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))


def plain_score(cand, most, reflen):
    counts, total = plain_counts(cand), 0.0
    for k in range(1, 5):
        hits = sum(min(n, most.get(g, 0)) for g, n in counts.items() if len(g) == k)
        guess, extra = max(len(cand) - k + 1, 0), int(k > 1)
        total += math.log(hits + extra + TINY) - math.log(guess + extra + TINY)
    return math.exp(total / 4 + min(0, 1 - (reflen + 1) / (len(cand) + 1)))


def sentences(seed, count):
    random.seed(seed)
    return [[random.choice("a b c d e".split()) for _ in range(random.randrange(0, 12))] for _ in range(count)]


def test_sentence_bleu(spark):
    cands, refs = sentences(1, 40), sentences(2, 40)
    cands[0], refs[1] = [], []
    df = spark.createDataFrame(
        [(i, c, r) for i, (c, r) in enumerate(zip(cands, refs))],
        "id long, candidate array<string>, reference array<string>",
    )
    got = {r["id"]: r["bleu"] for r in bleu.sentence_bleu(df, ["id"]).collect()}
    for i, (c, r) in enumerate(zip(cands, refs)):
        assert got[i] == pytest.approx(plain_score(c, plain_counts(r), len(r)), rel=1e-9), i


def test_pairs_are_matched_inside_their_rows(spark):
    df = spark.createDataFrame(
        [(0, "a a a b".split(), "a a c".split()), (1, None, ["a"]), (2, [], [])],
        "id long, candidate array<string>, reference array<string>")
    counts = bleu.clipped_counts(df, ["id"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Aggregate", "Exchange", "Generate") if node in plan]
    got = {r["id"]: [r[f"m{k}"] for k in range(1, 5)] for r in counts.collect()}
    assert got == {0: [2, 1, 0, 0], 1: [0] * 4, 2: [0] * 4}


def test_bleu_of_a_text_with_itself(spark):
    words = "the cat sat on the mat".split()
    df = spark.createDataFrame([(0, words, words)], "id long, candidate array<string>, reference array<string>")
    assert bleu.mean_bleu(bleu.sentence_bleu(df, ["id"])).first()["bleu"] == pytest.approx(100.0)
    assert bleu.corpus_bleu(df, ["id"]).first()["bleu"] == pytest.approx(1.0)


@pytest.mark.parametrize("rule", ["shortest", "average", "closest"])
def test_multi_reference_bleu(spark, rule):
    cands = {i: c for i, c in enumerate(sentences(3, 12))}
    refs = {i: sentences(10 + i, random.randrange(1, 4)) for i in cands}
    c = spark.createDataFrame(list(cands.items()), "id long, words array<string>")
    r = spark.createDataFrame(
        [(i, n, w) for i, ws in refs.items() for n, w in enumerate(ws)], "id long, n long, words array<string>"
    )
    got = {x["id"]: x["bleu"] for x in bleu.multi_reference_bleu(c, r, "id", "n", rule).collect()}
    for i, cand in cands.items():
        most = Counter()
        for w in refs[i]:
            most |= plain_counts(w)
        sizes = [len(w) for w in refs[i]]
        length = {
            "shortest": min(sizes), "average": sum(sizes) / len(sizes),
            "closest": min(sizes, key=lambda s: abs(s - len(cand))),
        }[rule]
        assert got[i] == pytest.approx(plain_score(cand, most, length), rel=1e-9), (i, rule)


def test_normalisation(apply):
    texts = ["Hello, World. 3.14 1,000 x-y 5-6 don't a_b <b>&amp;&lt;&quot; end-\nline", "", "a\tb"]
    got = apply(lambda d: bleu.normalise(d.text), texts)
    assert got[0] == (
        "hello , world . 3.14 1,000 x-y 5 - 6 don't a _ b < b > & < \" endline"
    ).split()
    assert got[1] == [] and got[2] == ["a", "b"]
    assert apply(lambda d: bleu.prepare(d.text), ["A, b\tc"]) == ["a , b"]


def test_ngram_guard(apply):
    got = apply(lambda d: F.size(bleu.all_ngrams(tok.words(d.text))), ["", "a", "a b", "a b c d e"])
    assert got == [0, 1, 3, 14]
