"""Restoring disguised words, and scores on held-out and awkward rows."""

from __future__ import annotations

import itertools
import random
import zlib

import pytest

from tallymill.llm import toxicity
from tallymill.llm.queries import QUERIES
from tallymill.llm.shared import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.letter_costs(toxicity.count_trigrams("text", table(spark, DATA, "documents"))))


@pytest.mark.parametrize("written, meant", [
    ("1d10t", "idiot"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("w0rthle$$", "worthless"),
    ("l.o.s.e.r", "loser"), ("i d i o t", "idiot"), ("scum***", "scum"), ("SCUM", "scum")])
def test_disguised_words_are_restored(restorer, written, meant):
    assert meant in restorer.words(f"so {written} there")


def test_plain_words_stay(restorer):
    assert restorer.words("plain words, zoo 12 555-7209 ***") == {"plain", "words", "zoo"}


def test_long_masks_and_runs_are_linear(restorer):
    restorer.words("a" + "*" * 50_000 + "b " + "x" * 100_000 + " " + "s 0 " * 20_000)


def test_scores_of_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, DATA).collect()}
    labels = [(r.doc_id, r.toxic) for r in table(spark, DATA, "labels").collect()]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[d].score, y) for d, y in labels if got[d].held_out]
    good = [s for s, y in held if y]
    bad = [s for s, y in held if not y]
    rank = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert rank > 0.85
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.9


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == awkward.count()
    assert len({r.score for r in got if r.doc_id in (9, 10)}) == 1
    assert toxicity.toxicity(awkward.limit(0), labels).collect() == []
    alone = toxicity.toxicity(awkward, labels.limit(0)).collect()
    assert {r.predicted for r in alone} == {0} and len({r.score for r in alone}) == 1
    assert toxicity.without_toxic(awkward, labels.limit(0)).count() == awkward.count()


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    turned = labels.withColumn("toxic", toxicity.F.when(
        toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    a, b = (toxicity.toxicity(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_the_sample_bounds_rows_of_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda own, held: held)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:10]
    rows = [(ids[0], f"text {n}") for n in range(50)] + [(i, f"own {i}") for i in ids] + [(ids[1], None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    held = [sorted((r.doc_id, r.text or "", r.label) for r in toxicity.learned(x, labels).collect())
            for x in (df, df.repartition(7))]
    assert [(d, y) for d, _, y in held[0]] == [(i, i % 2) for i in ids]
    assert held[0] == held[1]
    assert toxicity.learned(df, labels, sample=4).count() == 4


def cheapest(restorer, signs):
    """The least cost over all readings of a run of signs, one word, each reading spelled out."""
    runs, at = [], 0
    while at < len(signs):
        end = at
        while end < len(signs) and signs[end] == signs[at]:
            end += 1
        own, n = signs[at], end - at
        if own in toxicity.MEANT:
            runs += [[(c, toxicity.SWAP_COST) for c in toxicity.MEANT[own]]] * n
        elif n > 2:
            runs.append([(own * k, toxicity.REPEAT_COST) for k in (1, 2)])
        else:
            runs += [[(own, 0.0)]] * n
        at = end
    costs = {}
    for path in itertools.product(*runs):
        word = "".join(c for c, _ in path)
        codes = [0, 0, *(toxicity.LETTERS.find(c) + 1 or toxicity.OTHER for c in word), 0]
        cost = sum(p for _, p in path) + sum(restorer.costs[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))
        costs[word] = min(cost, costs.get(word, cost))
    return costs


@pytest.mark.parametrize("signs", ["1d10t", "tr@sh", "$tuuupid", "a*b", "l0$3r", "!!l1", "xx1!xx", "é1a", "w0rthle$$", "aaa", "111", "8ad!!!"])
def test_the_path_read_is_the_cheapest_of_all(restorer, signs):
    costs = cheapest(restorer, signs)
    assert costs[restorer.read(signs)] == pytest.approx(min(costs.values()))


def test_random_lattices(restorer):
    draw = random.Random(2)
    for _ in range(150):
        signs = "".join(draw.choices("abstouy013457@$!", k=draw.randint(1, 7)))
        costs = cheapest(restorer, signs)
        assert costs[restorer.read(signs)] == pytest.approx(min(costs.values())), signs
