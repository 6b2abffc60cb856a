"""Positive-unlabelled learning: the risk by hand, held-out accuracy, awkward rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from tallymill.llm import quality_model as q
from tallymill.llm.queries import QUERIES
from tallymill.llm.shared import table

DATA = "/root/testdata/sf0.01"


def test_risk_is_the_non_negative_estimate_and_its_slope():
    rng = np.random.default_rng(3)
    for prior, shift in ((0.3, 0.0), (0.9, 0.0), (0.7, 4.0)):
        g_p, g_u = rng.normal(shift, 1, 7), rng.normal(0, 1, 9)
        loss = lambda z: math.log(1 + math.exp(-z))
        mean = lambda z: sum(z) / len(z)
        rest = mean([loss(-g) for g in g_u]) - prior * mean([loss(-g) for g in g_p])
        risk, by_p, by_u = q.risk_gradient(g_p, g_u, prior)
        assert risk == pytest.approx(prior * mean([loss(g) for g in g_p]) + max(0.0, rest))
        if rest < 0:
            continue
        for at, slope in enumerate(by_p):
            moved = g_p.copy()
            moved[at] += 1e-6
            assert (q.risk_gradient(moved, g_u, prior)[0] - risk) / 1e-6 == pytest.approx(slope, abs=1e-5)
        for at, slope in enumerate(by_u):
            moved = g_u.copy()
            moved[at] += 1e-6
            assert (q.risk_gradient(g_p, moved, prior)[0] - risk) / 1e-6 == pytest.approx(slope, abs=1e-5)


def test_risk_below_zero_climbs_back():
    g_p, g_u = np.full(4, 6.0), np.full(4, -3.0)
    _, by_p, by_u = q.risk_gradient(g_p, g_u, 0.9)
    assert (by_p < 0).all() == (by_u > 0).all() and (by_u < 0).all()


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_histograms(prior):
    rng = np.random.default_rng(5)
    clip = lambda x: np.clip(x, 0, q.BINS - 1).astype(int)
    good = lambda n: clip(rng.normal(750, 60, n))
    bad = lambda n: clip(rng.normal(400, 90, n))
    mixed = np.concatenate([good(int(40_000 * prior)), bad(int(40_000 * (1 - prior)))])
    got = q.prior_of(np.bincount(good(5_000), minlength=q.BINS), np.bincount(mixed, minlength=q.BINS))
    assert got == pytest.approx(prior, abs=0.04)


def test_vectors_are_the_shares():
    x = q.features("AB!! cd cd\n|\n")
    shares = np.exp(x[:q.SHARES]) - q.LEAST_SHARE
    assert shares[q.SIGNS.index("!")] == pytest.approx(2 / 13)
    assert shares[q.SIGNS.index("|")] == pytest.approx(1 / 13)
    words = dict(zip(q.WORD_KINDS, x[q.SHARES:]))
    assert words["upper words"] == 1 / 4 and words["words of signs"] == 1 / 4 and words["the word before again"] == 1 / 4
    assert words["lines of one word"] == 1 / 2
    assert (q.features(None) == q.features("")).all() and np.isfinite(q.features("\ud800 x")).all()
    assert np.isfinite(q.features("word " * 200_000)).all()


def test_scores_of_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op12_quality_classifier"](spark, DATA).collect()}
    assert len(got) == table(spark, DATA, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    own = [(r.quality, got[r.doc_id].predicted) for r in table(spark, DATA, "labels").collect()
           if r.doc_id in got and got[r.doc_id].held_out]
    assert len(own) > 100 and sum(a == b for a, b in own) / len(own) > 0.95


def test_labels_of_held_out_rows_and_negatives_are_not_read(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.when(F.col("quality") == 0, None).otherwise(F.col("quality"))))
    keyed = lambda df: {r.doc_id: round(r.score, 9) for r in df.collect()}
    assert keyed(q.quality_scores(docs, labels)) == keyed(q.quality_scores(docs, turned))


def test_awkward_rows(spark, awkward, rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (9, None), (10, 1), (4, 1)],
                                   "doc_id long, quality int")
    got = q.quality_scores(awkward, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]
    assert all(r.held_out for r in got if r.doc_id is None)
    empty = {r.score for r in got if r.doc_id in (2, 3)}
    assert len(empty) == 1
    assert q.quality_scores(awkward.limit(0), labels).collect() == []
    assert {r.score for r in q.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}


def test_a_planted_share_is_learned_without_negatives(spark):
    rng = random.Random(4)
    words = "the of river stone walks along evening light under green hills and slowly".split()

    def text(good: bool) -> str:
        own = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        return (" ".join(own) + ".") if good else " ".join(w + rng.choice(["$$$", "!!", "###"]) for w in own)

    docs = [(i, text(i % 10 < 7)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(600) if i % 10 < 3], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in q.quality_scores(df, labels).collect()}
    assert sum(got[i] == (i % 10 < 7) for i, _ in docs) >= 590
