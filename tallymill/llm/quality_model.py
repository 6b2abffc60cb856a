"""Quality scores from trusted positives and unlabelled text (positive-unlabelled learning).

A text becomes one short vector: shares of kinds of characters and of kinds of words. The vectors
of all texts are written once; everything after works on them. A linear model minimises the
non-negative unbiased risk  pi R+(positives) + max(0, R-(unlabelled) - pi R-(positives))  with
logistic loss. The class prior pi is estimated first: any set of vectors holds at least pi times
the positives' share of it, so the least ratio of the two shares, over sets above a score, bounds
it; the unlabelled shares are those of all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.shared import small_batches, written

#: Signs whose shares of a text are features of their own.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Kinds of characters, then kinds of words; see `_characters` and `_words`.
CHARACTER_KINDS = ("lower", "upper", "digit", "blank", "line end", "other letter", "other sign")
WORD_KINDS = ("upper words", "words with a sign in them", "words of signs", "the word before again",
              "distinct of the last 50 missing", "lines of one word", "short", "long")
SHARES = len(SIGNS) + len(CHARACTER_KINDS) + len(WORD_KINDS)
WIDTH = SHARES + len(WORD_KINDS)
#: A share counts as its logarithm, from this one on; shares of words also count as they are.
LEAST_SHARE = 1e-3
#: Vectors are cut off so many standard deviations from their mean.
FARTHEST = 4.0
BINS = 1_000


def _kind_of_points() -> np.ndarray:
    kinds = np.empty(0x3000, dtype=np.int64)
    for point in range(len(kinds)):
        sign = chr(point)
        if sign in SIGNS:
            kinds[point] = SIGNS.index(sign)
            continue
        kind = ("line end" if sign == "\n" else "blank" if sign.isspace() else "digit" if sign.isdigit()
                else "lower" if sign.islower() else "upper" if sign.isupper()
                else "other letter" if sign.isalpha() else "other sign")
        kinds[point] = len(SIGNS) + CHARACTER_KINDS.index(kind)
    return kinds


_KINDS = _kind_of_points()
_BEYOND = len(SIGNS) + CHARACTER_KINDS.index("other letter")


def _characters(text: str) -> np.ndarray:
    """Share of each sign and each kind of character."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    kinds = np.where(points < len(_KINDS), _KINDS[np.minimum(points, len(_KINDS) - 1)], _BEYOND)
    return np.bincount(kinds, minlength=len(SIGNS) + len(CHARACTER_KINDS)) / len(points)


def _words(text: str) -> np.ndarray:
    """Share of each kind of word, 0 where a text has none."""
    words = text.split()
    if not words:
        return np.zeros(len(WORD_KINDS))
    n, counts = len(words), [0] * len(WORD_KINDS)
    before, last = "", {}
    for at, word in enumerate(words):
        counts[0] += len(word) > 1 and word.isupper()
        core = word.rstrip(".,;:!?")
        if not core.isalnum():
            if any(map(str.isalnum, core)):
                counts[1] += 1
            else:
                counts[2] += 1
        counts[3] += word == before
        counts[4] += at - last.get(word, -51) <= 50
        before = word
        last[word] = at
        counts[6] += len(word) < 3
        counts[7] += len(word) > 15
    lines = [line for line in text.split("\n") if line.strip()]
    counts[5] = sum(len(line.split(None, 1)) == 1 for line in lines) * n / len(lines)
    return np.array(counts) / n


def features(text: str | None) -> np.ndarray:
    """The vector of a text; a null text is an empty one, whose shares are all zero."""
    shares = np.concatenate([_characters(text), _words(text)]) if text else np.zeros(SHARES)
    return np.concatenate([np.log(shares + LEAST_SHARE), shares[-len(WORD_KINDS):]])


def vectors(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, held_out, x) of every row, written to the shared folder: texts are read once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([features(t.as_py()) for t in batch.column(1)], dtype=np.float32).reshape(-1, WIDTH)
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, WIDTH), pa.int32()),
                                         pa.array(own.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(found, f"doc_id {kind}, x array<float>")
    return written(made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x"), "vectors")


def held_out(doc: Column, folds: int = 3, remainder: int = 1) -> Column:
    """Rows that no label may be learned from, by the crc32 of the id as text; null ids among them."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % folds == remainder, F.lit(True))


class Model(NamedTuple):
    """Mean, deviation and weight of each feature, the constant, and the prior of the fit."""

    mean: np.ndarray
    dev: np.ndarray
    weights: np.ndarray
    constant: float
    prior: float

    def placed(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -FARTHEST, FARTHEST)

    def score(self, x: str = "x") -> Column:
        """The model on a vector column, in the JVM."""
        parts = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(d)).alias("d"), F.lit(float(w)).alias("w"))
                          for m, d, w in zip(self.mean, self.dev, self.weights)))
        terms = F.zip_with(F.col(x).cast("array<double>"), parts, lambda a, p: p["w"] * F.greatest(
            F.lit(-FARTHEST), F.least(F.lit(FARTHEST), (a - p["m"]) / p["d"])))
        z = F.aggregate(terms, F.lit(float(self.constant)), lambda total, t: total + t)
        return 1 / (1 + F.exp(-z))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature over all rows."""
    kept = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev")).orderBy("i").collect()
    return np.array([r["mean"] for r in kept]), np.array([max(r["dev"], 1e-6) for r in kept])


def _lowest(rows: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n rows that hash lowest: a sample of bounded size, the same every time.

    Only rows below a hash that leaves about three times n are ordered, so no task sends n rows of
    its own. Where many equal rows share a hash there may be fewer than n.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), "x")
    share = min(1.0, 3 * n / max(rows.count(), 1))
    if share < 1:
        rows = rows.filter(order < int((share - 0.5) * 2**64))
    picked = rows.orderBy(order, F.col("doc_id").cast("string")).limit(n).select("x").collect()
    return np.array([r["x"] for r in picked], dtype=np.float64).reshape(-1, WIDTH)


def risk_gradient(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk and its derivative by the outputs of positives and unlabelled rows.

    Logistic loss: R+ is the mean of log(1 + e^-g), R- that of log(1 + e^g). Where the estimate of
    the negatives' risk is below zero, only it is descended from, the other way round.
    """
    wrong_p, wrong_u = 1 / (1 + np.exp(g_p)), 1 / (1 + np.exp(-g_u))
    positive = prior * np.logaddexp(0, -g_p).mean()
    negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
    by_u, by_p = wrong_u / len(g_u), -prior * (1 - wrong_p) / len(g_p)
    if negative < 0:
        return positive, -by_p, -by_u
    return positive + negative, by_p - prior * wrong_p / len(g_p), by_u


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800) -> tuple[np.ndarray, float]:
    """Full-batch Adam from zero; nothing is random."""
    w, m, v = (np.zeros(positive.shape[1] + 1) for _ in range(3))
    p, u = (np.hstack([a, np.ones((len(a), 1))]) for a in (positive, unlabelled))
    decay = np.append(np.full(positive.shape[1], 1e-4), 0.0)
    for step in range(1, steps + 1):
        _, by_p, by_u = risk_gradient(p @ w, u @ w, prior)
        g = by_p @ p + by_u @ u + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from both histograms over one score.

    For each lower limit of the score, the unlabelled share above it over the positives' share; the
    limit is that where the ratio with its sampling error is least.
    """
    above_p, above_u = positive[::-1].cumsum()[::-1], unlabelled[::-1].cumsum()[::-1]
    share_p, share_u = above_p / positive.sum(), above_u / unlabelled.sum()
    error = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(positive.sum()) + 1 / math.sqrt(unlabelled.sum()))
    seen = share_p > 0.1
    ratio = share_u[seen] / share_p[seen]
    return float(np.clip(ratio[np.argmin(ratio + error / share_p[seen])], 0.01, 0.99))


def learned(rows: DataFrame, labels: DataFrame, doc: str = "doc_id", label: str = "quality",
            positives: int = 10_000, sample: int = 20_000) -> Model:
    """A model from `vectors` and trusted positives: ids of label 1 that are not held out.

    An id with several labels is a positive if one of them is 1; null ids and labels are none.
    `positives` and `sample` bound the rows of each kind that the driver fits on: those that hash
    lowest, the unlabelled ones out of all rows. Moments and the shares behind the prior cover all
    rows. Without rows or positives every score is one half.
    """
    trusted = labels.filter(F.col(label).cast("int") == 1).select(F.col(doc).alias("doc_id")).distinct()
    known = rows.filter(~F.col("held_out")).join(trusted, "doc_id", "left_semi")
    positive = _lowest(known, positives)
    if not len(positive):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    none = Model(*_moments(rows), np.zeros(WIDTH), 0.0, 0.5)
    p, u = none.placed(positive), none.placed(_lowest(rows, sample))
    half = (len(p) + 1) // 2

    def fitted(own: np.ndarray, prior: float) -> Model:
        weights, constant = _fit(own, u, prior)
        return none._replace(weights=weights, constant=constant, prior=prior)

    # With one half as the prior both kinds weigh the same: a first order of all rows.
    rough = fitted(p[:half], 0.5)
    in_all = np.zeros(BINS, dtype=np.int64)
    for r in rows.groupBy(F.least(F.floor(rough.score() * BINS), F.lit(BINS - 1)).alias("bin")).count().collect():
        in_all[r["bin"]] = r["count"]
    z = (p[half:] if len(p) > half else p) @ rough.weights + rough.constant
    in_rest = np.bincount(np.minimum((BINS / (1 + np.exp(-z))).astype(np.int64), BINS - 1), minlength=BINS)
    return fitted(p, prior_of(in_rest, in_all))


def quality_scores(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
                   label: str = "quality", threshold: float = 0.5, positives: int = 10_000,
                   sample: int = 20_000) -> DataFrame:
    """One row per row of `df`: doc_id, held_out, score, predicted (1 from `threshold` on).

    Whole texts alone decide a score; a null text is an empty one, which has a score like any
    other, and a very long one costs time in proportion. A null id is held out. Repeated rows get
    equal results, rows of one id count each; an empty table gives no rows; other columns play no
    part. Without trusted positives every score is one half.
    """
    rows = vectors(df, doc, text)
    model = learned(rows, labels.withColumnRenamed(doc, "doc_id") if doc != "doc_id" else labels, "doc_id", label,
                    positives, sample)
    return rows.select("doc_id", "held_out", model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
