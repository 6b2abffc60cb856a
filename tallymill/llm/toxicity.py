"""Toxicity scores of restored text: noisy-channel deobfuscation, then a linear model.

Disguised words (signs for letters, letters set apart, letters repeated) are read as lattices of
the letters that may be meant. A character language model, counted over all texts, picks the path:
Viterbi over the last two letters. A logistic model over words and word beginnings then scores
the words as written and as restored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.shared import small_batches, written

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters that a sign may stand for. A star inside a word stands for any letter; more than three
#: in a row part words, as stars at a word's ends decorate it.
MEANT = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": LETTERS,
}
#: Symbols of the language model: 0 is a word's edge, 1 to 26 are a to z, 27 is any other letter.
EDGE, OTHER, SYMBOLS = 0, 27, 28
_CODES = np.zeros(0x250, dtype=np.int64)
for _c in range(0x250):
    if chr(_c).isalpha():
        _CODES[_c] = LETTERS.find(chr(_c).lower()) + 1 or OTHER
#: Nats that a restored letter, a dropped repeat and an inserted word edge cost.
SWAP_COST, REPEAT_COST, EDGE_COST = 1.0, 0.5, 2.0
#: Word beginnings of these lengths are features, besides whole words.
SHORTEST, LONGEST = 3, 8

#: A feature needs this many rows of label 1, and this much log-odds for it.
LEAST_ROWS, LEAST_ODDS = 3, 1.5

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1+")
_SIGNS = re.escape("".join(MEANT))
#: A run of letters and signs with both, from where its letters begin or its first sign stands.
_DISGUISED = re.compile(rf"(?<![a-z{_SIGNS}])(?=[a-z]*+[{_SIGNS}])(?=[{_SIGNS}]*+[a-z])[a-z{_SIGNS}]++")
_MASK = re.compile(r"\*{4,}")
_APART = re.compile(rf"(?<![\w{_SIGNS}])(?:[a-z{_SIGNS}][ .\-_,]{{1,2}}){{3,}}[a-z{_SIGNS}](?![\w{_SIGNS}])")


def count_trigrams(texts: Column | str, df: DataFrame) -> np.ndarray:
    """Letter trigrams of all texts, edges included, as SYMBOLS x SYMBOLS x SYMBOLS counts.

    Each task sends at most as many rows as there are trigrams of the fixed symbols.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if not (whole := text.as_py()):
                    continue
                points = np.frombuffer(f"  {whole} ".encode("utf-32-le"), dtype="<u4")
                codes = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], OTHER)
                total += np.bincount(codes[:-2] * SYMBOLS**2 + codes[1:-1] * SYMBOLS + codes[2:],
                                     minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"g": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    counted = df.select(texts).mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**3)
    for row in counted.collect():
        out[row["g"]] = row["n"]
    return out.reshape((SYMBOLS,) * 3)


def letter_costs(trigrams: np.ndarray) -> np.ndarray:
    """Nats of each symbol after two others; trigrams backed by bigrams, bigrams by single symbols."""
    single = (trigrams.sum(axis=(0, 1)) + 1) / (trigrams.sum() + SYMBOLS)
    pairs = trigrams.sum(axis=0)
    second = (pairs + 5 * single) / (pairs.sum(axis=1, keepdims=True) + 5)
    return -np.log((trigrams + 5 * second) / (trigrams.sum(axis=2, keepdims=True) + 5))


class Restorer:
    """Readings of a text's words under a letter model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def _steps(self, signs: str) -> list[list[tuple[str, float]]]:
        """What each sign, or run of one letter, may stand for, with its cost."""
        steps: list[list[tuple[str, float]]] = []
        at = 0
        while at < len(signs):
            sign, end = signs[at], at + 1
            while end < len(signs) and signs[end] == sign:
                end += 1
            n = end - at
            if sign in MEANT:
                steps += [[(c, SWAP_COST) for c in MEANT[sign]]] * n
            elif n > 2:
                steps.append([(sign, REPEAT_COST), (sign * 2, REPEAT_COST)])
            else:
                steps += [[(sign, 0.0)]] * n
            at = end
        return steps

    def read(self, signs: str, edges: bool = False) -> str:
        """The best path through the lattice of `signs`; with `edges` it may be several words."""
        costs = self.costs
        best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
        for step in self._steps(signs):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                starts = [(a, b, cost, path)]
                if edges and b != EDGE:
                    starts.append((EDGE, EDGE, cost + EDGE_COST + costs[a][b][EDGE], (path, " ")))
                for p, q, so_far, way in starts:
                    for letters, price in step:
                        x, y, total = p, q, so_far + price
                        for c in letters:
                            code = LETTERS.find(c) + 1 or OTHER
                            total += costs[x][y][code]
                            x, y = y, code
                        known = new.get((x, y))
                        if known is None or total < known[0]:
                            new[x, y] = (total, (way, letters))
            best = new
        _, path = min((cost + costs[a][b][EDGE], path) for (a, b), (cost, path) in best.items())
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts))

    def words(self, text: str) -> set[str]:
        """The lower-case words of a text, as written and as restored."""
        low = text.lower()
        found = set(_WORD.findall(low))
        extra: set[str] = set()
        if _RUN.search(low):
            extra.update(self.read(word) for word in found if _RUN.search(word))
        if any(sign in low for sign in MEANT):
            for signs in set(_DISGUISED.findall(low)):
                for part in _MASK.split(signs):
                    extra.add(self.read(part.strip("*")))
                    extra.add(self.read(part.strip("".join(MEANT))))
        for signs in set(_APART.findall(low)):
            extra.update(self.read(re.sub(r"[ .\-_,]", "", signs), edges=True).split(" "))
        return found | extra


def features(words: set[str]) -> set[str]:
    """Whole words, and their beginnings."""
    out = {"=" + word for word in words}
    for word in words:
        out.update(word[:n] for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))
    return out


class Model(NamedTuple):
    """Letter costs, a weight per feature, and the constant."""

    costs: np.ndarray
    weights: dict[str, float]
    constant: float


def _fit(rows: list[list[int]], labels: np.ndarray, n: int, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam; deterministic. Weights are not negative: features
    can only speak for label 1, so harmless words never outvote a toxic one."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=np.int64)
    w, m, v = (np.zeros(n + 1) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.bincount(row, w[col], minlength=len(rows)) - w[n]))
        e = (p - labels) / max(len(rows), 1)
        g = np.append(np.bincount(col, e[row], minlength=n) + 2e-5 * w[:n], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(w[:n], 0, out=w[:n])
    return w[:n], float(w[n])


def train(df: DataFrame, labelled: DataFrame, text: str = "text", most_features: int = 8_192) -> Model:
    """A model of `labelled` (columns text, label), its letters counted over all texts of `df`.

    The caller bounds the labelled rows; of their features the strongest `most_features` by n1
    log-odds are used. Both bound what the driver holds. Letter counts cover every text. Without
    rows of both labels every score is the rate of label 1.
    """
    spark = df.sparkSession
    small_batches(spark)
    costs = letter_costs(count_trigrams(F.col(text).cast("string"), df))
    sent_costs = spark.sparkContext.broadcast(costs)
    rows = labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                           F.col("label").cast("int").alias("label")).filter("label is not null")

    def featured(place=None):
        """Features of a batch's texts; with `place` the places of those that it has. One worker per
        task does it all, which bounds an executor's memory."""

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(sent_costs.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    own = [features(restorer.words(t)) for t in part.column(0).to_pylist()]
                    if place is None:
                        values = pa.array([sorted(f) for f in own], pa.list_(pa.string()))
                    else:
                        values = pa.array([sorted(place.value[x] for x in f if x in place.value) for f in own],
                                          pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict({"label": part.column(1), "f": values})

        return found

    held = written(rows, "labelled")
    ones, all_ = (float(x or 0) for x in held.agg(F.sum("label"), F.count("*")).first())
    if not 0 < ones < all_:
        rate = (ones + 0.5) / (all_ + 2)
        return Model(costs, {}, math.log(rate / (1 - rate)))
    n1, n0 = F.sum("label"), F.sum(1 - F.col("label"))
    odds = F.log((n1 + 0.5) / (ones + 1)) - F.log((n0 + 0.5) / (all_ - ones + 1))
    named = held.mapInArrow(featured(), "label int, f array<string>")
    chosen = (named.select("label", F.explode("f").alias("f")).groupBy("f")
              .agg((n1 * odds).alias("strength"), n1.alias("n1"), odds.alias("odds"))
              .filter((F.col("n1") >= LEAST_ROWS) & (F.col("odds") > LEAST_ODDS))
              .orderBy(F.desc("strength"), "f").limit(most_features))
    names = [r["f"] for r in chosen.select("f").collect()]
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    kept = held.mapInArrow(featured(place), "label int, f array<int>").collect()
    weights, constant = _fit([r["f"] for r in kept], np.array([r["label"] for r in kept], dtype=float), len(names))
    return Model(costs, dict(zip(names, weights.tolist())), constant)


def scorer(df: DataFrame, model: Model):
    """A column function from text to its score, 0 to 1. Null and empty texts score the constant."""
    sent_model = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, constant = sent_model.value.weights, sent_model.value.constant
        restorer = Restorer(sent_model.value.costs)
        known: dict[str, frozenset[str]] = {}

        def of(text: str | None) -> float:
            found: set[str] = set()
            for word in restorer.words(text) if text else ():
                own = known.get(word)
                if own is None:
                    own = known[word] = frozenset(f for f in features({word}) if f in weights)
                if own:
                    found |= own
            z = constant + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        for texts in batches:
            if len(known) > 100_000:  # memory stays bounded; a word is simply worked out again
                known.clear()
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return score


def held_out(doc: Column, folds: int = 5) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text has remainder 0."""
    return F.coalesce(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % folds == 0, F.lit(False))


def learned(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
            label: str = "toxic", sample: int = 10_000) -> Model:
    """A model from documents that are not held out: the `sample` of them whose ids hash lowest.

    `sample` bounds what the driver holds. Of a document's several labels the highest counts, of an
    id's several rows the one whose text hashes lowest, a null text last; null ids and labels are none.
    """
    own = df.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        ~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    # The sample's size is the bound of this broadcast, so the texts stay where they are.
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = own.join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("h"), "text"))["text"]
    return train(own, rows.groupBy("doc_id", "label").agg(least.alias("text")).select("doc_id", "text", "label"))


def toxicity(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
             label: str = "toxic", threshold: float = 0.5, sample: int = 10_000) -> DataFrame:
    """One row per row of `df`: doc_id, held_out, score, predicted (1 from `threshold` on).

    Texts alone decide a score. A null or empty text scores the model's constant; a null id counts
    as an empty one; repeated rows get equal results; an empty table gives no rows; other columns
    play no part.
    """
    score = scorer(df, learned(df, labels, doc, text, label, sample))
    return df.select(F.col(doc).alias("doc_id"), held_out(F.col(doc)).alias("held_out"),
                     score(F.col(text).cast("string")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
                  label: str = "toxic", threshold: float = 0.5, sample: int = 10_000) -> DataFrame:
    """The rows of `df` that score below `threshold`, all columns as they are; see `toxicity`."""
    score = scorer(df, learned(df, labels, doc, text, label, sample))
    return df.filter(score(F.col(text).cast("string")) < threshold)
