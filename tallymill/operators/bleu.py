"""Sentence and corpus BLEU over long n-gram tables.

A pair of one candidate and one reference is matched inside its row. With several
references, n-grams are rows ``(id, order, ngram)``; equal n-grams of a text are
combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import text as t
from tallymill.functions import tokens as tok

ORDERS = 4
TINY = 2.2250738585072014e-308  # smallest normal double, inside the logarithms

# The published normalisation steps, in order.
NORMALISE_RAW = [("<skipped>", ""), ("-\\n", ""), ("\\n", " ")]
NORMALISE_MARKS = [
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ENTITIES = [("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def prepare(text: Column) -> Column:
    """Text in front of a tab, lowered, as blank-separated words and marks."""
    head = t.before(text, "\t")
    return F.array_join(tok.words(F.lower(t.strip(head))), " ")


def normalise(text: Column) -> Column:
    """Words after the published normalisation."""
    text = reduce(lambda s, step: F.regexp_replace(s, *step), NORMALISE_RAW, text)
    text = reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    text = F.lower(F.concat(F.lit(" "), text, F.lit(" ")))
    text = reduce(lambda s, step: F.regexp_replace(s, *step), NORMALISE_MARKS, text)
    return F.filter(F.split(text, f"[{t.BLANK_CLASS}]+"), lambda w: w != "")


def ngrams(words: Column, order: int) -> Column:
    """All runs of ``order`` words, joined by blanks; none for short texts."""
    count = F.size(words) - order + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, order), " "))


def all_ngrams(words: Column, orders: int = ORDERS) -> Column:
    """N-grams of every order as one array of ``(order, ngram)``."""

    def of_order(bound: Column, k: int) -> Column:
        return F.transform(
            ngrams(bound, k), lambda g: F.struct(F.lit(k).alias("order"), g.alias("ngram"))
        )

    return t.let(words, lambda bound: F.flatten(
        F.array(*[of_order(bound, k) for k in range(1, orders + 1)])
    ))


def ngram_rows(df: DataFrame, keys: Sequence[str], words: Column) -> DataFrame:
    return df.select(*keys, F.explode(all_ngrams(words)).alias("g")).select(*keys, "g.*")


def ngram_counts(df: DataFrame, keys: Sequence[str], words: Column) -> DataFrame:
    return ngram_rows(df, keys, words).groupBy(*keys, "order", "ngram").agg(
        F.count(F.lit(1)).alias("uses")
    )


def clipped_matches(candidate: Column, reference: Column, order: int) -> Column:
    """How many n-grams of one order both texts hold, each as often as the text with fewer of it.

    The n-grams of both are sorted together, the candidate's in front among equal ones, and
    passed once: the reference's use up what is left of the candidate's.
    """

    def side(words: Column, number: int) -> Column:
        return F.transform(
            ngrams(words, order), lambda g: F.struct(g.alias("g"), F.lit(number).alias("side"))
        )

    def step(seen: Column, x: Column) -> Column:
        same, own = x["g"] == seen["g"], x["side"] == 0
        met = same & ~own & (seen["left"] > 0)
        left = F.when(own, F.when(same, seen["left"]).otherwise(0) + 1)
        return F.struct(
            x["g"].alias("g"), left.when(met, seen["left"] - 1).otherwise(0).alias("left"),
            (seen["m"] + F.when(met, 1).otherwise(0)).alias("m"),
        )

    none = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("m"))
    both = F.sort_array(F.concat(side(candidate, 0), side(reference, 1)))
    return F.coalesce(F.aggregate(both, none, step, lambda seen: seen["m"]), F.lit(0)).cast("long")


def clipped_counts(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lengths and clipped matches of every pair, one row per key.

    ``pairs`` holds word arrays ``candidate`` and ``reference``, one row per
    key. N-grams are matched inside the row, so nothing moves and a task holds
    the n-grams of one pair at a time.
    """
    words = F.struct("candidate", "reference")
    matches = t.let(words, lambda w: F.struct(*[
        clipped_matches(w["candidate"], w["reference"], k).alias(f"m{k}") for k in range(1, ORDERS + 1)
    ]))
    return pairs.select(
        *keys, F.size("candidate").alias("length"), F.size("reference").alias("reference_length"),
        matches.alias("m"),
    ).select(*keys, "length", "reference_length", "m.*")


def sentence_score(matches: Sequence[Column], length: Column, reference: Column) -> Column:
    """Smoothed sentence BLEU from matches per order and two lengths."""
    total = F.lit(0.0)
    for k, match in enumerate(matches, 1):
        extra = 0 if k == 1 else 1
        guess = F.greatest(length - (k - 1), F.lit(0))
        total = total + F.log(match + extra + TINY) - F.log(guess + extra + TINY)
    brevity = F.least(F.lit(0.0), 1 - (reference + 1).cast("double") / (length + 1))
    return F.exp(total / ORDERS + brevity)


def _scored(counts: DataFrame, *keep: str) -> DataFrame:
    ms = [F.coalesce(F.col(f"m{k}"), F.lit(0)) for k in range(1, ORDERS + 1)]
    score = sentence_score(ms, F.col("length"), F.col("reference_length"))
    return counts.select(*keep, score.alias("bleu"))


def sentence_bleu(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """BLEU per key for word arrays ``candidate`` and ``reference``."""
    return _scored(clipped_counts(pairs, keys), *keys)


def mean_bleu(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("pairs"), (F.avg("bleu") * 100).alias("bleu")
    )


def multi_reference_bleu(
    candidates: DataFrame, references: DataFrame, key: str, ref_no: str,
    length_rule: str = "shortest",
) -> DataFrame:
    """BLEU per id against several references, for ids on both sides.

    ``candidates`` has ``words`` per id, ``references`` has ``words`` per id
    and number (from 0). N-gram counts are clipped by the largest count in any
    reference; the reference length is the shortest, the average or the
    closest. The n-gram is part of the shuffle key, so an id with very many
    references is spread over the tasks. A text's length travels as one more
    row of order 0, so lengths need no joins of their own.
    """

    def rows(df: DataFrame, number: Column) -> DataFrame:
        size = F.struct(
            F.lit(0).alias("order"), F.size("words").cast("string").alias("ngram")
        )
        return df.select(
            key, number.cast("long").alias("no"),
            F.explode(F.concat(F.array(size), all_ngrams(F.col("words")))).alias("g"),
        ).select(key, "no", "g.*")

    both = rows(candidates, F.lit(-1)).unionByName(rows(references, F.col(ref_no)))
    uses = both.groupBy(key, "no", "order", "ngram").agg(F.count(F.lit(1)).alias("uses"))
    own, of_ref = F.col("no") < 0, F.col("no") >= 0
    per_ngram = uses.groupBy(key, "order", "ngram").agg(
        F.max(F.when(own, F.col("uses"))).alias("own"),
        F.max(F.when(of_ref, F.col("uses"))).alias("most"),
        F.count_if(of_ref).alias("refs"), F.min(F.when(of_ref, F.col("no"))).alias("seen"),
    )
    shared = F.col("own").isNotNull() & F.col("most").isNotNull()
    size_row, words = F.col("order") == 0, F.col("ngram").try_cast("int")
    # Distinct reference lengths of an id: no more than words in its longest one.
    lengths = F.collect_list(F.when(
        size_row & F.col("most").isNotNull(), F.struct(words.alias("n"), "seen", "refs")
    ))
    per_id = per_ngram.groupBy(key).agg(
        F.max(F.when(size_row & F.col("own").isNotNull(), words)).alias("length"),
        lengths.alias("lengths"),
        *[
            F.sum(F.when(shared & (F.col("order") == k), F.least("own", "most"))).alias(f"m{k}")
            for k in range(1, ORDERS + 1)
        ],
    ).where(F.col("length").isNotNull() & (F.size("lengths") > 0))
    total = F.aggregate("lengths", F.lit(0.0), lambda acc, x: acc + x["n"] * x["refs"])
    count = F.aggregate("lengths", F.lit(0).cast("long"), lambda acc, x: acc + x["refs"])
    nearest = F.array_min(F.transform("lengths", lambda x: F.struct(
        F.abs(x["n"] - F.col("length")).alias("gap"), x["seen"].alias("seen"), x["n"].alias("n")
    )))
    effective = {
        "shortest": F.array_min(F.col("lengths.n")).cast("double"),
        "average": total / count,
        "closest": nearest["n"].cast("double"),
    }[length_rule]
    return _scored(
        per_id.withColumn("reference_length", effective), key, "length", "reference_length"
    )


def corpus_bleu(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smoothed corpus BLEU: counts summed over all pairs before the ratio."""
    counts = clipped_counts(pairs, keys)
    orders = range(1, ORDERS + 1)
    total = counts.agg(
        F.sum("length").alias("length"),
        F.sum("reference_length").alias("reference_length"),
        *[F.sum(f"m{k}").alias(f"m{k}") for k in orders],
        *[F.sum(F.greatest(F.col("length") - (k - 1), F.lit(0))).alias(f"g{k}")
          for k in orders],
    )
    logs = reduce(
        lambda acc, k: acc + F.log((F.col(f"m{k}") + 1) / (F.col(f"g{k}") + 1)),
        orders, F.lit(0.0),
    )
    ratio = F.try_divide("length", "reference_length")
    brevity = F.when(ratio > 1, F.lit(1.0)).otherwise(
        F.exp(1 - F.try_divide("reference_length", "length"))
    )
    return total.select(
        "length", "reference_length",
        (F.exp(logs / ORDERS) * F.coalesce(brevity, F.lit(0.0))).alias("bleu"),
    )
