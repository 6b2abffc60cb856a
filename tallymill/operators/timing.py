"""Timing tables: totals, percentile, buckets and neighbour sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.operators.numbering import running_total


def totals(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def scope(size: Column) -> Column:
    """Index of the half-open size range; the number of ranges beyond them."""
    out = F.when(F.lit(False), F.lit(0))
    for index, (low, high) in enumerate(fixed.TIMING_SCOPES):
        out = out.when((size >= low) & (size < high), F.lit(index))
    return out.otherwise(F.lit(len(fixed.TIMING_SCOPES)))


def bucket_means(df: DataFrame, size: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(scope(F.col(size)).alias("scope")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in columns]
    )


def percentile(df: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """Exact percentile with linear interpolation.

    Equal values are counted first; ranks come from counts per value range, so
    neither the rows nor all the values pass through one task.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("uses")
    )
    ranked = running_total(counted, "v", "uses", into="ahead")
    place = (ranked.agg(F.sum("uses")).scalar() - 1) * F.lit(share)

    def at(rank: Column) -> Column:
        inside = (F.col("ahead") <= rank) & (F.col("ahead") + F.col("uses") > rank)
        return F.max(F.when(inside, F.col("v")))

    ends = ranked.withColumn("place", place).agg(
        at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"),
        F.max(F.col("place") - F.floor("place")).alias("part"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return ends.select(value.alias(f"p{round(share * 100)}"))


#: Keys that one range of a neighbour sum spans at least.
RANGE_KEYS = 65_536


def neighbour_sum(df: DataFrame, key: str, value: Column, back: int = 10,
                  ahead: int = 10) -> DataFrame:
    """For every whole-number key, the sum of values whose key lies in ``[key-back, key+ahead)``.

    Values are summed by key first. Keys are cut into ranges, which also receive the
    keys next to their borders; a sum is the difference of two running sums inside
    its range, so the work doesn't grow with ``back`` and ``ahead``. A range spans
    them at least, so a key has at most two copies beside its own. Rows without a key
    and keys without a value take no part; a sum of no values is null. Differences
    of running sums are exact for whole numbers and decimals; floating values round.
    """
    if back < 0 or ahead < 0:
        raise ValueError("back and ahead are not negative")
    width = F.lit(max(RANGE_KEYS, back + ahead)).cast("long")
    k = F.col("k")

    def first_of(place: Column) -> Column:
        """First key of the range that holds ``place``; exact, unlike a quotient."""
        return place - F.pmod(place, width)

    per_key = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(
        F.sum(value).alias("part")
    ).where("part IS NOT NULL")
    seen_from, seen_to = F.least(k, k - (ahead - 1)), F.greatest(k, k + back)
    copies = per_key.select("k", "part", F.explode(
        F.sequence(first_of(seen_from), first_of(seen_to), width)).alias("range"))
    line = Window.partitionBy("range").orderBy("k")
    upto = line.rangeBetween(Window.unboundedPreceding, ahead - 1)
    below = line.rangeBetween(Window.unboundedPreceding, -back - 1)

    def between(total) -> Column:
        return F.coalesce(total.over(upto), F.lit(0)) - F.coalesce(total.over(below), F.lit(0))

    held = copies.select(
        "k", "part", "range", between(F.sum("part")).alias("near"), between(F.count("part")).alias("values"),
    ).where(F.col("range") == first_of(k))
    return held.select(
        k.alias("target"), F.col("part").alias("own"), F.when(F.col("values") > 0, F.col("near")).alias("near")
    )
