"""Row numbers over a whole table or inside hot groups, without a global sort.

Rows are cut into ranges of the order key by one range-partitioned sort, whose
partitions are written once; rows are numbered inside their range and shifted by
the row counts of the ranges in front. No task ever holds more than one range of
one group, so neither a global order nor a group with a third of all rows ends up
in a single task. Limits of ranges are Spark's own samples; any limits give the
same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.staging import staged

RANGE = "__range"


def _in_ranges(df: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows, written in ranges of ``keys``, with the number of their range."""
    cut = df.repartitionByRange(*([] if ranges is None else [ranges]), *keys)
    return staged(cut.withColumn(RANGE, F.spark_partition_id()), "ranges")


def hot_keys(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame | None:
    """The key groups with at least ``at_least`` rows, or none.

    One combining pass over the key columns; the groups stay a table, which has
    at most one row for each ``at_least`` rows of ``df``.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    large = staged(sizes.where(F.col("__rows") >= at_least).select(*keys), "hot")
    return None if large.isEmpty() else large


def _ahead(totals: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Sum of the ranges in front of each range; a few rows for each group."""
    front = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return totals.withColumn(
        "__ahead", F.coalesce(F.sum(value).over(front), F.lit(0))
    ).drop(value)


def number_rows(
    df: DataFrame,
    key: str,
    *,
    into: str,
    groups: Sequence[str] = (),
    ranges: int | None = None,
    hot: int = 1_000_000,
) -> DataFrame:
    """Number rows from 1 by a unique numeric key, optionally per group.

    Groups under ``hot`` rows fit one task and are numbered as they are; only
    hot groups, or a table without groups, are cut into ranges. The numbers are
    the same whatever ``hot`` and ``ranges`` are.
    """
    groups = list(groups)
    if not groups:
        return number_sorted(df, [key], into=into, first=1, ranges=ranges)
    large = hot_keys(df, groups, hot)
    alone = F.row_number().over(Window.partitionBy(*groups).orderBy(key)).cast("long")
    if large is None:
        return df.withColumn(into, alone)
    here, there = df.alias("n"), large.alias("h")
    same = F.lit(True)
    for group in groups:
        same = same & F.col(f"n.{group}").eqNullSafe(F.col(f"h.{group}"))
    usual = here.join(there, same, "left_anti").withColumn(into, alone)
    spread = _in_ranges(here.join(there, same, "left_semi"), [*groups, key], ranges)
    counts = spread.groupBy(*groups, RANGE).agg(F.count(F.lit(1)).alias("__rows"))
    # Ranges follow the groups, so only one group of a range goes on from the one in front.
    offsets = _ahead(counts, groups, "__rows").where("__ahead > 0")
    inside = F.row_number().over(Window.partitionBy(*groups, RANGE).orderBy(key))
    here, there = spread.withColumn("__inside", inside).alias("n"), offsets.alias("h")
    shifted = here.join(there, same & (F.col(f"n.{RANGE}") == F.col(f"h.{RANGE}")), "left")
    place = F.col("__inside") + F.coalesce(F.col("h.__ahead"), F.lit(0))
    return usual.unionByName(
        shifted.select(*[F.col(f"n.{c}") for c in df.columns], place.cast("long").alias(into))
    )


def running_total(
    df: DataFrame, key: str, value: str, *, into: str, ranges: int | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows in front, by a unique numeric key."""
    cut = _in_ranges(df, [key], ranges)
    totals = cut.groupBy(RANGE).agg(F.sum(value).alias("__total"))
    offsets = _ahead(totals, [], "__total")
    front = (
        Window.partitionBy(RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = cut.withColumn("__inside", F.coalesce(F.sum(value).over(front), F.lit(0)))
    return summed.join(offsets, RANGE).withColumn(
        into, F.col("__inside") + F.col("__ahead")
    ).drop(RANGE, "__inside", "__ahead")


def number_sorted(df: DataFrame, keys: Sequence[str], *, into: str, first: int = 0,
                  ranges: int | None = None) -> DataFrame:
    """Number rows in the order of ``keys``, of any type, from ``first`` on.

    One range-partitioned sort: rows are numbered inside their partition as it is
    written, and partitions are shifted by the counts of those in front. Rows
    with equal keys lie in one partition, so keys should be (nearly) unique.
    """
    cut = df.repartitionByRange(*([] if ranges is None else [ranges]), *keys)
    ordered = cut.sortWithinPartitions(*keys)
    # The partition's number in the high bits, the place in it in the low 33.
    held = staged(ordered.withColumn("__place", F.monotonically_increasing_id()), "sorted")
    held = held.withColumn(RANGE, F.shiftright("__place", 33))
    counts = held.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__rows"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(_ahead(counts, [], "__rows"), RANGE).select(
        *df.columns, (inside + F.col("__ahead") + first).cast("long").alias(into)
    )
