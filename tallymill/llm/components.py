"""Connected components of links, by alternating stars, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.shared import cut


#: Parts into which the rows of one group are dealt at most.
SALTS = 64


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def with_least(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows with their group's least `value` as `least` and its number of rows as `members`.

    Rows are dealt by group and a hash of the value; only one row for each such part meets its
    group, so a group with a third of all rows is spread.
    """
    rows = _salted(df, value)
    parts = rows.groupBy(*by, "salt").agg(F.min(value).alias("least"), F.count("*").alias("members"))
    whole = Window.partitionBy(*by)
    told = parts.withColumn("least", F.min("least").over(whole)).withColumn("members", F.sum("members").over(whole))
    return rows.join(told, [*by, "salt"]).drop("salt")


def spread_join(rows: DataFrame, one: DataFrame, on: Sequence[str], by: str) -> DataFrame:
    """Inner join with a frame of one row per `on`, copied once for each part that its rows are dealt to."""
    dealt = _salted(rows, by)
    copies = dealt.select(*on, "salt").distinct().join(one, list(on))
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, ["u"], "v").filter("v > u").select(
        F.col("v").alias("u"), F.least("u", "least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return with_least(down, ["u"], "v").select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being the least node that it reaches.

    `links` has the columns u and v; direction, repeats and loops don't matter, rows with a null are
    no links, an empty table gives none. Each round is joins and combining minima; a node with
    very many links is dealt to parts. Rounds grow with the logarithm of a component's size. The
    links of each round are checkpointed.
    """
    edges = cut(links.select("u", "v").filter("u <> v").distinct())
    mark = None
    while True:
        stars = _small_star(_large_star(edges)).filter("u <> v").distinct()
        edges = cut(stars)
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if seen == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
