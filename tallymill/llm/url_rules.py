"""URL filters: rules on hosts and paths, found by hashed expressions.

Each distinct URL is expanded into its host suffixes times its path prefixes of the lengths that
rules have. Expressions and rules meet on short hash prefixes; the full digest then confirms, and
the longest rule decides. Column functions and joins alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.shared import let

#: Hex digits of the digest that the join uses.
SHORT = 8


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host itself and what follows each of its dots."""
    return let(F.split(host, r"\.", -1), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def expressions(host: Column, path: Column, length: Column) -> Column:
    """Digests of the host's suffixes, each with the path's prefix of one length."""
    prefix = F.substring(path, F.lit(1), length)
    return F.transform(suffixes(host), lambda h: digest(h, prefix))


def digest(host: Column, path: Column) -> Column:
    """Digest of an expression; the host's length in front keeps host and path apart."""
    return F.sha2(F.concat_ws(" ", F.char_length(host).cast("string"), F.concat(host, path)), 256)


def judge_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of `df`: page_id, host, path, rule (or null), verdict.

    `rules` has host, path and verdict. A rule fits its host and the subdomains of it, if the URL's
    path starts with the rule's; of the rules that fit the longest (host and path together) decides,
    then the one with the longer host, then block before allow. No rule: `default`. A null URL, or
    one without ://, has an empty host and path. Repeated rules count once, rules with a null part
    never fit; repeated rows get equal results; empty tables give no rows or defaults; other columns
    play no part.
    """
    named = rules.select(
        F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("ruling")
    ).dropna().withColumn("full", digest(F.col("rule_host"), F.col("rule_path")))
    rank = F.struct(F.char_length(F.concat("rule_host", "rule_path")).alias("n"),
                    F.char_length("rule_host").alias("h"), (F.col("ruling") == "block").alias("b"),
                    F.concat("rule_host", "rule_path").alias("rule"), F.col("ruling").alias("ruling"))
    one_each = named.groupBy("full").agg(F.max(rank).alias("rank")).withColumn(
        "short", F.substring("full", 1, SHORT))
    lengths = named.agg(F.sort_array(F.collect_set(F.char_length("rule_path"))).alias("n"))

    pages = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = pages.select("host", "path").distinct()
    sized = places.select("host", "path", lengths.scalar().alias("lengths")).select(
        "host", "path", F.explode("lengths").alias("n")).filter(F.col("n") <= F.char_length("path"))
    expanded = sized.select("host", "path", F.explode(expressions(
        F.col("host"), F.col("path"), F.col("n"))).alias("digest")).withColumn(
        "short", F.substring("digest", 1, SHORT))
    found = expanded.join(one_each, "short").filter(F.col("digest") == F.col("full"))
    best = found.groupBy("host", "path").agg(F.max("rank").alias("rank"))
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("rank")["rule"].alias("rule"),
        F.coalesce(F.col("rank")["ruling"], F.lit(default)).alias("verdict"))
