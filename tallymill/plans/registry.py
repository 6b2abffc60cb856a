"""Query registry and small helpers shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NL = "\n"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that checks it."""

    def register(run: Query) -> Query:
        key = name or run.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan has fewer partitions than the cluster has slots.

    A small file is one row group and so one task, however heavy its texts are.
    Tables that already fill the cluster are left where they are.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > slots else df.repartition(slots)


def digest(text: Column) -> Column:
    """Short stand-in for a whole text in a result."""
    return F.md5(text.cast("binary"))


# Source-like texts derived from the tables. The expressions are plain enough
# to read the same in Spark SQL and in the checking SQL.
SOURCE = (
    f"concat(CASE doc_id % 7 WHEN 0 THEN '#!/usr/bin/env python{NL}' "
    f"WHEN 1 THEN '<meta>{NL}' WHEN 2 THEN '<meta>{NL}#!/bin/sh{NL}' ELSE '' END, text)"
)
#: Statements: common words become keywords that start a line.
STATEMENTS = (
    f"replace(replace(replace(text, ' the ', '{NL}def '), ' die ', '{NL}class '), "
    f"' le ', '{NL}print ')"
)
#: Braces: commas open blocks, periods close them, lines are indented.
BRACED = f"replace(replace(text, ', ', ' {{{NL}    '), '. ', ' }}{NL}')"
#: Indented code: every later line of the text starts with blanks.
INDENTED = f"replace(replace(text, '. ', '.{NL}    '), ' and ', '{NL}  return ')"
