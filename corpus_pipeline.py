"""From raw documents to packed token sequences, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the
next stage's docs; all but the last return the columns of documents. Rows are told apart by their
file and their place in it (`shared.placed`), so null and repeated ids are documents like any other, and an empty table passes
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import line_dedup as lines
from tallymill.llm import packing, quality, simhash, toxicity
from tallymill.llm.queries import BYTE_LIBRARY, BYTE_RANKS
from tallymill.llm.shared import fresh, placed, table, written

#: SQL cannot express the toxicity model or tokenising; the tests compare the pipeline with a
#: brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. A null text is not toxic by itself."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null texts among them."""
    (row,) = fresh(docs, "row")
    rows = placed(docs, row)
    kept = quality.quality_rules(rows, doc=row).filter("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go from the texts; n_chars follows. No document goes."""
    whole = lines.without_later_matches(docs)
    if "n_chars" not in docs.columns:
        return whole
    return whole.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id, then the first row."""
    row, group = fresh(docs, "row", "group")
    rows = placed(docs, row)
    groups = simhash.near_duplicates(rows, doc=row).select(
        F.col("doc_id").alias(row), F.col("component_id").alias(group))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(row).alias("c"))
    kept = rows.select(row, "doc_id").join(groups, row).groupBy(group).agg(F.min(order)["c"].alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, BYTE_LIBRARY, BYTE_RANKS)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("line_dedup", line_dedup),
          ("near_dedup", near_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
