"""Corpus filters, splits, samples and token accounting."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.functions import text as t
from tallymill.functions import tokens as tok


def strip_meta_line(text: Column) -> Column:
    """Delete the first line when it starts with an opening bracket."""
    return F.when(
        F.startswith(text, F.lit("<")), F.regexp_replace(text, r"\A[^\n]*\n", "")
    ).otherwise(text)


def reject_reason(text: Column) -> Column:
    """Why the text checks drop a row, or ``kept``."""
    return (
        F.when(~t.contains(text, "\n"), F.lit("no_newline"))
        .when(F.startswith(strip_meta_line(text), F.lit("#!/")), F.lit("shebang"))
        .otherwise(F.lit("kept"))
    )


def clean(df: DataFrame, text: str = "content", popularity: str | None = None,
          above: int = 100) -> DataFrame:
    """Popularity, line and shebang filters, then the meta-line cut."""
    if popularity is not None:
        df = df.where(F.col(popularity) > above)
    kept = df.where(reject_reason(F.col(text)) == "kept")
    return kept.withColumn(text, strip_meta_line(F.col(text)))


def _parses(source: str | None) -> bool:
    if source is None:
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def is_parseable(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text is current Python; runs on Arrow batches."""
    for batch in batches:
        yield batch.map(_parses).astype("bool")


def parseable(df: DataFrame, text: str = "content") -> DataFrame:
    """Keep rows that parse. Put cheap filters in front: they do not move below it."""
    return df.where(is_parseable(F.col(text)))


def reject_counts(df: DataFrame, text: str = "content", *by: str) -> DataFrame:
    return df.groupBy(*by, reject_reason(F.col(text)).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def sample(df: DataFrame, key: str, ratio: float, only: Column | None = None) -> DataFrame:
    """Keep a repeatable share of the keys; rows outside ``only`` all stay."""
    drawn = t.hash_share(F.col(key)) < ratio
    return df.where(drawn if only is None else ~only | drawn)


def split_two(key: Column, test_share: float = 0.05) -> Column:
    return F.when(t.hash_share(key) < test_share, F.lit("valid")).otherwise(F.lit("train"))


def split_three(key: Column, train_share: float = 0.8) -> Column:
    """Train share, and the rest halved into ``test`` then ``valid``."""
    drawn = t.hash_share(key)
    return (
        F.when(drawn < train_share, F.lit("train"))
        .when(drawn < (1 + train_share) / 2, F.lit("test"))
        .otherwise(F.lit("valid"))
    )


def token_report(
    df: DataFrame,
    text: str = "content",
    tokenizers: dict[str, Callable[[Column], Column]] | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Tokens of all rows, of kept rows and of rewritten rows, per tokenizer.

    Kept rows are measured on their raw text. One scan feeds every tokenizer,
    and the sums are combined before the only shuffle.
    """
    tokenizers = tokenizers or tok.TOKENIZERS
    raw = F.col(text)
    kept = reject_reason(raw) == "kept"
    rewritten = F.when(kept, tok.rewrite_vocabulary(strip_meta_line(raw)))
    staged = df.select(*by, raw.alias("raw"), kept.alias("kept"),
                       rewritten.alias("rewritten"))
    counted = staged.select(
        *by, "kept",
        *[F.size(build(F.col("raw"))).cast("long").alias(f"raw_{name}")
          for name, build in tokenizers.items()],
        *[F.when(F.col("kept"), F.size(build(F.col("rewritten")))).cast("long")
          .alias(f"new_{name}") for name, build in tokenizers.items()],
    )
    wide = counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("kept").alias("kept_rows"),
        *[F.sum(f"raw_{name}").alias(f"all_{name}") for name in tokenizers],
        *[F.sum(F.when(F.col("kept"), F.col(f"raw_{name}"))).alias(f"kept_{name}")
          for name in tokenizers],
        *[F.sum(f"new_{name}").alias(f"new_{name}") for name in tokenizers],
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("tokenizer"),
            F.col(f"all_{name}").alias("code_tokens"),
            F.coalesce(F.col(f"kept_{name}"), F.lit(0)).alias("filtered_code_tokens"),
            F.coalesce(F.col(f"new_{name}"), F.lit(0)).alias("parsed_tokens"),
        ) for name in tokenizers
    ]))
    long = wide.select(*by, "rows", "kept_rows", rows.alias("r"))
    return long.select(
        *by, "rows", "kept_rows", "r.*",
        F.try_divide("r.parsed_tokens", "r.filtered_code_tokens").alias("ratio"),
    )


def vocabulary_use(df: DataFrame, text: str = "content") -> DataFrame:
    """How often every grammar token occurs; tokens never seen count zero."""
    spark = df.sparkSession
    names = [(name,) for name in tok.fixed.grammar_tokens()]
    vocabulary = spark.createDataFrame(names, "token string")
    seen = df.select(F.explode(tok.grammar_hits(F.col(text))).alias("token"))
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return vocabulary.join(F.broadcast(counts), "token", "left").select(
        "token", F.coalesce("uses", F.lit(0)).alias("uses")
    )
