"""Token counts with a whole-token shortcut.

Most words of a text are one token of the vocabulary. Which vocabulary strings encode alone as one
token is proved beforehand, by encoding each of them; words among these count one, and only the
rest are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.shared import small_batches
from tallymill.llm.vocab import WordEncoder, is_plain, once, sent


def whole_tokens(encoder: WordEncoder) -> frozenset[str]:
    """Vocabulary strings that are one word and encode alone as exactly one token.

    Bounded by the vocabulary. A string is proved by encoding it, never assumed.
    """
    ending = "</w>"
    strings = [s.removesuffix(ending) for s in encoder.library.get_vocab() if s.endswith(ending)]
    words = [s for s in strings if s and is_plain(s) and encoder.split(s) == [s]]
    found = encoder.library.encode_batch_fast(words, add_special_tokens=False)
    return frozenset(word for word, x in zip(words, found) if len(x.ids) == 1)


class Counter:
    """Counts of one vocabulary, with its proved whole tokens."""

    def __init__(self, library_json: str, whole: frozenset[str]):
        self.encoder, self.whole = WordEncoder(library_json), whole

    def count(self, text: str) -> int:
        words = self.encoder.split(text)
        if words is None:
            return len(self.encoder.ids(text))
        rest = [word for word in words if word not in self.whole]
        return len(words) - len(rest) + len(self.encoder.merged(rest))


def token_counter(spark: SparkSession, path: str):
    """A column function from text to its number of tokens under the vocabulary file at `path`.

    Equal to the library's count without begin, end or added special tokens, on whole texts.
    Special strings inside a text count as the library counts them. Null counts as empty: 0.
    """
    small_batches(spark)
    library = sent(spark, path)
    whole: Broadcast = spark.sparkContext.broadcast(whole_tokens(WordEncoder(library.value)))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = once(("count", path), lambda: Counter(library.value, whole.value))
        for texts in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return count


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`).

    One row per input row, repeated rows included; null and empty texts have 0 and 0; an empty
    table gives none. Other columns of the input, whatever their names, play no part. No shuffle.
    """
    count = token_counter(df.sparkSession, path)
    whole: Column = F.coalesce(F.col(text), F.lit(""))
    counted = df.select(*keep, F.octet_length(whole).cast("long").alias("n_bytes"),
                        count(whole).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
