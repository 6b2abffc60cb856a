"""Quality rules: counts of a text, and lines that too many documents of a host share.

Lines are normalised and hashed; for each host the distinct documents that hold a line are
counted. Lines above the host's limit are removed, and a document that loses too much of its words
by that is depleted and rejected. Column functions and joins alone; copies of a text within a host
count as one document, so a repeated document does not turn its own lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.shared import SPACE_CHARS, SPACES, let

WORD = f"[^{SPACES}]+"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside windows of this many words that occur twice or more, the first included."""
    places = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.when(F.size(words) >= window, F.transform(
        places, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window)))))

    def covered(hashed: Column) -> Column:
        # Sorting puts equal windows side by side; what is left is sorted by place again.
        def again(found: Column) -> Column:
            def same(e: Column, k: Column) -> Column:
                return (F.coalesce(F.get(found, k - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(found, k + 1)["h"] == e["h"], F.lit(False)))

            return F.sort_array(F.transform(F.filter(found, same), lambda e: e["i"]))

        order = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(let(order, again), start, lambda a, i: F.struct(
            i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")))["n"]

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(
        F.lit(0).cast("long")))


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the column `text`."""
    whole = F.col(text)
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    worded = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))
    return (
        df.withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.char_length(_without(whole, SPACE_CHARS)).cast("long"))
        .withColumn("n_symbols", (F.char_length(whole) - F.char_length(_without(whole, SYMBOLS))).cast("long"))
        .withColumn("n_dup_lines", let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", let(words, lambda w: F.when(F.size(w) > 0, repeated_words(w)).otherwise(
            F.lit(0).cast("long"))))
    )


def _lines(df: DataFrame) -> DataFrame:
    """(host, a, b, line, words) of each line with a word; a and b name the text."""
    plain = F.trim(F.regexp_replace(F.lower("line"), f"[{SPACES}]+", " "))
    words = F.char_length(plain) - F.char_length(_without(plain, " ")) + 1
    split = df.select("host", "a", "b", F.explode(F.split("whole", "\n", -1)).alias("line"))
    return split.select("host", "a", "b", plain.alias("plain"), words.cast("long").alias("words")).filter(
        "plain <> ''").select("host", "a", "b", F.xxhash64("plain").alias("line"), "words")


def quality_rules(df: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source",
                  min_words: int = 50, max_repeat: int = 50, min_documents: int = 5,
                  max_root: float = 1.0, max_removed: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, n_removed_words, kept.

    base_failed: under `min_words` words, or over `max_repeat` percent of them in repeated windows.
    A line goes if more than `min_documents` of its host's distinct documents hold it, and more than
    `max_root` times the square root of their number: a limit that holds for small hosts too, and
    falls as a share of large ones. kept is false if base_failed, or if over `max_removed` of the words go.
    A null text has no words and so fails; a null host is the empty host; repeated rows get equal
    results; an empty table gives no rows; other columns play no part.
    """
    marked = df.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("whole")).select(
        "doc_id", "host", "whole", F.xxhash64("whole").alias("a"), F.hash("whole").alias("b"))
    key = ["host", "a", "b"]
    counts = text_counts(marked, "whole").select(
        "doc_id", *key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    copies = marked.groupBy(*key).agg(F.count("*").alias("copies"))
    hosts = copies.groupBy("host").agg(F.count("*").alias("documents"))
    lines = _lines(marked).groupBy(*key, "line").agg(F.sum("words").alias("words"))
    shared = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_documents)
    common = shared.join(hosts, "host").filter(F.col("n") > max_root * F.sqrt("documents")).select("host", "line")
    # Copies multiply the words of their text; dividing by their number undoes that.
    gone = lines.join(common, ["host", "line"]).groupBy(*key).agg(F.sum("words").alias("words"))
    removed = gone.join(copies, key).select(*key, (F.col("words") / F.col("copies")).cast("long").alias("gone"))

    judged = counts.join(removed, key, "left")
    n_removed = F.coalesce("gone", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), n_removed.alias("n_removed_words"),
        (~failed & (n_removed <= max_removed * F.col("n_words"))).alias("kept"))
