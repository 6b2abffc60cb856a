"""SimHash near-duplicates, candidates pruned by pigeonring chains.

The 64 bits are a ring of eight segments. If two fingerprints differ in at most three bits, there
is a segment from which on every run of l segments differs in at most 3 l / 8 bits (rounded down):
none in the first two, one in the first five, two in the first seven. One differing bit in segments
three to five leaves two of these alike, so four whole segments agree: 8 starts times 3 choices are
24 keys of 32 bits, which an equi-join matches. The chain's budgets are checked before the full
Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.components import components, spread_join, with_least
from tallymill.llm.shared import bits_of, small_batches, written

SEGMENTS, WIDTH = 8, 8
KEY = ("k", "part")


def _mask(segments) -> int:
    return reduce(lambda m, s: m | 0xFF << WIDTH * (s % SEGMENTS), segments, 0)


def keys() -> list[tuple[int, int]]:
    """(start, mask) of each of the 24 keys: two segments, and two of the next three."""
    return [(i, _mask([i, i + 1, *(i + 2 + k for k in range(3) if k != out)]))
            for i in range(SEGMENTS) for out in range(3)]


def runs(start: int, most: int) -> list[tuple[int, int]]:
    """(mask, budget) of each run of segments from `start`, where the budget steps up next."""
    budgets = [most * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
    return [(_mask(range(start, start + n)), budgets[n - 1]) for n in range(1, SEGMENTS)
            if budgets[n] > budgets[n - 1]]


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority bits of the XXH64 hashes of a word sequence's shingles; none: zero."""
    import xxhash

    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - shingle + 1
    total = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, last, 65_536):  # bounded memory for very long texts
        b = min(a + 65_536, last)
        hashes = np.array([digest(joined[s:e], 42) for s, e in
                           zip(starts[a:b].tolist(), ends[a + shingle - 1:b + shingle - 1].tolist())],
                          dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > last, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """SimHash of a text as a signed 64-bit number: A-Z lower-cased, words between blanks."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            # Byte strings lower-case A-Z alone and split at just the blanks meant here.
            found = [fingerprint(t.encode().lower().split() if t else [], shingle) for t in texts]
            yield pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    return of(text)


def _entries(nodes: DataFrame) -> DataFrame:
    """Each fingerprint under its 24 keys: (fp, k, part)."""
    return nodes.select("fp", F.posexplode(F.array(
        *(F.col("fp").bitwiseAND(F.lit(bits_of(mask))) for _, mask in keys()))).alias("k", "part"))


def _in_budget(x: Column, start: int, most: int) -> Column:
    """Whether differing bits `x` stay within the budget of each run of segments from `start`."""
    chain = [F.bit_count(x.bitwiseAND(F.lit(bits_of(m)))) <= n for m, n in runs(start, most) if n]
    return reduce(lambda p, q: p & q, chain, F.lit(True))


def _near(x: Column, k: Column, most: int) -> Column:
    """Whether two fingerprints that share key `k` and differ in `x` link there: chain, then all bits."""
    starts = [start for start, _ in keys()]
    chain = F.when(F.lit(False), F.lit(False))
    for start in sorted(set(starts)):
        chain = chain.when(k.isin([i for i, s in enumerate(starts) if s == start]), _in_budget(x, start, most))
    return chain & (F.bit_count(x) <= most)


def _near_anywhere(x: Column, most: int) -> Column:
    """Whether two fingerprints that differ in `x` link at all: a chain from some segment, then all bits."""
    return reduce(lambda p, q: p | q, (_in_budget(x, i, most) for i in range(SEGMENTS))) & (F.bit_count(x) <= most)


def _checked(most: int) -> None:
    if not 0 <= most <= 3:
        raise ValueError("the keys are made for at most three differing bits")


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(u, v) with u < v of all fingerprints (column `fp`, distinct) at most `most` bits apart.

    Each link comes from the first key on which it can be found, so it is emitted once. `most` must
    not be above 3, for which the keys are made. All pairs of a group of near copies are listed; for
    groups alone `spanning_links` are enough.
    """
    _checked(most)
    entries = _entries(nodes)
    a, b = entries.alias("a"), entries.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    def found_at(start: int, mask: int) -> Column:
        return (x.bitwiseAND(F.lit(bits_of(mask))) == 0) & _in_budget(x, start, most)

    first = F.coalesce(*(F.when(found_at(*place), F.lit(k)) for k, place in enumerate(keys())))
    near = ((F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part"))
            & (F.col("a.fp") < F.col("b.fp")) & (first == F.col("a.k")) & (F.bit_count(x) <= most))
    return a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def spanning_links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Links (u, v), u < v, with the same components as all `links`; some may repeat.

    Fingerprints that share a key are first held against the least of them, by a chain from any
    segment: one link each. Of the components that these make, only a key's commonest one is not
    compared within itself; every other fingerprint is held against all of its key that are not in
    its component yet. So n near copies of one text give about n links in place of n * n / 2, and
    no link between two components is left out.
    """
    _checked(most)
    held = written(with_least(_entries(nodes), KEY, "fp").filter("members > 1").drop("members"), "keys")
    near = _near_anywhere(F.col("fp").bitwiseXOR(F.col("least")), most)
    centred = held.filter(near & F.expr("fp <> least")).select(F.col("least").alias("u"), F.col("fp").alias("v"))
    roots = components(centred).withColumnRenamed("node", "fp")
    rooted = held.drop("least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    main = rooted.groupBy(*KEY, "root").agg(F.count("*").alias("n")).groupBy(*KEY).agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = spread_join(rooted, main.filter("roots > 1").drop("roots"), KEY, "fp")
    a, b = mixed.filter("root <> main").alias("a"), mixed.alias("b")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp"))
    other = ((F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part")) & once
             & (F.col("a.root") != F.col("b.root"))
             & _near(F.col("a.fp").bitwiseXOR(F.col("b.fp")), F.col("a.k"), most))
    rest = a.join(b, other).select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v"))
    return centred.unionByName(rest)


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3,
                    most: int = 3) -> DataFrame:
    """One row per row of `df`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least id that links reach, the row's own included. Texts without words have
    fingerprint zero and link like any other, null texts among them. Rows with a null id take part;
    their component's least id is taken over the ids that are not null (null if there are none).
    Equal fingerprints are one node, so copies make no pairs; near copies of one text are linked
    through one of them. Very long texts are hashed in pieces. An empty table gives no rows; other
    columns play no part.
    """
    small_batches(df.sparkSession)
    marked = written(df.select(F.col(doc).cast("long").alias("doc_id"),
                               fingerprints(F.col(text).cast("string"), shingle).alias("fp")), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(spanning_links(nodes.select("fp"), most)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = with_least(rooted.withColumnRenamed("least", "id"), ["root"], "id").select(
        "fp", F.col("least").alias("component_id"))
    return spread_join(marked, named, ["fp"], "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
