"""Byte-level BPE encoding and decoding by folding ranked merges.

A text is split into words by the vocabulary's pattern. A word that is a token stands for itself;
any other is a byte array over which ranked merges are folded: the pair of least rank merges first,
the leftmost of these. Decoding concatenates binary pieces.

`Bpe` does this with Spark's higher-order functions, which work out every word of every text anew.
`coded` does the same fold once per distinct word of a task, which whole corpora need.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from random import Random

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.shared import let, small_batches
from tallymill.llm.vocab import once

#: Above every rank: no merge.
NEVER = 1 << 30
#: What splits a text into words; Java's \\s is narrower than Unicode's white space, so that is spelt out.
_BLANK = r"\s\x85\xA0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _BLANK + r"\p{L}\p{N}]+|["
           + _BLANK + r"]+(?![^" + _BLANK + r"])|[" + _BLANK + "]+")


def _hash(value: bytes) -> int:
    """Spark's xxhash64 of a binary, or of a long given as its eight little-endian bytes."""
    return xxhash.xxh64_intdigest(value, 42)


def table_without_collisions(keys: dict[int, int]) -> tuple[list[int], list[int]]:
    """(shifts, slots): a hash's own entry is at slots[((h >> 16) + shifts[h mod len] * (h >> 40 | 1)) mod len].

    `keys` gives an entry (not negative) per 64-bit hash; empty slots hold -1.
    """
    width = 1
    while width < 2 * len(keys):
        width *= 2
    buckets: list[list[int]] = [[] for _ in range(max(width // 8, 1))]
    for h in keys:
        buckets[h % len(buckets)].append(h)
    shifts, slots, draw = [0] * len(buckets), [-1] * width, Random(7)
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        while True:
            places = {((h >> 16) + shifts[b] * (h >> 40 | 1)) % width: h for h in buckets[b]}
            if len(places) == len(buckets[b]) and all(slots[p] < 0 for p in places):
                break
            shifts[b] = draw.randrange(width)
        for p, h in places.items():
            slots[p] = keys[h]
    return shifts, slots


class Bpe:
    """Column functions of one rank file: `encode` from text to ids, `decode` from ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        merges = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    merges[_hash((a << 16 | b).to_bytes(8, "little"))] = (a << 16 | b) << 16 | rank
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        pair_shifts, pair_slots = table_without_collisions(merges)
        word_shifts, word_slots = table_without_collisions({_hash(t): r for t, r in ranks.items()})
        row = (pair_shifts, pair_slots, word_shifts, word_slots, [ranks[bytes([b])] for b in range(256)],
               [p.hex() for p in pieces], [r.to_bytes(4, "little").hex() for r in range(len(pieces))])
        names = ["pair_shifts", "pair_slots", "word_shifts", "word_slots", "bytes", "hex", "id_hex"]
        kinds = ["int", "bigint", "int", "int", "int", "string", "string"]
        # Literals: the optimizer reads them once, so that lambdas index plain arrays.
        self.tables = {n: F.from_json(F.lit(json.dumps(v)), f"array<{k}>") for n, k, v in zip(names, kinds, row)}
        self.sizes = {n: len(v) for n, v in zip(names, row)}

    def _entry(self, kind: str, h: Column) -> Column:
        shifts, slots = f"{kind}_shifts", f"{kind}_slots"
        shift = F.get(self.tables[shifts], h.bitwiseAND(F.lit(self.sizes[shifts] - 1)).cast("int")).cast("long")
        step = F.shiftrightunsigned(h, 40).bitwiseOR(F.lit(1).cast("long"))
        place = (F.shiftrightunsigned(h, 16) + shift * step).bitwiseAND(F.lit(self.sizes[slots] - 1))
        return F.get(self.tables[slots], place.cast("int"))

    def _rank(self, a: Column, b: Column) -> Column:
        """Rank of two neighbouring pieces' merge."""
        key = F.shiftleft(a.cast("long"), 16).bitwiseOR(b.cast("long"))
        return let(key, lambda k: let(self._entry("pair", F.xxhash64(k)), lambda e: F.when(
            F.shiftright(e, 16) == k, e.bitwiseAND(F.lit(65_535)).cast("int")).otherwise(F.lit(NEVER))))

    def _merge(self, state: Column, m: Column) -> Column:
        ids, ranks = state["ids"], state["ranks"]
        none = F.array().cast("array<int>")

        def merged(p: Column) -> Column:
            left = F.when(p > 1, F.array(self._rank(F.get(ids, p - 2), m))).otherwise(none)
            right = F.when(p < F.size(ranks), F.array(self._rank(m, F.get(ids, p + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), p - 1), F.array(m), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
                F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right,
                         F.slice(ranks, p + 2, F.size(ranks))).alias("ranks"))

        return let(F.array_position(ranks, m).cast("int"), merged)

    def _folded(self, word: Column) -> Column:
        """Ids of a word's bytes after all merges."""
        digits = F.hex(word)
        ids = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.get(
            self.tables["bytes"], F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))

        def start(x: Column) -> Column:
            ranks = F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda a, i: self._rank(a, F.get(x, i + 1)))
            return F.struct(x.alias("ids"), ranks.alias("ranks"))

        def step(state: Column, _: Column) -> Column:
            return let(F.array_min(state["ranks"]), lambda m: F.when(
                m < NEVER, self._merge(state, m)).otherwise(state))

        return let(let(ids, start), lambda s: F.aggregate(s["ranks"], s, step)["ids"])

    def _word(self, word: Column) -> Column:
        known = let(self._entry("word", F.xxhash64(word)), lambda r: F.when(
            (r >= 0) & (F.get(self.tables["hex"], r) == F.lower(F.hex(word))), F.array(r)))
        return F.coalesce(known, self._folded(word))

    def encode(self, text: Column) -> Column:
        """Ids of a text; null is an empty text."""
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))
        return F.flatten(F.transform(words, lambda w: self._word(w.cast("binary"))))

    def id_bytes(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.tables["id_hex"], i)), ""))

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for: their pieces put together."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.tables["hex"], i)), ""))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: its byte array with the ranked merges folded over it."""
    if word in ranks:
        return [ranks[word]]
    pieces = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, NEVER) for a, b in zip(pieces, pieces[1:])]
    while pairs and (least := min(pairs)) < NEVER:
        at = pairs.index(least)
        pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + pieces[at], NEVER)
        if at < len(pairs):
            pairs[at] = ranks.get(pieces[at] + pieces[at + 1], NEVER)
    return [ranks[p] for p in pieces]


class WordCodec:
    """Encodes texts by their distinct words. Words already seen are kept, up to a bound."""

    KEPT = 200_000

    def __init__(self, ranks: dict[bytes, int]):
        import public_tokenizers
        import regex

        self.ranks, self.known = ranks, {}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.KEPT:
            self.known, new = {}, set(words)
        for word in new:
            self.known[word] = array("I", merged(word.encode(), self.ranks)).tobytes()
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, array("I", ids)))


def coded(spark: SparkSession, ranks: dict[bytes, int]):
    """A column function from text to its ids, as bytes, and to what these decode to."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(ranks)
    key = ("codec", hash(frozenset(ranks.items())))

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = once(key, lambda: WordCodec(sent.value))
        for texts in batches:
            ids = [codec.encode(t) if t else b"" for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(x) for x in ids]})

    return both


def round_trip(df: DataFrame, ranks: dict[bytes, int], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty: no ids, and the digests of nothing. Repeated rows and null ids are rows
    like any other; an empty table gives no rows; other columns play no part. No shuffle.
    """
    found = df.select(F.col(doc).alias("doc_id"), coded(df.sparkSession, ranks)(F.col(text).cast("string")).alias("c"))
    return found.select("doc_id", F.floor(F.octet_length("c.ids") / 4).alias("n_tokens"),
                        F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256"))
