from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import dictionary
from tallymill.operators.numbering import number_sorted


@pytest.mark.parametrize("head", [0, 3, 4_096])
def test_ids_are_positions_in_the_vocabulary(spark, monkeypatch, head):
    monkeypatch.setattr(dictionary, "HEAD", head)
    monkeypatch.setattr(dictionary, "SLICE", 7)
    random.seed(head)
    words = [f"w{i}" for i in range(60)] + ["é", "😀", "", "W1"]
    rows = [(i, random.choices(words, weights=range(1, len(words) + 1), k=random.randint(0, 40)),
             None if i % 9 == 0 else random.choices(words, k=i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    known = dictionary.vocabulary(df, F.concat("a", F.coalesce("b", F.array().cast("array<string>"))), first=2)
    ids = {r["token"]: r["id"] for r in known.collect()}
    assert ids == {w: i for i, w in enumerate(sorted({x for _, a, b in rows for x in a + (b or [])}, key=str.encode), 2)}
    got = {r["id"]: (r["a"], r["b"]) for r in dictionary.encode(df, "id", {"a": F.col("a"), "b": F.col("b")}, known).collect()}
    assert got == {i: ([ids[x] for x in a], None if b is None else [ids[x] for x in b]) for i, a, b in rows}


def test_a_slice_sends_each_token_once(spark, monkeypatch):
    frames, staged = {}, dictionary.staged
    monkeypatch.setattr(dictionary, "staged", lambda df, name: frames.setdefault(name, staged(df, name)))
    df = spark.range(64).coalesce(1).select("id", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 5), 300).alias("ids"))
    known = dictionary.vocabulary(df, F.col("ids"))
    got = dictionary.encode(df, "id", {"ids": F.col("ids"), "slice": F.array(F.lit("w0"))}, known).collect()
    assert all(r["ids"] == [r["id"] % 5] * 300 and r["slice"] == [0] for r in got) and len(got) == 64
    assert [len(r[0]) for r in frames["slices"].where("__tokens IS NOT NULL").select("__tokens").collect()] == [5]


def test_unknown_tokens(spark):
    df = spark.createDataFrame([(1, ["a", "z", "b"])], "id long, t array<string>")
    known = dictionary.vocabulary(spark.createDataFrame([(["b", "a", "b"],)], "t array<string>"), F.col("t"))
    assert dictionary.encode(df, "id", {"t": F.col("t")}, known, unknown=9).first()["t"] == [0, 9, 1]
    with pytest.raises(Exception, match="not in the vocabulary: z"):
        dictionary.encode(df, "id", {"t": F.col("t")}, known).collect()


def test_one_token_with_most_uses_and_empty_tables(spark):
    df = spark.range(300).select("id", F.array_repeat(F.lit("the"), 200).alias("t"))
    known = dictionary.vocabulary(df, F.col("t"), first=5)
    assert [tuple(r) for r in known.select("token", "uses", "id").collect()] == [("the", 60_000, 5)]
    got = dictionary.encode(df, "id", {"t": F.col("t")}, known)
    assert got.where(F.size("t") != 200).count() == 0 and got.count() == 300
    assert dictionary.encode(df.limit(0), "id", {"t": F.col("t")}, dictionary.vocabulary(df.limit(0), F.col("t"))).count() == 0


def test_number_sorted(spark):
    keys = random.Random(3).sample(range(10**6), 2_000)
    df = spark.createDataFrame([(f"k{x}", x) for x in keys], "k string, v long").repartition(7)
    got = {r["k"]: r["n"] for r in number_sorted(df, ["k"], into="n", first=4).collect()}
    assert got == {k: i for i, k in enumerate(sorted(f"k{x}" for x in keys), 4)}
