from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import packing


def test_blocks_of_a_worked_example(spark):
    rows = [(0, [1, 2]), (7, []), (14, [3, 4, 5]), (21, [6])]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    got = packing.pack_blocks(df, "id", F.col("ids"), seq_length=3, end_id=-1, batch_rows=2)
    # Batches 1 2 -1 -1 and 3 4 5 -1 6 -1: the second's last block is exactly full and goes.
    assert sorted((r["batch"], r["block"], r["input_ids"]) for r in got.collect()) == [
        (0, 0, [1, 2, -1]), (1, 0, [3, 4, 5]),
    ]
    assert all(r["labels"] == r["input_ids"] for r in got.collect())


@pytest.mark.parametrize("seq,batch", [(4, 3), (5, 100), (1, 2), (64, 4)])
def test_blocks_hold_each_batch_in_order(spark, seq, batch):
    random.seed(seq)
    rows = [[random.randrange(100) for _ in range(random.randrange(0, 20))] for _ in range(17)]
    df = spark.createDataFrame([(i * 7, r) for i, r in enumerate(rows)], "id long, ids array<int>")
    got = packing.pack_blocks(df, "id", F.col("ids"), seq_length=seq, end_id=-1, batch_rows=batch)
    made = {}
    for r in sorted(got.collect(), key=lambda r: (r["batch"], r["block"])):
        assert len(r["input_ids"]) == seq
        assert r["block"] == len(made.get(r["batch"], [])) // seq
        made.setdefault(r["batch"], []).extend(r["input_ids"])
    for number in range(-(-len(rows) // batch)):
        whole = []
        for ids in rows[number * batch:(number + 1) * batch]:
            whole += [*ids, -1]
        own = made.get(number, [])
        assert whole[:len(own)] == own and 0 < len(whole) - len(own) <= seq


def test_exactly_full_last_block_is_dropped(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6])], "id long, ids array<int>")
    got = packing.pack_blocks(df, "id", F.col("ids"), seq_length=4, end_id=0).collect()
    assert [(r["block"], r["input_ids"]) for r in got] == [(0, [1, 2, 3, 0])]


def test_solution_pairs(spark):
    rows = [
        (1, "q", "s", '["a", "b"]', '{"fn_name": "f"}'), (2, "q", None, "[]", "{}"),
        (3, "q2", "", "broken", ""), (4, "q", "", '["c"]', "null"),
    ]
    df = spark.createDataFrame(
        rows, "id long, question string, starter_code string, solutions string, input_output string"
    )
    pairs = packing.solution_pairs(df, "id")
    got = [(r["id"], r["solution"], "Call" in r["answer_type"]) for r in pairs.orderBy("id", "pos").collect()]
    assert got == [(1, "a", True), (1, "b", True), (4, "c", False)]
    (row,) = packing.pairs_per_question(pairs, "id").collect()
    assert row["pairs"] == 3 and row["solution_chars"] == 3


def test_masked_labels(spark):
    df = spark.createDataFrame([([1, 2], [3])], "q array<int>, a array<int>")
    row = df.select(packing.masked_labels(F.col("q"), F.col("a"), 9, 3).alias("m")).first()["m"]
    assert row["input_ids"] == [1, 2, 3] and row["labels"] == [-100, -100, 3]


def test_padding(spark):
    df = spark.createDataFrame([([5, 0, 7],), ([],), ([1, 2, 3, 4, 5],)], "ids array<int>")
    rows = df.select(
        packing.padded(F.col("ids"), 4).alias("p"), packing.attention(F.col("ids"), 4).alias("m"),
        packing.ignore_padding(packing.padded(F.col("ids"), 4), F.least(F.size("ids"), F.lit(4))).alias("l"),
    ).collect()
    assert [r["p"] for r in rows] == [[5, 0, 7, 0], [0, 0, 0, 0], [1, 2, 3, 4]]
    assert [r["m"] for r in rows] == [[1, 1, 1, 0], [0, 0, 0, 0], [1, 1, 1, 1]]
    assert rows[0]["l"] == [5, 0, 7, -100]


def plain_pair(a, b, sep, limit):
    a, b = list(a), list(b)
    while len(a) + len(b) + len(sep) > limit:
        (a if len(a) > len(b) else b).pop()
    return a + sep + b


def test_pair_encoding_cuts_the_longer_first(spark):
    cases = [(3, 4), (20, 2), (2, 20), (20, 20), (7, 6), (6, 7), (0, 9), (9, 0)]
    df = spark.createDataFrame(
        [(i, list(range(a)), list(range(100, 100 + b))) for i, (a, b) in enumerate(cases)],
        "i long, a array<int>, b array<int>",
    )
    for limit in (9, 10, 15):
        made = packing.pair_encoding(F.col("a"), F.col("b"), F.array(F.lit(-1)), limit)
        rows = df.select("i", made.alias("x")).orderBy("i").collect()
        for row, (a, b) in zip(rows, cases):
            want = plain_pair(range(a), range(100, 100 + b), [-1], limit)
            assert len(row["x"]) == len(want)
            assert abs(row["x"].index(-1) - want.index(-1)) <= 1


def test_pack_budget_keeps_every_row(spark):
    df = spark.range(500).select("id", F.repeat(F.lit("w "), (F.col("id") % 30).cast("int")).alias("text"))
    got = packing.pack_budget(df, "id", F.col("text"), budget=50, shards=4)
    assert got.count() == 500
    sums = got.groupBy("shard", "pack_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r["n"] for r in sums) < 50 + 30


def brute_packs(sizes, budget, seed):
    """Packs one draw at a time, by the definition of a draw."""
    pool = sorted(k for k, n in sizes.items() if n)
    out = {}
    for pack in sizes:
        members, filled = [pack], sizes[pack] or 0
        while pool and filled < budget:
            mark = f"{seed}:{pack}:{len(members)}"
            pick = pool[int(hashlib.md5(mark.encode()).hexdigest()[:15], 16) % len(pool)]
            members.append(pick)
            filled += sizes[pick]
        out[pack] = members
    return out


@pytest.mark.parametrize("kind", ["even", "skewed", "some empty", "one", "all empty", "none"])
def test_random_packs(spark, kind):
    random.seed(kind)
    sizes = {
        "even": {i: random.randrange(1, 30) for i in range(200)},
        "skewed": {i: 5_000 if i == 3 else 1 for i in range(60)},
        "some empty": {i: random.choice([0, None, 1, 40]) for i in range(80)},
        "one": {4: 3}, "all empty": {1: 0, 2: None}, "none": {},
    }[kind]
    df = spark.createDataFrame([(f"k{k}", n, "x") for k, n in sizes.items()], "id string, n int, pack string")
    got = {}
    for r in packing.pack_draws(df, "id", F.col("n"), budget=100, seed=3).orderBy("pack", "place").collect():
        assert r["place"] == len(got.setdefault(r["pack"], []))
        got[r["pack"]].append(r["id"])
        assert r["n_tokens"] == (sizes[int(r["id"][1:])] or 0)
    assert got == brute_packs({f"k{k}": n for k, n in sizes.items()}, 100, 3)
    if kind == "even":
        # Repeats happen, and every row is drawn by someone.
        assert any(len(set(m)) < len(m) for m in got.values())
        assert len({m for ms in got.values() for m in ms[1:]}) > 190


def test_labels_and_copies(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "name string")
    got = sorted((r["name"] or "", r["code"]) for r in packing.encode_labels(df, "name", "code").collect())
    assert got == [("", None), ("a", 0), ("b", 1), ("b", 1)]
    assert packing.copies_needed(20, 3, 10, 8) == 7
    assert packing.copies_needed(1, 1, 9, 8) == 2
    assert packing.copies_needed(1, 1, 8, 8) == 1
    assert packing.replicate(spark.range(3), 4).count() == 12


def test_docstring_removal(spark):
    df = spark.createDataFrame([('def f():\n  """d"""\n  x',), ("none",)], "c string")
    got = [r[0] for r in df.select(packing.without_docstring(F.col("c"))).collect()]
    assert got == ["def f():\n  x", None]
