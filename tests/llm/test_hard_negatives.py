"""Hard negatives against brute force; the curve; bounds; blocks that are not read."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, block int, g int, id string"


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    own = sorted({(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows
                  if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for a in own:
        if not anchor(a[0]):
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: E731,B023
        near = sorted((-score(r), r[0]) for r in own if r[1] == a[1] and r[0] != a[0])[:positives]
        far = sorted((-score(r), r[0]) for r in own if r[1] != a[1] and r[0] != a[0])
        for s, p in near:
            fit = [(n, x) for n, x in far if low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a[0], p, rank, x, -s, -n) for rank, (n, x) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect())


def vectors(rng, n, width, labels, spread=1.0):
    v = rng.normal(0, spread, (n, width))
    return [(i, (x / np.linalg.norm(x)).tolist(), int(rng.integers(labels))) for i, x in enumerate(v)]


def test_the_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        place = hn.hilbert_place(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, (40, 6)), rng.integers(-9, 9, (50, 6))
    score = a @ b.T
    box = [x.astype(float) for x in (a.min(0), a.max(0), b.min(0), b.max(0))]
    least, most = hn.hull_bounds(*box[:2], box[2][None], box[3][None])
    assert least[0] <= score.min() and score.max() <= most[0]
    least, most = hn.point_bounds(a.astype(float), *box[2:])
    assert (least <= score.min(axis=1)).all() and (score.max(axis=1) <= most).all()


@pytest.mark.parametrize("block_rows", [3, 64])
def test_equals_brute_force(spark, block_rows):
    rows = vectors(np.random.default_rng(block_rows), 150, 5, 3)
    assert run(spark, rows, block_rows=block_rows) == brute(rows, lambda i: i % 5 == 0)


def test_awkward_rows(spark):
    base = [0.5, -0.25, 0.125]
    rows = [(0, base, 1), (0, base, 1), (0, [0.5, 0.5, 0.5], 1), (0, base, 2), (1, base, 1), (2, base, 2), (3, base, 2),
            (3, base, 2), (5, [0.0, 0.0, 0.0], 1), (6, [0.0, 0.0, 0.0], 2), (10, [1.0], 1), (11, [0.9], 2), (12, [0.8, 3.0], 2),
            (13, [], 2), (15, [-1.0, 0.0, 0.0], 3), (16, [1.0, 0.0, 0.0], 3), (20, None, 1), (21, base, None),
            (25, [float("nan"), 1.0], 1), (26, [float("inf")], 1), (27, [None, 1.0], 1), (None, base, 1)]
    rows += [(100 + i, [0.4, -0.2, 0.1], 2) for i in range(6)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert run(spark, rows[:0]) == [] and run(spark, rows[20:23]) == []


def test_small_parts_and_huge_components(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = vectors(rng, 90, 4, 2)
    big = [(i, [x * 2.0**20 for x in v], label) for i, v, label in rows]
    monkeypatch.setattr(hn, "ZONES", 2)
    monkeypatch.setattr(hn, "GROUPS", 2)
    assert run(spark, rows, block_rows=7) == brute(rows, lambda i: i % 5 == 0)
    assert run(spark, big, block_rows=7) == brute(big, lambda i: i % 5 == 0)


def test_one_hot_label_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5], 0) for i in range(120)] + [(i, x, 1) for i, x, _ in vectors(rng, 160, 2, 1)[120:]]
    assert run(spark, rows, block_rows=16) == brute(rows, lambda i: i % 5 == 0)


def test_few_blocks_are_read_on_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (40, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = []
    for i in range(4_000):
        c = int(rng.integers(40))
        rows.append((i, (centres[c] + rng.normal(0, 0.02, 16)).tolist(), c % 20))
    read, real = [], hn.blocks_to_read

    def watched(blocks, groups, *rest):
        pairs = real(blocks, groups, *rest)
        read.append(pairs.count() / max(blocks.count() * groups.count(), 1))
        return pairs

    monkeypatch.setattr(hn, "blocks_to_read", watched)
    some = [r for r in rows if r[0] % 5 == 0][:40]
    got = run(spark, rows, block_rows=32)
    ids = {r[0] for r in some}
    assert [r for r in got if r[0] in ids] == brute(rows, lambda i: i in ids)
    print("share of blocks read", read)
    assert read[0] < 0.1 and read[1] < 0.5
