"""Hard negatives by blocks of candidates with zone maps.

Candidates are put in the order of (label, place on a Hilbert curve) and cut into blocks; a block
is one row of a Parquet file, with the least and the greatest value of each dimension as columns
of their own, so the zone maps are read without the vectors. Anchors of one block travel as a
group. Interval arithmetic on a group's hull and a block's zone map bounds every score between
them; only blocks whose bounds meet what a group still looks for are sent to it: first for
positives (scores that reach the k-th best of the anchor's own block), then for the windows that
the positives open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.shared import written

#: Dimensions of the curve, those that vary most, and bits of each: a place is below 2^56.
CURVE_DIMS, CURVE_BITS = 8, 7
#: Zone maps and groups that one task compares at a time, and blocks that one reads, about.
ZONES, GROUPS, BLOCKS = 4_096, 4_096, 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_BLOCK = ("block long, n int, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, "
          "v binary, asks binary")
_GROUP = ("g long, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, v binary, "
          "floors binary, floor long")


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of integer coordinates in [0, 2^bits).

    Works down from the highest bit: a coordinate whose bit is set turns the lower bits of the first
    one over, any other trades them with it; then the Gray code of the turned bits is undone.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            is_set = (x[d] >> bit & 1).astype(bool)
            trade = np.where(is_set, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(is_set, low, trade)
            x[d] ^= trade
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            place = place << 1 | x[d] >> bit & 1
    return place


def hull_bounds(lo: np.ndarray, hi: np.ndarray, zone_lo: np.ndarray, zone_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of a vector in one box with one in each of many boxes."""
    ends = np.stack([lo * zone_lo, lo * zone_hi, hi * zone_lo, hi * zone_hi])
    return ends.min(axis=0).sum(axis=1), ends.max(axis=0).sum(axis=1)


def point_bounds(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each point with a vector in one box."""
    up, down = np.maximum(points, 0), np.minimum(points, 0)
    return up @ lo + down @ hi, up @ hi + down @ lo


class Shape(NamedTuple):
    """How vectors are kept: their width, the number type on disk, and that of exact sums."""

    width: int
    kept: str
    exact: type

    def matrix(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.kept).reshape(-1, self.width).astype(self.exact)

    def row(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.kept).astype(np.float64)


def _longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<i8")


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as Arrow, by a schema of longs, ints and binaries."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, names)], [name for name, _ in names])


def candidate_blocks(rows: DataFrame, shape: Shape, curve: tuple[np.ndarray, np.ndarray, np.ndarray],
                     block_rows: int) -> DataFrame:
    """Blocks of distinct (id, label, v) rows, in curve order, written to the shared folder."""
    dims, start, step = curve

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, shape.width), dtype=shape.kept)
            for i, own in enumerate(batch.column(3).to_pylist()):
                v[i, :len(own)] = own
            cells = np.clip((v[:, dims] - start) / step, 0, (1 << CURVE_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(hilbert_place(cells, CURVE_BITS), pa.int64()),
                 pa.array([x.tobytes() for x in v], pa.binary())], ["id", "label", "asks", "h", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, held = TaskContext.get().partitionId() << 32, None, []

        def block() -> pa.RecordBatch:
            v = np.frombuffer(b"".join(r[3] for r in held), dtype=shape.kept).reshape(-1, shape.width)
            labels = np.array([r[1] for r in held], dtype="<i8")
            return _batch(_BLOCK, [(
                number, len(held), labels[0], labels[-1], v.min(axis=0).tobytes(), v.max(axis=0).tobytes(),
                np.array([r[0] for r in held], dtype="<i8").tobytes(), labels.tobytes(), v.tobytes(),
                bytes(r[2] for r in held))])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "asks", "v"))):
                if row == last:  # repeated rows stand side by side
                    continue
                last = row
                held.append(row)
                if len(held) == block_rows:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    order = ["label", "h", "id", "v"]
    found = rows.select("id", "label", "asks", "v").mapInArrow(placed, "id long, label long, asks boolean, h long, v binary")
    return written(found.repartitionByRange(*order).sortWithinPartitions(*order, "asks").mapInArrow(cut, _BLOCK), "blocks")


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row, LEAST where there are fewer columns."""
    if scores.shape[1] < k:
        return np.full(len(scores), LEAST, dtype="<i8")
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def anchor_groups(blocks: DataFrame, shape: Shape, positives: int) -> DataFrame:
    """The anchors of each block as one row, with the least score each has a use for, written.

    That floor is the score of the last of `positives` rows of the anchor's label in its own block.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["asks"], dtype=np.uint8))
                if not len(at):
                    continue
                v, ids, labels = shape.matrix(r["v"]), _longs(r["ids"]), _longs(r["labels"])
                score = (v[at] @ v.T).astype(np.int64)
                score[(labels[at, None] != labels) | (ids[at, None] == ids)] = LEAST + 1
                floors = _kth(score, positives)
                own = v[at].astype(shape.kept)
                rows.append((r["block"], labels[at].min(), labels[at].max(), own.min(axis=0).tobytes(),
                             own.max(axis=0).tobytes(), ids[at].tobytes(), labels[at].tobytes(), own.tobytes(),
                             floors.astype("<i8").tobytes(), int(floors.min())))
            yield _batch(_GROUP, rows)

    return written(blocks.select("block", "ids", "labels", "v", "asks").mapInArrow(grouped, _GROUP), "anchors")


def blocks_to_read(blocks: DataFrame, groups: DataFrame, shape: Shape, same_label: bool) -> DataFrame:
    """(g, block, part): blocks that a group has to read, written to the shared folder.

    `groups` has a least and, for rows of other labels, a greatest score (floor, ceiling) that any
    of its anchors still looks for. A block is read if its bounds on the group's hull meet them and
    it can hold rows of the labels asked for. Groups are dealt to every part of the zone maps: all
    anchors against all blocks, but hulls and zone maps only.
    """
    of_zones = max(1, -(-blocks.count() // ZONES))
    of_groups = max(1, -(-groups.count() // GROUPS))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    box = ("label_lo", "label_hi", "lo", "hi")
    zones = blocks.select("block", *box, part("block", of_zones).alias("zone"), copies(of_groups).alias("part"))
    ceiling = F.lit(MOST) if same_label else F.col("ceiling")
    hulls = groups.select("g", *box, "floor", ceiling.alias("ceiling"), part("g", of_groups).alias("to_part"),
                          copies(of_zones).alias("to_zone"))

    def chosen(known: pa.Table, asking: pa.Table) -> pa.Table:
        lo, hi = (np.array([shape.row(x) for x in known.column(c).to_pylist()]).reshape(-1, shape.width)
                  for c in ("lo", "hi"))
        first, last, names = (known.column(c).to_numpy() for c in ("label_lo", "label_hi", "block"))
        out = []
        for r in asking.to_pylist():
            least, most = hull_bounds(shape.row(r["lo"]), shape.row(r["hi"]), lo, hi)
            # Sums of floating point are a little off where numbers are huge.
            slack = 1e-9 * np.maximum(np.abs(least), np.abs(most))
            take = (most + slack >= r["floor"]) & (least - slack <= r["ceiling"])
            if same_label:
                take &= (first <= r["label_hi"]) & (last >= r["label_lo"])
            else:
                take &= ~((first == last) & (first == r["label_lo"]) & (last == r["label_hi"]))
            out += [(r["g"], block, r["to_part"]) for block in names[take]]
        return pa.Table.from_batches([_batch("g long, block long, part int", out)])

    found = zones.groupBy("zone", "part").cogroup(hulls.groupBy("to_zone", "to_part")).applyInArrow(
        chosen, "g long, block long, part int")
    return written(found, "reads")


def _read(blocks: DataFrame, groups: DataFrame, pairs: DataFrame, schema: str,
          solve: Callable[[list[dict], dict], Iterator[tuple]]) -> DataFrame:
    """Rows of `solve(candidates, group)`, where candidates are blocks that the group has to read.

    A task holds about BLOCKS blocks. A block goes once to each part of the groups that asks for it,
    a group once to each task, with the names of its blocks.
    """
    bins = max(1, -(-blocks.count() // BLOCKS))
    dealt = pairs.withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins)).cast("int"))
    asks = dealt.groupBy("g", F.col("bin").alias("to_bin"), F.col("part").alias("to_part")).agg(
        F.collect_list("block").alias("reads")).join(groups, "g")
    needed = dealt.select("block", "bin", "part").distinct().join(blocks.drop("asks", "n"), "block")

    def solved(known: pa.Table, asking: pa.Table) -> pa.Table:
        held, out = {r["block"]: r for r in known.to_pylist()}, []
        for group in asking.to_batches(max_chunksize=64):
            for r in group.to_pylist():
                out += solve([held[b] for b in sorted(r["reads"])], r)
        return pa.Table.from_batches([_batch(schema, out)])

    return needed.groupBy("bin", "part").cogroup(asks.groupBy("to_bin", "to_part")).applyInArrow(solved, schema)


def _highest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of one row, the smaller id first where equal."""
    if len(score) > k:
        some = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
                   label: str | Column = "label", block_rows: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each component x counts as floor(scale * x), x as a double; a score is an integer inner product,
    higher scores first, ties to the smaller id. An anchor's positives are its first `positives`
    rows of the same label with another id. For each, the first `negatives` rows of other labels and
    another id with low * positive_score <= 100 * score <= high * positive_score. Fewer rows give
    fewer results; a window without rows gives none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors
    of unlike length are compared over the components that both have. Rows alike in id, label and
    vector are one row; unlike rows of one id are as many candidates, and as many anchors. Sums must
    stay within 64 bits. Empty tables give no rows; other columns play no part.

    The driver holds two numbers per dimension. A task holds some blocks of `block_rows` rows, and the
    groups of one part that read them.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    real = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = F.col(label) if isinstance(label, str) else label
    rows = (
        df.select(F.col(key).cast("long").alias("id"), own.cast("long").alias("label"),
                  F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("x"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(real)
        .select("id", "label", "asks", F.transform("x", lambda e: F.floor(scale * e)).alias("v"))
    )
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    sizes = rows.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("most")).first()
    if not sizes["width"]:
        return spark.createDataFrame([], schema)
    exact = np.float64 if sizes["most"] < 2**52 else np.int64
    shape = Shape(sizes["width"], "<i2" if sizes["most"] < 2**30 else "<i8", exact)
    e = F.col("e").cast("double")
    spread = {r["d"]: (r["mean"], r["dev"]) for r in rows.select(F.posexplode("v").alias("d", "e")).groupBy("d").agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("dev")).collect()}
    dims = np.array(sorted(spread, key=lambda d: (-round(spread[d][1], 6), d))[:CURVE_DIMS])
    mean, dev = (np.array([spread[d][i] for d in dims]) for i in (0, 1))
    curve = dims, mean - 2.5 * dev, np.maximum(5 * dev, 1e-9) / (1 << CURVE_BITS)

    blocks = candidate_blocks(rows, shape, curve, block_rows)
    groups = anchor_groups(blocks, shape, positives)

    def joined(known: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and vectors of blocks."""
        return (_longs(b"".join(b["ids"] for b in known)), _longs(b"".join(b["labels"] for b in known)),
                shape.matrix(b"".join(b["v"] for b in known)))

    def nearest(known: list[dict], group: dict) -> Iterator[tuple]:
        """For each anchor the best rows of its label in the blocks that reach its floor."""
        points, floors = shape.matrix(group["v"]), _longs(group["floors"])
        of, asks = _longs(group["labels"]), _longs(group["ids"])
        reach = np.zeros((len(known), len(points)), dtype=bool)
        for at, b in enumerate(known):
            _, most = point_bounds(points.astype(np.float64), shape.row(b["lo"]), shape.row(b["hi"]))
            reach[at] = (most + 1e-9 * np.abs(most) >= floors) & (of >= b["label_lo"]) & (of <= b["label_hi"])
        known = [b for b, any_ in zip(known, reach.any(axis=1)) if any_]
        if not known:
            return
        ids, labels, v = joined(known)
        at = np.flatnonzero(reach.any(axis=0))
        score = (points[at] @ v.T).astype(np.int64)
        for i, own in zip(at, score):
            mine = np.flatnonzero((labels == of[i]) & (ids != asks[i]) & (own >= floors[i]))
            for c in mine[_highest(own[mine], ids[mine], positives)]:
                yield group["g"], int(i), int(ids[c]), int(own[c])

    near = _read(blocks, groups, blocks_to_read(blocks, groups, shape, True), "g long, i int, id long, score long", nearest)
    first = Window.partitionBy("g", "i").orderBy(F.desc("score"), "id")
    best = near.withColumn("w", F.row_number().over(first)).filter(F.col("w") <= positives)
    # Bounded: at most `positives` windows for each anchor of a block. No score is in a negative one's window.
    windows = best.filter("score >= 0").groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("i", "w", "id", "score"))).alias("windows"),
        F.min(F.ceil(F.col("score") * low / 100)).alias("floor"), F.max(F.floor(F.col("score") * high / 100)).alias("ceiling"))
    opened = written(groups.drop("floor", "floors").join(windows, "g"), "windows")

    def between(known: list[dict], group: dict) -> Iterator[tuple]:
        """For each window the best rows of other labels in the blocks."""
        points, of, asks = shape.matrix(group["v"]), _longs(group["labels"]), _longs(group["ids"])
        i, p = (np.array([w[c] for w in group["windows"]], dtype=np.int64) for c in ("i", "score"))
        # 100 * score may pass 64 bits; whole numbers within the limits do not.
        lowest = np.array([-(-low * w["score"] // 100) for w in group["windows"]], dtype=np.int64)
        highest = np.array([high * w["score"] // 100 for w in group["windows"]], dtype=np.int64)
        open_ = np.zeros((len(known), len(p)), dtype=bool)
        for at, b in enumerate(known):
            least, most = point_bounds(points.astype(np.float64), shape.row(b["lo"]), shape.row(b["hi"]))
            slack = 1e-9 * np.maximum(np.abs(least), np.abs(most))
            open_[at] = ((most + slack)[i] >= lowest) & ((least - slack)[i] <= highest)
        known = [b for b, any_ in zip(known, open_.any(axis=1)) if any_]
        if not known:
            return
        ids, labels, v = joined(known)
        at = np.unique(i[open_.any(axis=0)])
        score = dict(zip(at, (points[at] @ v.T).astype(np.int64)))
        other = {x: (labels != of[x]) & (ids != asks[x]) for x in at}
        for n in np.flatnonzero(open_.any(axis=0)):
            x, own = i[n], score[i[n]]
            mine = np.flatnonzero(other[x] & (own >= lowest[n]) & (own <= highest[n]))
            for c in mine[_highest(own[mine], ids[mine], negatives)]:
                yield (group["g"], int(x), group["windows"][n]["w"], int(asks[x]), group["windows"][n]["id"], int(p[n]),
                       int(ids[c]), int(own[c]))

    found = _read(blocks, opened, blocks_to_read(blocks, opened, shape, False),
                  "g long, i int, w int, anchor_id long, positive_id long, positive_score long, negative_id long, "
                  "negative_score long", between)
    order = Window.partitionBy("g", "i", "w").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
