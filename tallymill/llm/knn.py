"""Exact top-k inner products as a Voronoi nearest-neighbour join.

One more component makes the search metric: with M the largest norm, data become
(x, sqrt(M^2 - |x|^2)) and queries (q, 0), and a larger inner product is a smaller distance.
Queries and data are grouped by their nearest pivot. From a summary per group (sizes, radii, the
k + 1 ids of the least distances to the pivot) each query group gets a distance within which rows
of k ids besides a query's own surely lie; only data that can be that near are sent to the group,
in blocks, and solved there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative slack on distance bounds, far above the rounding of 64-bit sums.
SLACK = 1e-6


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as one matrix; shorter rows are filled with zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    at = 0
    for row, n in enumerate(lengths):
        out[row, :n] = flat[at:at + n]
        at += n
    return out


class Space:
    """The pivots and the distances of rows to them, in the space with one component more."""

    def __init__(self, width: int, most: int, pivots: np.ndarray):
        self.width, self.most = width, float(most)
        self.pivots = self.lifted(pivots.reshape(-1, width).astype(np.float64))

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.most - (rows * rows).sum(axis=1), 0.0))
        return np.hstack([rows, rest[:, None]])

    def distances(self, rows: np.ndarray, queries: bool) -> np.ndarray:
        plain = rows.astype(np.float64)
        placed = np.hstack([plain, np.zeros((len(plain), 1))]) if queries else self.lifted(plain)
        square = ((placed * placed).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)
                  - 2 * placed @ self.pivots.T)
        return np.sqrt(np.maximum(square, 0.0))


def _summary(rows: DataFrame, space: Space, queries: bool,
             least: int) -> dict[int, tuple[int, float, list[tuple[float, int]]]]:
    """For each pivot: rows nearest to it, the largest of their distances, the least ones with
    their ids, each id once, however many rows have it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            all_ = space.distances(_matrix(batch.column(0), space.width), queries)
            ids = np.asarray(batch.column(1))
            cell = all_.argmin(axis=1)
            own = all_[np.arange(len(cell)), cell]
            cells = np.unique(cell)
            near = []
            for c in cells:
                mine = np.flatnonzero(cell == c)
                mine = mine[np.argsort(own[mine], kind="stable")]
                first = np.sort(np.unique(ids[mine], return_index=True)[1])[:least]
                near.append([{"d": float(own[i]), "id": int(ids[i])} for i in mine[first]])
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array(cells, pa.int32()),
                "n": pa.array([int((cell == c).sum()) for c in cells], pa.int64()),
                "far": pa.array([float(own[cell == c].max()) for c in cells], pa.float64()),
                "near": pa.array(near, pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))),
            })

    kind = "array<struct<d: double, id: long>>"
    parts = rows.select("v", "id").mapInArrow(partial, f"cell int, n long, far double, near {kind}")
    both = F.aggregate(
        F.sort_array(F.flatten(F.collect_list("near"))), F.array().cast(kind),
        lambda a, e: F.when((F.size(a) < least) & ~F.exists(a, lambda x: x["id"] == e["id"]),
                            F.concat(a, F.array(e))).otherwise(a))
    found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), both.alias("near"))
    return {r["cell"]: (r["n"], r["far"], [(x["d"], x["id"]) for x in r["near"]]) for r in found.collect()}


def _reach(bounds: list[tuple[float, int]], n: int) -> float:
    """The least bound up to which n ids are found; infinite if there are fewer."""
    seen = set()
    for bound, id_ in sorted(bounds):
        seen.add(id_)
        if len(seen) == n:
            return bound
    return math.inf


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, the earlier column first where equal."""
    rows, columns = score.shape
    spread = int(np.abs(score).max(initial=0)) + 1
    if spread < 2**62 // max(columns, 1):
        order = score.astype(np.int64) * columns + (columns - 1 - np.arange(columns))
        if k < columns:
            some = np.argpartition(-order, k - 1, axis=1)[:, :k]
        else:
            some = np.tile(np.arange(columns), (rows, 1))
        own = np.take_along_axis(order, some, axis=1)
        return np.take_along_axis(some, np.argsort(-own, axis=1), axis=1)
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def _answers(score: np.ndarray, asks: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row: unlike in id or score, without the row's own id.

    Ids ascend by column, so equal answers stand side by side. Where they or own rows leave a row
    short of k, more columns are looked at.
    """
    take = min(k + 1, len(ids))
    while True:
        best = _best(score, take)
        found, value = ids[best], np.take_along_axis(score, best, axis=1)
        new = found != asks[:, None]
        new[:, 1:] &= (found[:, 1:] != found[:, :-1]) | (value[:, 1:] != value[:, :-1])
        place = new.cumsum(axis=1)
        if take == len(ids) or (place[:, -1] >= k).all():
            row, at = np.nonzero(new & (place <= k))
            return row, best[row, at]
        take = min(2 * take, len(ids))


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id",
          vector: str = "embedding", pivots: int = 16, query_block: int = 4096,
          data_block: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query.

    Each component x counts as floor(scale * x), x as a double. Candidates are all rows but those
    with the query's own id; ties go to the smaller id; fewer candidates give fewer rows. Rows
    with a null id or vector, or a null or non-finite component, take no part. Vectors of unlike
    length are compared over the components that both have. A query id that repeats is one query
    per distinct vector, whose results are merged; repeated rows are one candidate, and so are rows
    of one id with equal scores. Sums must stay within 64 bits. Empty tables give no rows; other columns play no part.

    `pivots` bounds what the driver holds (one summary each); a task holds `query_block` queries
    and about `data_block` data rows.
    """
    spark = df.sparkSession
    real = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = (
        df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"),
                  F.coalesce(is_query, F.lit(False)).alias("asks"))
        .filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(real)
        .select("id", F.transform("x", lambda e: F.floor(scale * e)).alias("v"), "asks")
    )
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    sizes = rows.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("most"), F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not sizes["n"] or not sizes["width"]:
        return spark.createDataFrame([], schema)
    width = sizes["width"]
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).select("v").collect()
    first = np.zeros((len(chosen), width), dtype=np.int64)
    for i, r in enumerate(chosen):
        first[i, :len(r["v"])] = r["v"]
    space = Space(width, sizes["most"], first)

    asked = rows.filter("asks")
    data_groups, query_groups = _summary(rows, space, False, k + 1), _summary(asked, space, True, 0)
    if not query_groups:
        return spark.createDataFrame([], schema)
    between = space.distances(first, False)  # pivots are lifted like data
    within: dict[int, float] = {}
    for cell, (_, far, _) in query_groups.items():
        # One id more than k, since rows with a query's own id are no candidates.
        reach = _reach([(far + between[cell][j] + d, id_) for j, (_, _, near) in data_groups.items()
                        for d, id_ in near], k + 1)
        within[cell] = (reach + far) * (1 + SLACK) + SLACK
    data_blocks = max(1, math.ceil(sizes["n"] / data_block))
    query_blocks = {cell: math.ceil(n / query_block) for cell, (n, _, _) in query_groups.items()}
    small = "int16" if sizes["most"] < 2**30 else "int64"

    def dealt(queries: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, salts = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                matrix = _matrix(batch.column(1), width)
                if not len(ids):
                    continue
                all_ = space.distances(matrix, queries)
                nearest = all_.argmin(axis=1)
                for cell, blocks in query_blocks.items():
                    own = np.flatnonzero(nearest == cell if queries else all_[:, cell] <= within[cell])
                    packed = [matrix[i].astype(small).tobytes() for i in own]
                    copies = range(data_blocks) if queries else range(blocks)
                    for copy in copies:
                        mine = salts[own] % (blocks if queries else data_blocks)
                        other = np.full(len(own), copy)
                        q, d = (mine, other) if queries else (other, mine)
                        yield pa.RecordBatch.from_pydict({
                            "cell": pa.array(np.full(len(own), cell), pa.int32()),
                            "q": pa.array(q, pa.int64()), "d": pa.array(d, pa.int64()),
                            "id": pa.array(ids[own], pa.int64()), "v": pa.array(packed, pa.binary()),
                        })

        return deal

    salted = ("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)).alias("salt"))
    there = "cell int, q long, d long, id long, v binary"
    data = rows.select(*salted).mapInArrow(dealt(False), there)
    queries = asked.select(*salted).mapInArrow(dealt(True), there)

    def solve(asking: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if asking.empty or known.empty:
            return none
        known = known.drop_duplicates(["id", "v"]).sort_values("id")
        asking = asking.drop_duplicates(["id", "v"])
        exact = np.float64 if sizes["most"] < 2**52 else np.int64
        ids = known["id"].to_numpy()
        right = np.frombuffer(b"".join(known["v"]), dtype=small).reshape(-1, width).astype(exact)
        out = []
        for at in range(0, len(asking), 256):
            part = asking.iloc[at:at + 256]
            left = np.frombuffer(b"".join(part["v"]), dtype=small).reshape(-1, width).astype(exact)
            score = (left @ right.T).astype(np.int64)
            asks = part["id"].to_numpy()
            row, column = _answers(score, asks, ids, k)
            out.append(pd.DataFrame({"query_id": asks[row], "vec_id": ids[column], "score": score[row, column]}))
        return pd.concat(out)

    found = queries.groupBy("cell", "q", "d").cogroup(data.groupBy("cell", "q", "d")).applyInPandas(
        solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
