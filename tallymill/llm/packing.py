"""Best-fit packing of tokenised documents into sequences of one length.

The plan is made on the histogram of piece lengths, at most one count per length up to the
capacity, so its size does not depend on the data. Pieces above a third of the capacity are
matched greedily, largest first, at most two in a sequence; smaller ones then go, largest first,
to the smallest gap that takes them. Each piece finds its place from its rank among the pieces of
its length: ranks come from counts per task, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.shared import small_batches, written
from tallymill.llm.vocab import ByteEncoder, once, sent, sent_ranks

PIECES = "doc_id long, part int, pos long, piece int, start long, length long, ids_crc32 long"


class Segment(NamedTuple):
    """Pieces of one length with ranks from `first` up to `last`: `copies` go to each sequence
    from number `base` on, the first of them at `offset`."""

    length: int
    first: int
    last: int
    base: int
    copies: int
    offset: int


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than capacity."""
    head = length - capacity * ((length - 1) // capacity) if length else 0
    starts = [0, *range(head, length, capacity)] if length else []
    return [(s, (starts + [length])[i + 1] - s) for i, s in enumerate(starts)]


def plan(counts: dict[int, int], capacity: int) -> list[Segment]:
    """Place all pieces, given how many there are of each length.

    Sequences of like content are handled as one group (base, sequences, gap), so the work depends
    on the number of lengths and not on the number of pieces.
    """
    left = {size: n for size, n in counts.items() if n > 0 and 0 < size <= capacity}
    dealt = dict.fromkeys(left, 0)
    segments: list[Segment] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, base, sequences), sorted
    made = 0

    def deal(size: int, sequences: int, copies: int, base: int, offset: int, most: int | None = None) -> None:
        n = sequences * copies if most is None else most
        segments.append(Segment(size, dealt[size], dealt[size] + n, base, copies, offset))
        dealt[size] += n
        left[size] -= n

    large = sorted(size for size in left if 3 * size > capacity)
    for size in reversed(large):
        while left[size]:
            at = bisect_left(large, min(capacity - size, size) + 1) - 1
            while at >= 0 and (left[large[at]] == 0 or large[at] == size and left[size] < 2):
                at -= 1
            other = large[at] if at >= 0 else None
            if other is None:
                sequences = left[size]
                deal(size, sequences, 1, made, 0)
                gap = capacity - size
            elif other == size:
                sequences = left[size] // 2
                deal(size, sequences, 2, made, 0)
                gap = capacity - 2 * size
            else:
                sequences = min(left[size], left[other])
                deal(size, sequences, 1, made, 0)
                deal(other, sequences, 1, made, size)
                gap = capacity - size - other
            insort(gaps, (gap, made, sequences))
            made += sequences
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(gaps, (size,))
            if at == len(gaps):  # a new sequence, or as many as can be filled alike
                sequences = max(1, left[size] // (capacity // size))
                insort(gaps, (capacity, made, sequences))
                made += sequences
                continue
            gap, base, sequences = gaps.pop(at)
            copies = min(gap // size, left[size])
            used = min(sequences, left[size] // copies)
            deal(size, used, copies, base, capacity - gap)
            insort(gaps, (gap - copies * size, base, used))
            if used < sequences:
                insort(gaps, (gap, base + used, sequences - used))
    return segments


def token_pieces(df: DataFrame, library_path: str, ranks_path: str, capacity: int = 1024,
                 end_id: int = 2, doc: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its ids by the vocabulary, then the end id, cut up.

    Documents longer than `capacity` are cut into pieces of that length, of which the first may be
    shorter. A null text is an empty one, which has the end id alone. Repeated rows and null ids
    are documents like any other; an empty table gives no rows; other columns play no part.
    `part` and `pos` name a row: the task that made it and its place there. With `with_ids` the
    ids themselves are a column.
    """
    spark = df.sparkSession
    small_batches(spark)
    library, ranks = sent(spark, library_path), sent_ranks(spark, ranks_path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("bytes", library_path), lambda: ByteEncoder(library.value, ranks.value))
        part, pos = TaskContext.get().partitionId(), 0
        names = ["doc_id", "part", "pos", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in names + ["ids"] * with_ids}
            for doc_id, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = array("I", encoder.ids(whole.as_py() or ""))
                ids.append(end_id)
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[start:start + length]
                    row = (doc_id, part, pos, piece, start, length, zlib.crc32(own.tobytes()))
                    for name, value in zip(names, row):
                        columns[name].append(value)
                    if with_ids:
                        columns["ids"].append(own.tolist())
                    pos += 1
            types = {"part": pa.int32(), "piece": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, types.get(k, pa.int64())) for k, v in columns.items()})

    schema = PIECES + ", ids array<int>" * with_ids
    return df.select(F.col(doc).cast("long"), F.col(text).cast("string")).mapInArrow(pieces, schema)


def best_fit(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces (part, pos, length, ...); gapless in each sequence.

    `pieces` must be stable (a written table): it is read for the counts and again for the places.
    Lengths must be from 1 to `capacity`; every row gets one place, an empty table gives none.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = spark.createDataFrame(
        plan(histogram, capacity) or [Segment(0, 0, 0, 0, 1, 0)],
        "size long, first long, last long, base long, copies long, at long")
    before = (counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
              .select("part", "length", "before"))
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("pos")) - 1 + F.col("before")
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", rank)
    own = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(segments), (F.col("length") == F.col("size"))
                    & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .withColumn("sequence_id", F.col("base") + F.floor(own / F.col("copies")).cast("long"))
        .withColumn("offset", F.col("at") + own % F.col("copies") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(df: DataFrame, library_path: str, ranks_path: str, capacity: int = 1024,
                   end_id: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents; see `token_pieces` and `best_fit` for edge cases."""
    pieces = written(token_pieces(df, library_path, ranks_path, capacity, end_id, doc, text), "pieces")
    return best_fit(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole token sequences from packed pieces with their ids: at most `capacity` ids a group."""
    inner = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(inner, lambda p: p["ids"])).alias("ids"))
