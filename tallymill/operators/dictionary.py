"""Token ids by position in a vocabulary, in place of hashes that may collide."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.numbering import number_sorted
from tallymill.operators.staging import staged

#: Most frequent tokens that are sent to every task; all others meet their ids in a shuffle.
HEAD = 4_096
#: Rows at most that share a dictionary of their tokens.
SLICE = 1_024


def vocabulary(df: DataFrame, tokens: Column, first: int = 0) -> DataFrame:
    """``(token, uses, id)`` of all distinct tokens, ids in sorted order from ``first`` on.

    Ids below ``first`` stay free for special tokens. Uses are counted before
    their shuffle, so a token with a third of all uses costs a row for each task.
    """
    uses = df.select(F.explode(tokens).alias("token")).where("token IS NOT NULL").groupBy("token").agg(
        F.count(F.lit(1)).alias("uses"))
    return number_sorted(uses, ["token"], into="id", first=first)


def _by_slices(rows: DataFrame, names: list[str]) -> DataFrame:
    """Slices of rows, written once: ``(__slice, __key, names)`` with tokens as places in the
    slice's dictionary, which is a row of its own, ``(__slice, __tokens)``."""
    kind, size = rows.schema["__key"].dataType.simpleString(), SLICE

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = [part.column(name) for name in names]
                # Null lists hold nothing, so the lists' tokens follow one another.
                flat = pa.chunked_array([x.flatten().cast(pa.string()) for x in lists], pa.string()).combine_chunks()
                coded = flat.dictionary_encode("encode")
                codes, begin, out = coded.indices, 0, []
                for x in lists:
                    lengths = [0 if n is None else n for n in x.value_lengths().to_pylist()]
                    offsets = [0]
                    for n in lengths:
                        offsets.append(offsets[-1] + n)
                    own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), codes.slice(begin, offsets[-1]))
                    none = pa.array([not v for v in x.is_valid().to_pylist()], pa.bool_())
                    out.append(pa.ListArray.from_arrays(own.offsets, own.values, mask=none))
                    begin += offsets[-1]
                n, text = part.num_rows, pa.list_(pa.string())
                fields = ["__slice", "__key", *names, "__tokens"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), part.column("__key"), *out, pa.nulls(n, text)], fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.nulls(1, part.column("__key").type),
                     *(pa.nulls(1, x.type) for x in out),
                     pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)], fields)
                number += 1

    lists = ", ".join(f"`{name}` array<int>" for name in names)
    return staged(rows.mapInArrow(sliced, f"__slice long, __key {kind}, {lists}, __tokens array<string>"), "slices")


def encode(df: DataFrame, key: str, arrays: Mapping[str, Column], vocabulary: DataFrame,
           unknown: int | None = None) -> DataFrame:
    """``key`` and, for each name in ``arrays``, the ids of its tokens in order.

    ``key`` must be unlike in all rows and not null. Slices of rows keep a dictionary of their
    tokens; only its tokens travel, once a slice, to meet their ids, those of the most frequent
    tokens being sent out. A token that is not in ``vocabulary`` counts as ``unknown``, or raises
    an error if that is None; a null array stays null.
    """
    names = list(arrays)
    held = _by_slices(df.select(F.col(key).alias("__key"), *(
        tokens.alias(name) for name, tokens in arrays.items())), names)
    uses = held.where("__tokens IS NOT NULL").select("__slice", F.posexplode("__tokens").alias("pos", "token"))
    head = F.broadcast(vocabulary.orderBy(F.desc("uses"), "token").limit(HEAD).select("token", "id"))
    met = uses.join(head, "token", "left")
    tail = met.where("id IS NULL").drop("id").join(vocabulary.select("token", "id"), "token", "left")
    if unknown is None:
        other = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce("token", F.lit("null")))).cast("long")
    else:
        other = F.lit(unknown).cast("long")
    columns = ("__slice", "pos", "id")
    placed = met.where("id IS NOT NULL").select(*columns).unionByName(
        tail.withColumn("id", F.coalesce("id", other)).select(*columns))
    known = placed.groupBy("__slice").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("int").alias("id"))))["id"].alias("__ids"))
    rows = held.where("__tokens IS NULL").drop("__tokens").join(known, "__slice", "left")
    return rows.select(F.col("__key").alias(key), *(
        F.transform(name, lambda at: F.get("__ids", at)).alias(name) for name in names))
