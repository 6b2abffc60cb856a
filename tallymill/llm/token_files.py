"""Token ids of documents in files: Simple-8b blocks in the order of document ids.

A file is a Parquet file whose rows are blocks of whole documents: the packed words, where each
coding block starts, the escapes, and the ids and lengths of the documents. Spark's committer
writes them, so a lost executor leaves no half-written file behind, and any store that Spark
reaches will do. Every row decodes by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm import simple8b
from tallymill.llm.shared import small_batches
from tallymill.llm.vocab import WordEncoder, once, sent

BLOCKS = ("shard int, before long, n_ids long, doc_ids array<long>, lengths array<long>, "
          "words binary, firsts binary, escape_places binary, escape_values binary")
#: A row is closed once it holds this many ids; a longer document has a row of its own.
ROW_IDS = 262_144


def token_blocks(df: DataFrame, library_path: str, end_id: int = 1, doc: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Blocks of the documents' ids, each document ended by `end_id`, ascending by document id.

    Null ids come first; rows of one id are ordered by their text's hash and their place in the
    table. A null text counts as empty and has the end id alone. An empty table gives no blocks.
    """
    small_batches(df.sparkSession)
    library = sent(df.sparkSession, library_path)

    def pack(rows: list[tuple[int | None, np.ndarray]], before: int, shard: int) -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in rows])
        words, firsts, places, values = simple8b.encode(ids)
        one = {
            "shard": [shard], "before": [before], "n_ids": [len(ids)],
            "doc_ids": [[doc_id for doc_id, _ in rows]], "lengths": [[len(x) for _, x in rows]],
            "words": [words.astype("<u8").tobytes()], "firsts": [firsts.astype("<u4").tobytes()],
            "escape_places": [places.astype("<u8").tobytes()],
            "escape_values": [values.astype("<u8").tobytes()],
        }
        types = {"shard": pa.int32(), "before": pa.int64(), "n_ids": pa.int64(),
                 "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}
        return pa.RecordBatch.from_pydict(
            {k: pa.array(v, types.get(k, pa.binary())) for k, v in one.items()})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("words", library_path), lambda: WordEncoder(library.value))
        shard, before, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoder.ids(whole.as_py() or ""), end_id], dtype=np.uint32)
                rows.append((doc_id, ids))
                held += len(ids)
                if held >= ROW_IDS:
                    yield pack(rows, before, shard)
                    before, rows, held = before + held, [], 0
        if rows:
            yield pack(rows, before, shard)

    keyed = df.select(F.col(doc).cast("long").alias("d"), F.col(text).cast("string").alias("t")).select(
        "d", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange("d", "h", "row").sortWithinPartitions("d", "h", "row")
    return ordered.select("d", "t").mapInArrow(blocks, BLOCKS)


def write_tokens(df: DataFrame, folder: str, library_path: str, end_id: int = 1, doc: str = "doc_id",
                 text: str = "text") -> None:
    """Write the documents' token files to a folder that the executors share."""
    token_blocks(df, library_path, end_id, doc, text).write.parquet(folder)


def read_tokens(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document, from blocks as read back: doc_id, start (ids of all documents before
    it), n_tokens (with the end id), ids_crc32, and the ids themselves on demand."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(
                    np.frombuffer(row["words"], "<u8"), np.frombuffer(row["firsts"], "<u4"),
                    np.frombuffer(row["escape_places"], "<u8").astype(np.int64),
                    np.frombuffer(row["escape_values"], "<u8"), row["n_ids"])
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                plain = ids.astype("<u4")
                own = [plain[e - n:e] for e, n in zip(ends, lengths)]
                out = {
                    "shard": pa.array([row["shard"]] * len(lengths), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["before"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"
    read = blocks.mapInArrow(documents, schema + ", ids array<long>" * with_ids)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per file: the running sum over them is as small as the list of files.
    shards = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return read.join(shards, "shard").withColumn("start", F.col("start") + F.col("base")).drop("shard", "base")
