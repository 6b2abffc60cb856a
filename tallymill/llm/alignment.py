"""Which tokens of two vocabularies cover the same bytes of a text.

Both token rows of a text lie over the same bytes. `merge_asof`, keyed by document, gives each
token start the other side's token that covers it; the union of both directions holds every
overlapping pair once. Bytes where tokens of both sides end cut a text into groups.

How often an id pair is linked is counted over the corpus without moving texts: tasks write, for
each chunk of documents, one dictionary of its id pairs and their counts. Dictionaries are summed
by pair, and the sums go back to the chunk that asked, where its documents lie.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import public_tokenizers
from tallymill.llm.shared import small_batches, written
from tallymill.llm.vocab import byte_signs, is_plain, once

#: A pair of ids (a, b) is a * PAIR + b.
PAIR = 1 << 32
#: Documents and links of a chunk, about: what one task holds at a time.
CHUNK_ROWS, CHUNK_LINKS = 2_000, 2_000_000
#: Bytes that are aligned in one merge.
MERGE_BYTES = 1 << 20

_REPORT = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
           "groups_sha256": pa.string()}


class Side:
    """Bytes of each id of one vocabulary, and the ids as text: first before a comma, then before `end`."""

    def __init__(self, tokens: list[bytes], end: str):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.shown = np.array([f"{i}{s}" for s in (",", end) for i in range(len(tokens))], dtype=object)

    def gives(self, ids: list[int], spaced: bytes) -> bool:
        """Whether the tokens' bytes, joined, are these."""
        return b"".join(map(self.tokens.__getitem__, ids)) == spaced


class ByteSide(Side):
    """Space and text by a byte-level vocabulary; special strings are ordinary text."""

    def __init__(self, library_json: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(library_json)
        self.library.encode_special_tokens = True
        own, signs = json.loads(library_json), byte_signs()
        ids = own["model"]["vocab"] | {t["content"]: t["id"] for t in own["added_tokens"]}
        special = {t["content"] for t in own["added_tokens"]}
        tokens = [b""] * (max(ids.values()) + 1)
        for token, id_ in ids.items():
            tokens[id_] = token.encode() if token in special else bytes(signs[c] for c in token)
        super().__init__(tokens, "|")
        ranks = {tokens[id_]: id_ for token, id_ in ids.items() if token not in special}
        self.codec = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """For plain texts the rank codec, which agrees with the library there; else the library."""
        spaced = " " + text
        if is_plain(text):
            return self.codec.encode_ordinary(spaced)
        return self.library.encode(spaced, add_special_tokens=False).ids


class PieceSide(Side):
    """A text by a vocabulary of pieces with byte fallback, which adds the space itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        super().__init__([bytes([int(p[3:-1], 16)]) if self.library.is_byte(i)
                          else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], ";")

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


def overlaps(sizes_a: np.ndarray, sizes_b: np.ndarray, doc_a: np.ndarray,
             doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of all overlapping tokens of texts that lie one after another, in order.

    `doc_a` and `doc_b` name each token's text, ascending; both sides of a text have equal bytes
    and no token is empty.
    """
    def side(sizes: np.ndarray, doc: np.ndarray, name: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": doc, "start": sizes.cumsum() - sizes, name: np.arange(len(sizes))})

    a, b = side(sizes_a, doc_a, "a"), side(sizes_b, doc_b, "b")
    over_a = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy()
    # A pair that starts at one byte would be found from both directions.
    found = np.zeros(len(b), dtype=bool)
    found[over_a[b["start"].to_numpy()[over_a] == a["start"].to_numpy()]] = True
    over_b = pd.merge_asof(b[~found], a, on="start", by="doc")
    left = np.concatenate([a["a"].to_numpy(), over_b["a"].to_numpy()])
    right = np.concatenate([over_a, over_b["b"].to_numpy()])
    order = np.lexsort((right, left))
    return left[order], right[order]


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token, from 0, of texts that lie one after another; ends ascend."""
    other = np.searchsorted(ends_b, ends_a)
    last_a, last_b = ends_b[other] == ends_a, np.zeros(len(ends_b), dtype=bool)
    last_b[other[last_a]] = True
    return last_a.cumsum() - last_a, last_b.cumsum() - last_b


def group_signs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, left: Side, right: Side) -> np.ndarray:
    """The ids as text in the order of `a1,a2|b1;a3|b2,b3;`: by group, a side before b side."""
    out = np.empty(len(a) + len(b), dtype=object)
    # Before a token of a stand all of a before it and all of b of earlier groups.
    at_a = np.arange(len(a)) + np.searchsorted(of_b, of_a, side="left")
    at_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")
    out[at_a] = left.shown[a + np.append(of_a[1:] != of_a[:-1], True) * len(left.tokens)]
    out[at_b] = right.shown[b + np.append(of_b[1:] != of_b[:-1], True) * len(right.tokens)]
    return out


def _loaded(sent: Broadcast, *paths: str) -> tuple[ByteSide, PieceSide]:
    def make():
        byte_json, model = sent.value
        return ByteSide(byte_json), PieceSide(model)

    return once(("sides", *paths), make)


def _aligned(texts: list[str | None], left: Side, right: Side) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """For each text the pairs of ids that it links, their counts, and its row of the report."""
    def merged(held: list[tuple[np.ndarray, np.ndarray] | None]):
        own = [h for h in held if h is not None]
        lengths = np.array([(len(a), len(b)) for a, b in own], dtype=np.int64).reshape(-1, 2)
        at_a, at_b = lengths[:, 0].cumsum(), lengths[:, 1].cumsum()
        all_a, all_b = (np.concatenate([h[i] for h in own] or [np.zeros(0, np.int64)]) for i in (0, 1))
        doc_a, doc_b = (np.repeat(np.arange(len(own)), lengths[:, i]) for i in (0, 1))
        size_a, size_b = left.sizes[all_a], right.sizes[all_b]
        link_a, link_b = overlaps(size_a, size_b, doc_a, doc_b)
        pairs = all_a[link_a] * PAIR + all_b[link_b]
        cuts = np.searchsorted(link_a, at_a)
        of_a, of_b = groups(size_a.cumsum(), size_b.cumsum())
        signs = group_signs(all_a, all_b, of_a, of_b, left, right)
        k = 0
        for h in held:
            if h is None:
                none = np.zeros(0, np.int64)
                yield none, none, {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}
                continue
            a, b = h
            mine = pairs[cuts[k - 1] if k else 0:cuts[k]]
            whole = "".join(signs[at_a[k] + at_b[k] - len(a) - len(b):at_a[k] + at_b[k]])[:-1]
            n = int(of_a[at_a[k] - 1] - of_a[at_a[k] - len(a)]) + 1
            k += 1
            yield *np.unique(mine, return_counts=True), {
                "n_a": len(a), "n_b": len(b), "n_groups": n, "n_links": len(mine),
                "groups_sha256": hashlib.sha256(whole.encode()).hexdigest()}

    held, size = [], 0
    for text in texts:
        found = None
        if text:
            a, b = left.ids(text), right.ids(text)
            spaced = b" " + text.encode()
            # The rank codec cuts bytes and drops none.
            if right.gives(b, spaced) and (is_plain(text) or left.gives(a, spaced)):
                found = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                size += len(spaced)
        held.append(found)
        if size > MERGE_BYTES or len(held) == CHUNK_ROWS:
            yield from merged(held)
            held, size = [], 0
    yield from merged(held)


def aligned_chunks(df: DataFrame, byte_library: str, piece_model: str, doc: str, text: str) -> DataFrame:
    """Rows of documents and of their chunks' dictionaries, written to the shared folder.

    A row of kind `doc` is a document: its report, and the pairs of ids it links with their counts.
    A row of kind `pairs` is a chunk: the pairs of its documents and their counts. A chunk holds at
    most CHUNK_ROWS documents, and ends after CHUNK_LINKS links.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(byte_library, encoding="utf-8") as a, open(piece_model, "rb") as b:
        sent = spark.sparkContext.broadcast((a.read(), b.read()))
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    report = ", ".join(f"{name} {'string' if t == pa.string() else 'long'}" for name, t in _REPORT.items())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _loaded(sent, byte_library, piece_model)
        task, chunk = TaskContext.get().partitionId(), 0
        type_of_id, ids, own, size = None, [], [], 0

        def closed() -> pa.RecordBatch:
            """A chunk's documents, and its dictionary as the last row."""
            pairs, place = np.unique(np.concatenate([p for p, _, _ in own]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([n for _, n, _ in own]), len(pairs)).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum([len(p) for p, _, _ in own]), [len(place), len(place) + len(pairs)]])
            cuts = np.delete(cuts, -2).astype(np.int32)
            lists = [np.concatenate([*(x[i] for x in own), last]) for i, last in ((0, pairs), (1, counts))]
            return pa.RecordBatch.from_pydict({
                "kind": ["doc"] * len(own) + ["pairs"],
                "chunk": pa.array([(task << 32) + chunk] * (len(own) + 1), pa.int64()),
                "doc_id": pa.array([*ids, None], type_of_id),
                **{name: pa.array([*(r[name] for _, _, r in own), None], t) for name, t in _REPORT.items()},
                "pair": pa.ListArray.from_arrays(cuts, pa.array(lists[0], pa.int64())),
                "n": pa.ListArray.from_arrays(cuts, pa.array(lists[1], pa.int64())),
            })

        for batch in batches:
            type_of_id = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for id_, result in zip(part.column(0).to_pylist(), _aligned(part.column(1).to_pylist(), left, right)):
                    ids.append(id_)
                    own.append(result)
                    size += result[2]["n_links"]
                    if len(own) == CHUNK_ROWS or size > CHUNK_LINKS:
                        yield closed()
                        ids, own, size, chunk = [], [], 0, chunk + 1
        if own:
            yield closed()

    made = rows.mapInArrow(found, f"kind string, chunk long, doc_id {kind_of_id}, {report}, pair array<long>, n array<long>")
    return written(made, "aligned", ["kind"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): links that hold each pair of ids, and whether no pair of its b has more."""
    counts = chunks.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair") % PAIR
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_report(df: DataFrame, byte_library: str, piece_model: str, doc: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Sides are space and text by the byte-level library (a), and the text by the piece model (b).
    Null and empty texts, and texts that a side does not give back byte for byte, have no tokens:
    zeros, and an empty string. Ids may be null or repeat, each row counts; an empty table gives no
    rows; other columns play no part. A very long text is aligned whole, in one task.
    """
    made = aligned_chunks(df, byte_library, piece_model, doc, text)
    asked = (made.filter("kind = 'pairs'").select("chunk", F.explode(F.arrays_zip("pair", "n")).alias("x"))
             .select("chunk", "x.pair", "x.n"))
    known = written(pair_counts(asked), "pairs")
    answers = asked.select(F.col("chunk").alias("asks"), "pair").join(known, "pair")
    docs = made.filter("kind = 'doc'").drop("kind")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kinds = {c: f"`{c}` {docs.schema[c].dataType.simpleString()}" if c in docs.columns else f"{c} long" for c in columns}

    def summed(docs: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("pair")
        pairs, counts, best = (found.column(c).to_numpy() for c in ("pair", "count", "best"))
        n_best, total = [], []
        for own, n in zip(docs.column("pair").to_pylist(), docs.column("n").to_pylist()):
            at, n = np.searchsorted(pairs, np.array(own, dtype=np.int64)), np.array(n, dtype=np.int64)
            n_best.append(int(n[best[at]].sum()))
            total.append(int(n @ counts[at]))
        docs = docs.append_column("n_best", pa.array(n_best, pa.int64()))
        return docs.append_column("count_sum", pa.array(total, pa.int64())).select(columns)

    return docs.groupBy("chunk").cogroup(answers.groupBy("asks")).applyInArrow(summed, ", ".join(kinds.values()))
