"""Cross-tokenizer alignment against brute force over token bytes."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallymill.llm import alignment
from tallymill.llm.queries import BYTE_LIBRARY, PIECE_MODEL, QUERIES
from tallymill.llm.shared import table


def signs() -> dict[str, int]:
    """Signs of a byte-level vocabulary, read from what the library makes of single bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for byte in range(256):
        if byte in shown:
            out[chr(byte)] = byte
        else:
            out[chr(extra)] = byte
            extra += 1
    return out


class Plain:
    """Both libraries, asked for each text, with byte spans compared pair by pair."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_LIBRARY)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
        self.signs = signs()

    def spans(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False)
        byte_a = [bytes(self.signs[c] for c in t) for t in a.tokens]
        ids_b = self.b.encode(text)
        byte_b = []
        for i in ids_b:
            piece = self.b.id_to_piece(i)
            byte_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if not text or b"".join(byte_a) != b"".join(byte_b) or b"".join(byte_a) != (" " + text).encode():
            return [], []
        out = []
        for ids, parts in ((a.ids, byte_a), (ids_b, byte_b)):
            at, rows = 0, []
            for id_, part in zip(ids, parts):
                rows.append((id_, at, at + len(part)))
                at += len(part)
            out.append(rows)
        return out

    def report(self, rows):
        held, count = [], Counter()
        for doc, text in rows:
            a, b = self.spans(text or "")
            links, start = [], 0
            for x, x0, x1 in a:
                while start < len(b) and b[start][2] <= x0:
                    start += 1
                at = start
                while at < len(b) and b[at][1] < x1:
                    links.append((x, b[at][0]))
                    at += 1
            count.update(links)
            ends = sorted({r[2] for r in a} & {r[2] for r in b})
            low, parts = 0, []
            for end in ends:
                parts.append(",".join(str(i) for i, s, e in a if low <= s and e <= end) + "|"
                             + ",".join(str(i) for i, s, e in b if low <= s and e <= end))
                low = end
            sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
            held.append((doc, len(a), len(b), len(ends), links, sha))
        most = Counter()
        for (_, b), n in count.items():
            most[b] = max(most[b], n)
        return [(doc, n_a, n_b, n_g, len(links), sum(count[x] == most[x[1]] for x in links),
                 sum(count[x] for x in links), sha) for doc, n_a, n_b, n_g, links, sha in held]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, *map(str, r)))


def test_awkward_texts(spark, plain, awkward, rows):
    more = [(20, " leading and  double  spaces "), (21, "a▁b"), (22, "é́ é \U0001f469‍\U0001f4bb"),
            (23, "<|endoftext|><s> <0x0A> </s>"), (24, "x" * 300 + "\t\r\n\n\n   \n"), (25, "日本語の文章 и кириллица"), (26, " "),
            (27, "\x00null\x01"), (28, "ﬁne ½ Ⅷ ™"), (29, "﻿bom ­ soft"), (2**60 + 1, "big id")]
    extra = spark.createDataFrame([(*r, "s", "x", 5, 7, "y") for r in more], awkward.schema)
    own = [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 1000] + more
    got = alignment.alignment_report(awkward.filter("text is null or length(text) < 1000").union(extra),
                                     BYTE_LIBRARY, PIECE_MODEL).collect()
    assert ordered(got) == ordered(plain.report(own))


def test_chunks_do_not_change_results(spark, plain, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    want = ordered(plain.report([tuple(r) for r in docs.collect() if len(r.text or "") < 8_000]))
    docs = docs.filter("text is null or length(text) < 8000")
    assert ordered(alignment.alignment_report(docs, BYTE_LIBRARY, PIECE_MODEL).collect()) == want
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 3_000)
    monkeypatch.setattr(alignment, "MERGE_BYTES", 1_500)
    assert ordered(alignment.alignment_report(docs.repartition(5), BYTE_LIBRARY, PIECE_MODEL).collect()) == want


def test_query_has_every_document(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op13_tokenizer_alignment"](spark, folder).collect()
    assert len(got) == table(spark, folder, "documents").count()


def test_empty_table_and_long_texts(spark):
    schema = "doc_id long, text string"
    assert alignment.alignment_report(spark.createDataFrame([], schema), BYTE_LIBRARY, PIECE_MODEL).collect() == []
    long = [(1, "one two " * 100_000), (2, "q" * 200_000)]
    got = {r.doc_id: r for r in alignment.alignment_report(spark.createDataFrame(long, schema), BYTE_LIBRARY,
                                                            PIECE_MODEL).collect()}
    assert got[1].n_links >= got[1].n_a and got[1].n_groups >= 100_000 and got[2].n_a > 0
