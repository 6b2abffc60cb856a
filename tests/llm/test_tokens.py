"""Token counts, token files, packing and byte-level BPE against the libraries and brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymill.llm import bpe, packing, simple8b, token_counts, token_files
from tallymill.llm.queries import BYTE_LIBRARY, BYTE_RANKS, QUERIES, WORD_LIBRARY
from tallymill.llm.shared import written
from tallymill.llm.vocab import PLAIN, ByteEncoder, WordEncoder, read_ranks

DATA = "/root/testdata/sf0.001"
words_library = Tokenizer.from_file(WORD_LIBRARY)
bytes_library = Tokenizer.from_file(BYTE_LIBRARY)
ranks = read_ranks(BYTE_RANKS)
codec = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
texts = st.one_of(st.text(alphabet=PLAIN, max_size=80), st.text(max_size=40),
                  st.lists(st.sampled_from(["don't", " ", "the", "'", "ll", "<|endoftext|>", "12", "İ", "é"])).map("".join))


def word_ids(text):
    return words_library.encode(text, add_special_tokens=False).ids


def byte_ids(text):
    return bytes_library.encode(text, add_special_tokens=False).ids


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@settings(max_examples=300, deadline=None)
@given(texts)
def test_encoders_equal_the_libraries(text):
    assert encoders()[0].ids(text) == word_ids(text)
    assert encoders()[1].ids(text) == byte_ids(text)


def encoders(made=[]):  # noqa: B006
    if not made:
        with open(WORD_LIBRARY) as a, open(BYTE_LIBRARY) as b:
            made += [WordEncoder(a.read()), ByteEncoder(b.read(), ranks)]
    return made


def test_whole_tokens_are_proved():
    whole = token_counts.whole_tokens(encoders()[0])
    assert len(whole) > 10_000
    assert all(len(word_ids(w)) == 1 for w in sorted(whole)[::97])


def test_token_counts(spark, awkward, rows):
    got = token_counts.token_counts(awkward, WORD_LIBRARY, limit=20).collect()
    want = [(d, len((t or "").encode()), len(word_ids(t or "")), len(word_ids(t or "")) > 20) for d, t, _ in rows]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert token_counts.token_counts(awkward.limit(0), WORD_LIBRARY).collect() == []


def test_token_counts_query(spark):
    whole = documents(spark)
    got = QUERIES["op3_token_counts"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        d: (len(t.encode()), len(word_ids(t)), len(word_ids(t)) > 2048) for d, t in whole.items()}


ids_lists = st.lists(st.one_of(st.integers(0, 70_000), st.integers(0, 3), st.just(0),
                               st.integers(0, 2**64 - 1)), max_size=3_000)


@settings(max_examples=120, deadline=None)
@given(ids_lists)
def test_simple8b_round_trip(ids):
    own = np.array(ids, dtype=np.uint64)
    words, firsts, places, values = simple8b.encode(own)
    assert len(places) == sum(x >= 2**60 for x in ids)
    assert (simple8b.decode(words, firsts, places, values, len(own)) == own).all()


def test_simple8b_packs_small_ids():
    words, *_ = simple8b.encode(np.zeros(2048, dtype=np.uint64))
    assert len(words) == 2 * 5  # runs of 240 zeros
    words, *_ = simple8b.encode(np.full(1024, 2**15 - 1, dtype=np.uint64))
    assert len(words) == 256


def expected_files(pairs):
    at, out = 0, []
    for d, t in pairs:
        ids = np.array([*word_ids(t or ""), 1], dtype="<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_query(spark):
    got = QUERIES["op9_token_files"](spark, DATA).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_files(sorted(documents(spark).items()))


def test_token_files_take_awkward_rows(spark, awkward_written, rows):
    blocks = written(token_files.token_blocks(awkward_written, WORD_LIBRARY), "t")
    got = token_files.read_tokens(blocks).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d))
    assert got[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    want = Counter((d, tuple([*word_ids(t or ""), 1])) for d, t, _ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    empty = written(token_files.token_blocks(awkward_written.limit(0), WORD_LIBRARY), "t")
    assert token_files.read_tokens(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40)))
def test_plan_places_every_piece(counts):
    capacity, bins, seen = 30, defaultdict(list), Counter()
    for s in packing.plan(counts, capacity):
        seen[s.length] += s.last - s.first
        for rank in range(s.last - s.first):
            bins[s.base + rank // s.copies].append((s.offset + rank % s.copies * s.length, s.length))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in pieces) <= 2
    if bins:
        total = sum(k * v for k, v in counts.items())
        assert len(bins) <= 2 * -(-total // capacity) + 1


def test_cut_points():
    assert packing.cut_points(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut_points(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.cut_points(1, 1024) == [(0, 1)]


def check_packing(got, ids, capacity):
    bins, covered = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()]
        assert sum(n for _, n in pieces) <= capacity
    for d, own in covered.items():
        want = sorted((s, n, zlib.crc32(np.array(x[s:s + n], "<u4").tobytes()))
                      for x in ids[d] for s, n in packing.cut_points(len(x), capacity))
        assert sorted(own) == want
    assert set(covered) == set(ids)
    return len(bins)


def test_packing_query(spark):
    ids = {d: [[*byte_ids(t), 2]] for d, t in documents(spark).items()}
    n = check_packing(QUERIES["op2_best_fit_packing"](spark, DATA).collect(), ids, 1024)
    assert n <= 1.03 * -(-sum(len(x) for y in ids.values() for x in y) // 1024)


def test_packing_takes_awkward_rows(spark, awkward, rows):
    ids = defaultdict(list)
    for d, t, _ in rows:
        ids[d].append([*byte_ids(t or ""), 2])
    got = packing.pack_documents(awkward, BYTE_LIBRARY, BYTE_RANKS, capacity=64)
    check_packing(got.collect(), ids, 64)
    assert packing.pack_documents(awkward.limit(0), BYTE_LIBRARY, BYTE_RANKS).collect() == []


def test_sequences_hold_the_ids(spark, awkward):
    pieces = written(packing.token_pieces(awkward, BYTE_LIBRARY, BYTE_RANKS, 64, with_ids=True), "p")
    packed = written(packing.best_fit(pieces, 64), "q")
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == packed.agg(F.sum("length")).first()[0]
    assert max(len(r.ids) for r in whole) <= 64


def test_byte_bpe_query(spark):
    got = QUERIES["op6_byte_bpe"](spark, DATA).collect()
    for r in got:
        text = documents_once(spark)[r.doc_id]
        ids = codec.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def documents_once(spark, made={}):  # noqa: B006
    return made or made.update(documents(spark)) or made


def test_byte_bpe_takes_awkward_rows(awkward, rows):
    got = bpe.round_trip(awkward, ranks).collect()
    want = Counter((d, len(codec.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest())
                   for d, t, _ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want
    assert bpe.round_trip(awkward.limit(0), ranks).collect() == []


def test_byte_bpe_by_higher_order_functions(spark):
    own = ["", "hello world", "unbelievable aaaaaaa 12345 don't", "Größe  数字 🙂\u00a0x", "tabs\t\tand\n\nlines  "]
    both = bpe.Bpe(ranks)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "i int, t string")
    got = df.select("i", both.encode(F.col("t")).alias("ids")).select(
        "i", "ids", both.decode(F.col("ids")).alias("back")).orderBy("i").collect()
    assert [r.ids for r in got] == [codec.encode_ordinary(t) for t in own]
    assert [bytes(r.back).decode() for r in got] == own


@pytest.mark.parametrize("word", [b"the", b" the", b"zzzzqqq", b"\xff\xfe", b"aaaaaaaaaaaaaaa"])
def test_merges_of_a_word(word):
    assert bpe.merged(word, ranks) == codec._encode_single_piece(word)
