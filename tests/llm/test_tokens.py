"""Tokenizer memo, packing and token files."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import documents, odd_documents, table
from vecloom import session
from vecloom.llm import packing, rans, token_files, tokens
from vecloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.fixture(scope="module", params=[WORD, BYTE], ids=["word", "byte"])
def memo(request):
    return tokens.Encoder(request.param)


PIECES = ["a", "B", "é", "É", "İ", "ς", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x0b", "\x1c", " "]
PIECES += ["́", "'s", "'LL", "don't", ".", ",", "...", "3.14", "_", "(", "<|endoftext|>", "😀", "\0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_memo_equals_library(memo, text):
    want = memo.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in memo.batch([text, text])] == [want, want]


SPELLINGS = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*SPELLINGS, "a", "B", "é", " ", "\n", "."]), max_size=8).map("".join))
def test_spellings_of_special_tokens(memo, text):
    want = memo.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in memo.batch([text, text])] == [want, want]


def test_full_memo_still_right(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 20)
    encode = tokens.Encoder(BYTE)
    texts = [" ".join(f"word{i * j}." for i in range(30)) + " " + "z" * 200 for j in range(5)]
    for _ in range(2):
        for text, ids in zip(texts, encode.batch(texts), strict=True):
            assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encode.memo) <= 20


def all_ids(texts, path, end=2):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, ids_of, size):
    """Every id in one piece, pieces side by side in their sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc_id, own in by_doc.items():
        at, ids = 0, ids_of[doc_id]
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert set(by_sequence) == set(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_packing_query(spark):
    rows = QUERIES["op6_packing"](spark, SF_DIR).collect()
    docs = sorted(table(spark, SF_DIR, "documents").collect())
    ids = dict(zip((d["doc_id"] for d in docs), all_ids([d["text"] for d in docs], WORD), strict=True))
    n = check_packing(rows, ids, 4096)
    total = sum(map(len, ids.values()))
    assert n <= -(-total // 4096) + 1


@pytest.mark.parametrize("seed", range(4))
def test_shortest_pack_first_fills_packs(seed):
    size = 64
    histogram = np.zeros(size + 1, np.int64)
    random = np.random.default_rng(seed)
    lengths, counts = np.unique(random.integers(1, size + 1, 500) // (1 + seed) + 1, return_counts=True)
    histogram[np.minimum(lengths, size)] += counts
    patterns = packing.shortest_pack_first(histogram, size)
    used = np.zeros_like(histogram)
    for pattern, n in patterns:
        assert sum(pattern) <= size and n > 0
        np.add.at(used, list(pattern), n)
    assert (used == histogram).all()
    packs = sum(n for _, n in patterns)
    needed = -(-int((histogram * np.arange(size + 1)).sum()) // size)
    assert packs <= 1.25 * needed + 1


def test_sequences_hold_their_ids(spark):
    texts = [f"some words {i} " * (1 + i % 7) for i in range(40)]
    packed = packing.pack(documents(spark, texts), WORD, size=64, with_ids=True)
    ids = dict(enumerate(all_ids(texts, WORD)))
    n = check_packing(packed.collect(), ids, 64)
    rows = packing.sequences(packed, 64).collect()
    assert len(rows) == n
    for r in rows:
        full = r["n_tokens"] & (r["n_tokens"] - 1) == 0
        assert len(r["ids"]) == len(r["documents"]) == (r["n_tokens"] if full else 64)
        assert sum(d > 0 for d in r["documents"]) == r["n_tokens"]
    flat = sorted(i for r in rows for i in r["ids"][: r["n_tokens"]])
    assert flat == sorted(i for x in ids.values() for i in x)


def test_packing_odd_tables(spark):
    rows = packing.pack(odd_documents(spark), WORD).collect()
    docs = odd_documents(spark).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, all_ids([d["text"] for d in docs], WORD)))
    assert packing.pack(documents(spark, []), WORD).count() == 0
    # A length that most pieces share is ranked over many buckets.
    same = documents(spark, ["equal"] * 300)
    assert len({(r["sequence_id"], r["offset"]) for r in packing.pack(same, WORD).collect()}) == 300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**22), min_size=1, max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_rans_round_trip(ids, a, b):
    ids = np.array(ids, np.uint32)
    doc = rans.Documents(np.array([5]), np.array([False]), np.array([len(ids)], np.uint32))
    segment = rans.Segment(rans.encode(ids, doc))
    assert (segment.tokens() == ids).all()
    assert segment.tokens(a, b).tolist() == ids[a:b].tolist()


def test_rans_blocks_decode_alone_and_damage_shows():
    ids = (np.random.default_rng(0).zipf(1.3, 150_000) % 50_000).astype(np.uint32)
    doc = rans.Documents(np.array([5]), np.array([False]), np.array([len(ids)], np.uint32))
    data = rans.encode(ids, doc)
    segment = rans.Segment(data)
    assert (segment.tokens(70_000, 70_010) == ids[70_000:70_010]).all()
    counts = np.bincount(ids)
    entropy = -sum(c * np.log2(c / len(ids)) for c in counts if c) / 8
    assert len(data) < 1.1 * entropy + 200_000
    for at in (3, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(rans.CorruptSegment):
            rans.Segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(rans.CorruptSegment):
        rans.Segment(data[:10])


def test_token_file_query(spark):
    rows = sorted(QUERIES["op10_token_files"](spark, SF_DIR).collect())
    docs = sorted(table(spark, SF_DIR, "documents").collect())
    start, want = 0, []
    for doc, ids in zip(docs, all_ids([d["text"] for d in docs], BYTE), strict=True):
        want.append((doc["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in rows] == want


def test_token_files_of_small_parts_and_odd_tables(spark):
    docs = odd_documents(spark)
    path = session.scratch_path(spark, "tokens")
    token_files.write_token_files(docs, path, BYTE, part_bytes=20_000, segment_tokens=5)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and ids.count(None) == 2
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(crc(x) for x in all_ids([d["text"] for d in docs.collect()], BYTE))
    assert sorted(r["ids_crc32"] for r in rows) == want
    path = session.scratch_path(spark, "tokens")
    token_files.write_token_files(documents(spark, []), path, BYTE)
    assert token_files.read_token_files(spark, path).count() == 0
