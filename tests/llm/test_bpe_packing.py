from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_librarys(text):
    v = bpe.vocabulary(RANKS, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    (ids,) = v.encode([text])
    assert ids.tolist() == own.encode_ordinary(text)
    assert v.decode(ids).tobytes().decode() == text


def test_long_pieces_and_every_space(vocab, library):
    spaces = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
    texts = ["a" * 5000, "ab" * 3000, " " * 2000 + "x", "é" * 900, *(f"a{c}b{c}{c}1" for c in spaces)]
    for text, ids in zip(texts, vocab.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_encode_and_decode_tables(docs, clashing, nothing, library):
    want = sorted(((r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=repr)
    for df in (docs, clashing):
        out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
        assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out.collect()), key=repr) == want
    assert bpe.decode(bpe.encode(nothing, RANKS, P.PATTERN), RANKS, P.PATTERN).collect() == []


def test_unknown_ids_raise(vocab):
    with pytest.raises(ValueError):
        vocab.decode(np.array([10**6]))


def test_packing_encoder_is_the_tokenizers_one(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    texts = [r.text or "" for r in docs.collect()] + ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y ", "<|endoftext"]
    assert packing.encoder(JSON)(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def histograms():
    r = random.Random(1)
    yield {n: r.randint(0, 30) for n in range(1, 1025)}
    yield {n: 50 for n in range(520, 900)}
    yield {3: 100_000, 500: 10, 1024: 7}
    yield {512: 5, 1: 1}
    yield {}


@pytest.mark.parametrize("h", list(histograms()))
def test_plans_hold_every_piece_once(h):
    used: dict[int, int] = {}
    for lengths, count in packing.plan(h, 1024):
        assert sum(lengths) <= 1024 and count > 0
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == {n: c for n, c in h.items() if c}


def test_exact_complements_leave_no_gap():
    plan = packing.plan({1000: 4, 24: 1, 12: 2, 8: 6}, 1024)
    assert sum(c for _, c in plan) == 4 and sum(sum(p) == 1024 for p, c in plan for _ in range(c)) == 4


def test_triples_are_found_by_their_sum():
    stock = packing.Complements({700: 1, 100: 2, 124: 1, 50: 3, 200: 1}, 1024)
    assert list(stock._triples(324)) == [(124, 100, 100)] and list(stock._triples(350)) == [(200, 100, 50)]
    assert packing.plan({700: 1, 124: 1, 100: 2}, 1024) == [((700, 124, 100, 100), 1)]


def check(df, out, capacity):
    from collections import defaultdict

    ids_of = sorted(([*packing.encoder(JSON)([r.text or ""])[0], 2] for r in df.collect()), key=repr)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out.collect():
        assert r.length == len(r.ids) <= capacity and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    joined = []
    for own in pieces.values():
        own.sort(key=lambda r: (r.piece, r.start))
        copies = sum(r.piece == 0 for r in own)
        if copies == 1:
            joined.append([i for r in own for i in r.ids])
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
            assert all(r.length == capacity for r in own[1:])
        else:
            joined += [list(r.ids) for r in own] if all(r.piece == 0 for r in own) else []
    return ids_of, sorted(joined, key=repr)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packed_sequences(docs, clashing, nothing, capacity):
    once = docs.where("doc_id is not null and doc_id <> 7")
    want, got = check(once, packing.pack(once, JSON, capacity), capacity)
    assert got == want
    everything = packing.pack(clashing, JSON, capacity)
    assert everything.count() == packing.pack(docs, JSON, capacity).count()
    check(docs, everything, capacity)
    assert packing.pack(nothing, JSON, capacity).collect() == []
