"""The registered queries themselves, over whole small tables."""

from __future__ import annotations

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tiktoken.load
from test_models_and_duplicates import Union, fingerprint, kneser_ney_brute, likeness
from tokenizers import Tokenizer

from passagework.llm import kneser_ney, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name: str) -> list:
    return queries.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted((tuple(r[c] for c in columns) for r in run(spark, name)), key=repr) == sorted(want.fetchall(), key=repr)


def test_op2(spark, texts):
    got = run(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(r.score)
    assert all(max(x) - min(x) < 1e-4 for x in by_text.values())


def test_op4(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, "op4_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids, at = np.array([*t.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4"), 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024) and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += len(ids)
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 1024
    assert len(sequences) <= -(-total // 1024) + 5


def test_op5(spark, texts):
    got = run(spark, "op5_sharding")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    shard_of: dict = {}
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 8
        assert shard_of.setdefault(data, r.shard) == r.shard
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) <= sum(sizes.values()) / 8 + max(len(x.encode()) + 1 for x in texts.values()) * max(Counter(texts.values()).values())


def test_op6(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in run(spark, "op6_minhash")}
    assert sorted(got) == sorted(texts)
    prints, off = {}, []
    for k, doc in enumerate(order):
        own, after = texts[doc], texts[order[(k + 1) % len(order)]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        r = got[doc]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint
        off += [abs(r.near_edited - likeness(own, edited)), abs(r.near_next - likeness(own, after))]
    assert np.mean(off) < 0.03 and np.quantile(off, 0.99) < 0.2


def test_op7(spark, texts):
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality is not null").collect():
        labels[r.doc_id].append(r.quality)
    unseen = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where(kneser_ney.left_out(kneser_ney.F.col("doc_id"))).collect()}
    trusted = [texts[d].encode() for d, q in labels.items() if min(q) == 1 and d in texts and d not in unseen]
    perplexity = kneser_ney_brute(trusted, kneser_ney.ORDER)
    got = run(spark, "op7_kneser_ney")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        if len(texts[r.doc_id]) < 3000:
            want = perplexity(texts[r.doc_id].encode())
            assert r.perplexity == want or abs(r.perplexity / want - 1) < 1e-9
        assert r.accepted == (r.perplexity is not None and r.perplexity <= r.threshold)


def test_op8(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op8_simhash")}
    prints = {d: fingerprint(t) for d, t in texts.items()}
    u, docs = Union(), sorted(texts)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                u.join(a, b)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", u.find(d)) for d in docs}


def test_op10(spark, texts):
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op10_byte_bpe")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
