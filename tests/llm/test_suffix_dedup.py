from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import awkward_texts  # noqa: F401
from pyspark.sql import functions as F

from passagework.llm import bwt, suffix_dedup


def brute(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((int(covered.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~covered])).hexdigest()))
    return out


@pytest.mark.parametrize("length", [5, 10, 20])
def test_merged_transforms_find_every_repeat(length):
    r = random.Random(length)
    for _ in range(60):
        strings = [bytes(r.choice(b"ab\0c") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 12))]
        weights = np.array([r.choice([1, 1, 2]) for _ in strings])
        seen = Counter()
        for s, w in zip(strings, weights, strict=True):
            for i in range(len(s) - length + 1):
                seen[s[i : i + length]] += int(w)
        want = [(k, i) for k, s in enumerate(strings) for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1]
        string, offset = bwt.repeated_starts(strings, weights, length, shards=r.randint(1, 4))
        assert list(zip(string.tolist(), offset.tolist(), strict=True)) == want


def test_interleave_orders_all_rotations():
    strings = [b"banana", b"ananas", b"nab"]
    parts = [bwt.Collection([s]) for s in strings]
    orders = [bwt.suffix_order(c) for c in parts]
    assert [[s[i:] for i in o if i < len(s)] for s, o in zip(strings, orders, strict=True)] == [sorted(s[i:] for i in range(len(s))) for s in strings]


def result(df):
    out = suffix_dedup.remove_repeats(df)
    return sorted(((r.doc_id, r.text, r._n_removed, len(r._spans), hashlib.sha256(bytes(r._kept)).hexdigest(), r._n_bytes) for r in out.collect()), key=repr)


@pytest.mark.parametrize("hot", [2048, 1])
def test_awkward_rows_against_brute_force(docs, clashing, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # with 1, anchors are cut anew again and again
    df = docs if hot > 1 else docs.where("doc_id <> 8 and doc_id not in (11, 12)")
    rows = df.collect()
    want = brute([(r.text or "").encode() for r in rows], 200)
    assert result(df) == sorted(((r.doc_id, r.text, *w, len((r.text or "").encode())) for r, w in zip(rows, want, strict=True)), key=repr)
    if hot > 1:
        assert result(clashing) == result(docs)


def test_nothing_and_bad_lengths(nothing):
    assert suffix_dedup.remove_repeats(nothing).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.find_repeats(nothing, 99)


def test_many_copies_of_one_passage(spark):
    """A passage in every document, between texts of their own, and each stretch at its edges different."""
    passage = "common passage " * 20
    df = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(passage), F.sha2((F.col("id") + 500).cast("string"), 512)).alias("text"))
    rows = df.collect()
    want = brute([r.text.encode() for r in rows], 200)
    got = {r.doc_id: (r._n_removed, len(r._spans), hashlib.sha256(bytes(r._kept)).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


@pytest.mark.parametrize(("n", "size", "hot"), [(300, 210, 32), (300, 300, 32), (300, 300, 1), (3000, 300, 2048)])
def test_an_anchor_that_stays_hot(spark, n, size, hot, monkeypatch):
    """Copies of a passage little longer than a window, each between other texts: no cut takes the surroundings away."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(size)
    some = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage = some(size)
    rows = [(k, some(r.randint(220, 300)) + passage + some(r.randint(220, 300))) for k in range(n)] + [(n + k, some(400)) for k in range(20)]
    want = brute([t.encode() for _, t in rows], 200)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {x.doc_id: (x._n_removed, len(x._spans), hashlib.sha256(bytes(x._kept)).hexdigest()) for x in got} == {i: w for (i, _), w in zip(rows, want, strict=True)}


@pytest.mark.parametrize("size", [200, 400])
def test_thousands_of_documents_around_one_passage(spark, size):
    """12,000 documents between words of their own: exactly the passage goes, but for bytes that happen to be the same next to it."""
    r = random.Random(size)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    some = lambda k: " ".join(word() for _ in range(k))
    passage = some(100)[:size]
    rows = [(k, f"{some(20)}<{passage}>{some(20)}") for k in range(12_000)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(got) == len(rows)
    for x in got:
        at = x.text.index(f"<{passage}>")
        ((start, end),) = [(s.start, s.end) for s in x._spans]
        assert start <= at and end >= at + size + 2 and x._n_removed == end - start
    before = Counter(x.text[max(0, x.text.index("<") - 40) : x.text.index("<")][-k:] for x in got for k in range(1, 9))
    for x in got:  # a window that reaches k bytes before the passage is repeated if these k bytes are
        at = x.text.index("<")
        reach = max((k for k in range(1, 9) if before[x.text[max(0, at - 40) : at][-k:]] > 1), default=0)
        assert x._spans[0].start >= at - reach if reach < 8 else True


def test_lone_strings_are_not_merged_and_splitting_ends_after_four_rounds(monkeypatch):
    """A string that only equals itself was taken through a merge; anchors were split in halves, 8 times."""

    def never(*_):
        raise AssertionError("merged")

    monkeypatch.setattr(suffix_dedup, "repeated_starts", never)
    schema = ["anchor", "own", "stretch", "weight"]
    rows = pa.RecordBatch.from_pylist([{"anchor": k, "own": k, "stretch": b"x" * (200 + k), "weight": w} for k, w in enumerate((1, 2, 5, 1))]).select(schema)
    found = [r for b in suffix_dedup._merge_groups(iter([rows]), 200) for r in b.to_pylist()]
    assert found == [{"anchor": 1, "own": 1, "starts": [0], "ends": [201]}, {"anchor": 2, "own": 2, "starts": [0], "ends": [202]}]

    text = bytes(random.Random(5).randrange(97, 123) for _ in range(350))
    now = [(0, 0, 1, 150, 0, 150, text)]
    for _ in range(4):
        names = ["anchor", "own", "weight", "rel", "near", "far", "stretch"]
        batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in now]).select(names)
        now = [tuple(r[c] for c in names) for b in suffix_dedup._parted(iter([batch]), 200) for r in b.to_pylist()]
    assert sorted(r[-1] for r in now) == sorted(text[i : i + 200] for i in range(151))
