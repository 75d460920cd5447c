"""Hard negatives and periodic runs against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from passagework.llm import hard_negatives, periodic, queries


def hard_brute(rows, positives, k, window):
    least, most, of = window
    ok = [(i, lab, tuple(int(np.floor(256 * float(x))) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, lab, v in {r for r in ok if r[0] % 100 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, other) for i, other, w in ok if i != q and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            some = sorted((t, i) for t, i, other in scored if other != lab and least * -s <= of * -t <= most * -s)
            out += [(q, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(some[:k])]
    return sorted(out)


AWKWARD = [(200, 1, [0.5] * 8), (200, 1, [0.25] * 8), (200, 2, [0.25] * 8), (6, 1, None), (400, 2, [float("nan")] * 8), (500, 0, [1.0, 2.0]), (501, 0, [1.0, 1.0]), (502, 1, [0.5, 0.5]), (700, 3, []), (None, 1, [0.1] * 8), (7, 2, [None] * 8), (99, None, [0.5] * 8), (98, 2, [0.5] * 8), (97, 0, [0.25] * 8), (96, 0, [0.25] * 8), (800, 5, [0.3] * 8), (900, 1, [0.0] * 8)]


@pytest.mark.parametrize(("shard", "leaf", "block"), [(8192, 64, 1024), (40, 4, 2)])
def test_hard_negatives(spark, shard, leaf, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    r = random.Random(5)
    rows = [(i, r.randrange(3), [r.choice([r.gauss(0.1, 0.2), 0.25, 0.5]) for _ in range(8)]) for i in range(1, 400, 3)] + [(1000, 1, [0.25] * 8)] * 2 + AWKWARD
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("rank", "score", "v", "n", "key", "id")})
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, 5, 10)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = hard_brute(rows, 5, 10, (30, 90, 100))
    assert got.columns == names and sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_one_walk_prunes_and_keeps_ties():
    """Clustered rows: few leaves are read, and of equal scores the smaller ids stay."""
    r = np.random.default_rng(2)
    rows = np.repeat(r.integers(-200, 200, (64, 16)) * 10, 64, axis=0) + r.integers(-2, 3, (4096, 16))
    rows[:64:7] = rows[0]
    ids, labels = r.permutation(4096), np.repeat(np.arange(4), 1024)
    forest = hard_negatives.Forest(ids, labels, rows)
    read = []
    forest.scores = lambda node, q, f=forest.scores: read.append(forest.ends[node] - forest.begins[node]) or f(node, q)
    low, high = forest.bounds(rows[:1])
    exact = rows @ rows[0]
    near = int(np.sort(exact)[-200])
    windows = [(None, None), (near - 3000, near + 3000)]
    got = hard_negatives.walk(forest, list(forest.roots.values()), rows[0], -1, low[0], high[0], windows, 9)
    for (lo, hi), b in zip(windows, got, strict=True):
        want = sorted((-s, i) for s, i in zip(exact.tolist(), ids.tolist(), strict=True) if (lo is None or s >= lo) and (hi is None or s <= hi))[:9]
        assert [(-s, i) for s, i in zip(b.scores.tolist(), b.ids.tolist(), strict=True)] == want
    assert sum(read) < 2048


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [float(2**20 + i), 1.0, -(2.0**21) + 3 * i]) for i in range(1, 60)] + [(100, 1, [2.0**21, 3.0, -(2.0**20)])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == hard_brute(rows, 5, 10, (30, 90, 100))
    huge = df.withColumn("embedding", F.transform("embedding", lambda x: x * 1024))  # scores past 64 bits
    assert all(r.positive_score == 2**63 - 1 for r in hard_negatives.mine(huge, F.col("vec_id") % 100 == 0).collect())


def runs_brute(words, least=6, min_exp=4):
    """By the definition: every stretch, its smallest period, and whether a neighbour extends it."""
    n, out = len(words), []
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, min_exp * q):
                s, e = i, j + q
                if not any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_stretches_by_definition():
    r = random.Random(1)
    for trial in range(400):
        words = [b"%d" % r.randrange(1 + trial % 3) for _ in range(r.randrange(60))]
        if trial % 2:
            unit = [b"%d" % r.randrange(3) for _ in range(r.randint(1, 6))]
            words = words[:20] + (unit * 9)[: r.randint(1, 50)] + words[20:]
        parts = r.randint(1, 4)
        found = [x for p in range(parts) for x in periodic.stretches(periodic.numbered(words), periodic.lag_range(len(words), p, parts, 4), 4, 6)]
        assert periodic.primitive(found) == runs_brute(words)
    assert periodic.greatest([(5, 12, 3), (0, 8, 2), (1, 4, 1), (0, 16, 4)]) == (0, 8, 2) and periodic.greatest([]) is None


@pytest.mark.parametrize("size", [1 << 16, 300])
def test_repetition(spark, docs, clashing, nothing, size, monkeypatch):
    monkeypatch.setattr(periodic, "RANGE_BYTES", size)
    monkeypatch.setattr(periodic, "STEP", 1 << 12 if size == 300 else 1 << 19)
    extra = [(50, "a b c " * 9), (51, "z " + "x y " * 200 + prose(3, 30)), (52, " ".join(["q"] * 6)), (53, "\x0bp\x0cp\tp\np\rp p "), (54, "é ü " * 4 + "é"), (None, "k l " * 90), (None, "k l " * 90), (50, "a b c " * 9)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], docs.schema)
    for df in (docs.where("doc_id <> 8 or doc_id is null").unionByName(more), clashing.where("doc_id <> 8 or doc_id is null")):
        got = periodic.repetition(df, rewrite=queries.periodic_tail)
        assert got.columns == ["doc_id", "runs", "start", "length", "period", "exponent_milli", "collapsed"]
        want = []
        for i, t in df.select("doc_id", "text").collect():
            words = queries.periodic_tail(i, (t or "").encode().split())
            runs = runs_brute(words)
            best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
            gone = {k for s, n, p in runs for k in range(s + p, s + n)}
            want.append((i, runs, best, best and 1000 * best[1] // best[2], b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
        seen = [(r.doc_id, [tuple(x) for x in r.runs], None if r.start is None else (r.start, r.length, r.period), r.exponent_milli, r.collapsed) for r in got.collect()]
        assert sorted(seen, key=repr) == sorted(want, key=repr)
        assert any(len(r) > 0 for _, r, *_ in want)
    assert periodic.repetition(nothing).collect() == []
    with pytest.raises(ValueError, match="four periods"):
        periodic.repetition(docs, 2)
