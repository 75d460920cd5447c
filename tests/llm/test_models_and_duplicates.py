from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from passagework.llm import components, kneser_ney, minhash, simhash, toxicity


def words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, n: int) -> list[str]:
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []


def fingerprint(text: str | None) -> int:
    own = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_simhash_components(docs, clashing, nothing):
    rows = docs.collect()
    fps = [fingerprint(r.text) for r in rows]
    u = Union()
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                u.join(i, j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[u.find(i)].append(r.doc_id)
    want = sorted(((r.doc_id, f"{fps[i]:016x}", min(least[u.find(i)], default=None)) for i, r in enumerate(rows)), key=repr)
    for df in (docs, clashing):
        assert sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr) == want
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize(("tau", "hot"), [(2, 256), (2, 1), (4, 256), (8, 256), (8, 1)])
def test_links_connect_what_chains_connect(spark, tau, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(tau)
    values = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            values.add(x)
            for b in r.sample(range(64), r.randint(0, tau + 2)):
                x ^= 1 << b
    values = sorted(values)
    u = Union()
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= tau:
                u.join(a, b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {x.node: x.root for x in components.components(simhash.links(df, tau)).collect()}
    groups = defaultdict(set)
    for v in values:
        groups[got.get(signed(v), signed(v))].add(v)
    want = defaultdict(set)
    for v in values:
        want[u.find(v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_thresholds_are_allocated_at_least_cost():
    r = random.Random(1)
    for _ in range(30):
        m, tau = r.randint(1, 4), r.randint(0, 4)
        costs = [[0.0, *sorted(r.uniform(0, 100) for _ in range(tau + 1))] for _ in range(m)]
        cost, ts = simhash.allocate(costs, tau)
        options = [()]
        for _ in range(m):
            options = [(*o, t) for o in options for t in range(-1, tau + 1)]
        best = min(sum(costs[i][t + 1] for i, t in enumerate(o)) for o in options if sum(o) == tau - m + 1)
        assert sum(ts) == tau - m + 1 and math.isclose(cost, best)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(200, 260)] + [(7, 7), (None, 3), (260, 100)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[k] for k in [100, *range(200, 261)]} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def similarity(a: str | None, b: str | None) -> float:
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_group_stays(spark, docs, clashing, nothing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    rows = docs.collect()
    u = Union()
    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i].text, rows[j].text) >= 0.8:
                u.join(i, j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[u.find(i)].append((r.doc_id is None, r.doc_id or 0, r.text))
    assert sorted(i or 0 for i, _ in got) == sorted(min(g, key=lambda x: x[:2])[1] for g in groups.values())
    assert simhash.keep_one(clashing).columns == clashing.columns
    assert simhash.keep_one(nothing).collect() == []


def test_near_copies_in_a_large_family(spark):
    base = prose(21, 400).split()
    rows = []
    for k in range(120):
        own = list(base)
        own[(3 * k) % 400] = f"other{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, prose(500 + k, 300)) for k in range(40)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, *range(1000, 1040)}


def test_changed_parts_of_new_words_stay_near_copies(spark):
    """Appended, truncated, replaced and short copies whose word sets differ in many bits."""
    pairs = []
    for k in range(60):
        a = [f"{w}{i % 7}" for i, w in enumerate(prose(6000 + k, [25, 60, 120, 400][k % 4]).split())]
        more = prose(7000 + k, len(a)).split()
        cut = len(a) // 11
        pairs.append([(a, a + more[: len(a) // 9]), (a, a[: len(a) - cut]), (a, a[: len(a) - cut // 2] + more[: cut // 2])][k % 3])
    texts = [(" ".join(a), " ".join(b)) for a, b in pairs]
    assert all(similarity(*x) >= 0.85 for x in texts)
    sets = lambda t: sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(w.encode()) >> b & 1 for w in set(words(t))) > len(set(words(t))))
    assert sum((sets(a) ^ sets(b)).bit_count() > simhash.WORD_TAU for a, b in texts) >= 5
    rows = [(i, t) for k, x in enumerate(texts) for i, t in zip((k, 1000 + k), x, strict=True)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(60))


def test_pairs_around_the_threshold_are_told_exactly(spark):
    rows, want = [], set()
    for k in range(150):
        a = prose(8000 + k, 300).split()
        more = 5 + k // 2  # similarities from about 0.98 down to 0.78
        b = a + prose(9000 + k, more).split()
        rows += [(k, " ".join(a)), (1000 + k, " ".join(b))]
        want |= {k} if similarity(" ".join(a), " ".join(b)) >= 0.8 else {k, 1000 + k}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 1000 < max(want) and kept == want


@pytest.mark.parametrize(("block", "hot"), [(1 << 21, 256), (700, 2)])
def test_chains_whose_ends_differ(spark, block, hot, monkeypatch):
    """Texts that change step by step, so most of a family is not similar to its first; long ones that share a passage."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", hot)
    r, texts, passage = random.Random(3), [], prose(1, 90)
    for c in range(4):
        w = prose(300 + c, 240).split()
        for k in range(25):
            at = r.randrange(len(w) - 12)
            w[at : at + r.randint(1, 9)] = prose(1000 * c + k, r.randint(1, 9)).split()
            texts.append(" ".join(w))
    texts += [f"{prose(700 + k, 1500)} {passage} {prose(800 + k, 400)}" for k in range(8)] + [f"{passage} {prose(900 + k, 15)}" for k in range(8)]
    u = Union()
    for i in range(len(texts)):
        u.find(i)
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                u.join(i, j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.keeper.doc_id for x in simhash.groups(df).collect()} == {i: u.find(i) for i in range(len(texts))}


def test_prefixes_and_parities_lose_no_similar_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(r.integers(0, n // 8 + 1))], r.integers(0, 1 << 63, int(r.integers(0, n // 8 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
            continue
        bits = simhash.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert simhash._may_be_alike(np.array([len(a)]), bits[:1], np.array([len(b)]), bits[1:])[0]
        assert len(np.intersect1d(*[x[: len(x) + -4 * len(x) // 5 + 1] for x in (a, b)]))


def features(text: str) -> set:
    """What likeness counts: shingles of five words, long words by character, and of five characters in short texts."""
    tokens = [x for w in words(text) for x in ([w] if len(w.encode()) <= 24 else w)]
    out = {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return out | ({low[i : i + 5] for i in range(max(1, len(low) - 4))} if tokens and len(text) < 100 else set())


def likeness(a: str, b: str) -> float:
    x, y = features(a), features(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_minhash_of_edits(docs, clashing, nothing):
    rows = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))  # rows with equal ids go by hash
    got = defaultdict(list)
    for r in minhash.fingerprints_with_edits(clashing).collect():
        got[r.doc_id].append(r)
    for k, r in enumerate(rows):
        text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own = [x for x in got[r.doc_id] if x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert own, r.doc_id
        off = 0.12 if min(len(features(t)) for t in (text, edited, after)) > 6 else 0.2  # a few features fill all bins
        assert any(abs(x.near_edited - likeness(text, edited)) < off and abs(x.near_next - likeness(text, after)) < off for x in own)
    assert sum(map(len, got.values())) == len(rows)
    assert minhash.fingerprints_with_edits(nothing).collect() == []


@pytest.mark.parametrize("width", [8 << 20, 3000])
def test_every_row_has_its_next(spark, width, monkeypatch):
    """Ids above 2**53 beside null ones, equal ids and equal rows, in one partition and many ranges."""
    monkeypatch.setattr(minhash, "RANGE_BYTES", width)
    ids = [(1 << 60) + k for k in range(300)] + [-(1 << 62), (1 << 63) - 1, -(1 << 63), None, None] + [5] * 60 + [None] * 40 + [7, 7]
    rows = [(i, "same text of seven words for all" if k % 50 == 0 else f"{prose(k, 12)}") for k, i in enumerate(ids)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(rows, "doc_id long, text string").repartition(7)):
        got = minhash.fingerprints_with_edits(df).collect()
        assert Counter(r.doc_id for r in got) == Counter(ids)
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
        nexts = defaultdict(set)  # ids alone order distinct ones
        for (i, t), (j, x) in zip(order, [*order[1:], order[0]], strict=True):
            nexts[i].add(j)
        by_id = {i: t for i, t in rows if ids.count(i) == 1}
        for r in got:
            if r.doc_id in by_id and len(nexts[r.doc_id]) == 1 and (j := next(iter(nexts[r.doc_id]))) in by_id:
                t, x = by_id[r.doc_id], by_id[j]
                k = len(t) // 3
                assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + x[:k]).encode()).hexdigest()


def test_texts_of_few_words_and_without_spaces_have_likenesses():
    r = random.Random(4)
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9F00)) for _ in range(n))
    texts = [(t := prose(k, 6), t[: len(t) - len(t) // 3] + prose(90 + k, 6)[: len(t) // 3]) for k in range(20)] + [(h := han(900), h[:600] + han(300))]
    for a, b in texts:
        low, has = minhash.sketch(*minhash._bytes_of([a, b]))
        assert minhash.likeness(low[:1], has[:1], low[1:], has[1:])[0] > 0.15


def test_minhash_estimates_and_packing():
    errors = []
    for k in range(40):
        a = prose(k, 300).split()
        b = a[: 40 + 6 * k] + prose(1000 + k, 260 - 6 * k).split()
        texts = [" ".join(a), " ".join(b)]
        low, has = minhash.sketch(*minhash._bytes_of(texts))
        near = minhash.likeness(low[:1], has[:1], low[1:], has[1:])[0]
        errors.append(near - similarity(*texts))
        for row, p in zip(low, minhash.packed(low, has), strict=True):
            assert (minhash.unpacked(p) == row).all()
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def kneser_ney_brute(trusted: list[bytes], order: int):
    """Interpolated modified Kneser-Ney by the book, with dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in trusted:
        padded = bytes(order - 1) + t
        for i in range(len(t)):
            counts[order][padded[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    discounts = [None]
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        if not all(n[i] for i in range(1, 5)):
            discounts.append([0.5, 0.75, 0.9])
            continue
        y = n[1] / (n[1] + 2 * n[2])
        discounts.append([min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)])
    after = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]].append(c)

    def p(g: bytes) -> float:
        k = len(g)
        if not k:
            return 1 / 256
        known = after[k][g[:-1]]
        if not known:
            return p(g[1:])
        c = counts[k][g]
        d = lambda c: 0 if not c else discounts[k][min(c, 3) - 1]
        return (c - d(c) + sum(map(d, known)) * p(g[1:])) / sum(known)

    def perplexity(t: bytes) -> float | None:
        padded = bytes(order - 1) + t
        return 2 ** (-sum(math.log2(p(padded[i : i + order])) for i in range(len(t))) / len(t)) if t else None

    return perplexity


def test_perplexities_against_brute_force(spark, docs, clashing, nothing):
    labels = spark.createDataFrame([(6, 1), (9, 1), (9, 1), (10, 1), (13, 0), (13, 1), (None, 1), (17, None), (15, 1), (777, 1)], "doc_id long, quality int")
    rows = docs.where("doc_id is null or doc_id <> 8").collect()
    counted = {r.i for r in spark.range(20).toDF("i").where(~kneser_ney.left_out(F.col("i"))).collect()}
    assert {6, 9, 10, 15} - counted != {6, 9, 10, 15}
    trusted = [(r.text or "").encode() for r in rows if r.doc_id in {6, 9, 10, 15} & counted]
    perplexity = kneser_ney_brute(trusted, kneser_ney.ORDER)
    want = sorted(((r.doc_id, perplexity((r.text or "").encode())) for r in rows), key=repr)
    got = kneser_ney.quality(clashing.where("doc_id is null or doc_id <> 8"), labels).collect()
    got_pairs = sorted(((r.doc_id, r.perplexity) for r in got), key=repr)
    assert [g[0] for g in got_pairs] == [w[0] for w in want]
    for (_, a), (_, b) in zip(sorted(got_pairs, key=lambda x: (repr(x[0]), x[1] or 0)), sorted(want, key=lambda x: (repr(x[0]), x[1] or 0)), strict=True):
        assert a == b or math.isclose(a, b, rel_tol=1e-9)
    assert not any(r.accepted for r in got if r.perplexity is None)
    kept = kneser_ney.keep_accepted(clashing, labels)
    assert kept.columns == clashing.columns
    assert kneser_ney.quality(nothing, labels).collect() == []
    uniform = kneser_ney.quality(docs.limit(5), labels.limit(0)).collect()
    assert all(r.perplexity is None or math.isclose(r.perplexity, 256) for r in uniform)


def test_thresholds_are_the_languages_quantiles(spark):
    """Over the trusted documents that were left out of the counts, and no slack on them."""
    rows = [(k, 0, lang, 1000, p + k / 100, True, True) for lang, p in (("en", 4.0), ("de", 6.0)) for k in range(100)]
    rows += [(200, 0, "en", 1000, 7.0, False, False), (201, 0, "en", 1000, 1.0, True, False), (202, 0, "fr", 1000, 2.0, True, True)]
    scored = spark.createDataFrame(rows, "doc_id long, key long, lang string, n_bytes long, perplexity double, trusted boolean, left_out boolean")
    cuts, common = kneser_ney.thresholds(scored)
    assert cuts == {"en": 4.98, "de": 6.98} and 6.9 < common < 7
    assert kneser_ney.thresholds(scored.withColumn("left_out", F.lit(False)))[1] > 4
    texts = [(k, " ".join(prose(k, 120).split()), "en") for k in range(700)]
    r = random.Random(8)
    texts += [(1000 + k, " ".join("".join(r.sample(w, len(w))) for w in prose(4000 + k, 60).split()), "en") for k in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("unseen", kneser_ney.left_out(F.col("doc_id")))
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in texts], "doc_id long, quality int")
    unseen = {x.doc_id for x in df.where("unseen and doc_id < 1000").collect()}
    got = {x.doc_id: x for x in kneser_ney.quality(df, labels).collect()}
    ordered = sorted(got[k].perplexity for k in unseen)
    assert len(unseen) >= 50 and got[0].threshold in ordered[-3:]
    assert sum(got[k].accepted for k in range(700)) >= 690 and not any(got[1000 + k].accepted for k in range(40))
    assert all(x.accepted == (x.perplexity <= x.threshold) for x in got.values())


def test_probabilities_sum_to_one(spark):
    text = prose(3, 400).encode()
    seen = Counter((bytes(2) + text)[i : i + 3] for i in range(len(text)))
    contexts = list({g[:2] for g in seen})[:20] + [b"zz", b"\xff\xfe"]
    rows = {(g[0] << 16 | g[1] << 8 | g[2], c) for g, c in seen.items()} | {(c[0] << 16 | c[1] << 8 | b, 0) for c in contexts for b in range(256) if c + bytes([b]) not in seen}
    p = kneser_ney.probabilities(spark.createDataFrame(sorted(rows), "gram long, c long"), 3)
    sums = p.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("p").alias("p"), F.count("*").alias("n")).where("n = 256").collect()
    assert len(sums) >= 10 and all(r.p <= 1 + 1e-9 for r in sums)


def toxic_rows(n: int):
    r, out = random.Random(4), []
    for k in range(n):
        w = prose(3000 + k, 60).split()
        bad = k % 4 == 0
        for _ in range(4 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["scum!", "IDIOT", "moron,"]))
        out.append((k, " ".join(w), "en" if k % 2 else "de", int(bad)))
    return out


def test_toxicity_is_learned_from_the_text_alone(spark, docs, clashing, nothing):
    rows = toxic_rows(700)
    df = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, ~toxicity.held_out(F.col("l_id")))
    held = [r.doc_id for r in df.where(toxicity.held_out(F.col("doc_id"))).collect()]
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    right = [(scores[i] >= 0.5) == bool(rows[i][3]) for i in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    other = toxicity.score(df.withColumn("lang", F.lit("x")).withColumn("doc_id", F.col("doc_id") + 1000), model).collect()
    assert {r.doc_id - 1000: r.score for r in other} == scores
    odd = toxicity.score(clashing, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert set(toxicity.keep_civil(clashing, labels).columns) == set(clashing.columns)
    assert toxicity.score(nothing, model).collect() == []
    assert toxicity.fit(nothing, labels).constant is not None
    assert toxicity.fit(df, labels.where("toxic = 0")).scores(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0] < 1e-6


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    model = toxicity.Model()
    docs = [r.integers(0, toxicity.ROWS, (toxicity.PARTS, n)).astype(np.int32) for n in (5, 9, 1, 30)]
    y = np.array([1, 0, 1, 0], np.float32)

    def loss() -> float:
        z = np.concatenate([model.logits(rows, np.array([0, rows.shape[1]])) for rows in docs])
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    before = loss()
    model.train(docs, y, epochs=8, batch=4, rate=0.02)
    assert loss() < before


def test_inflected_forms_share_rows():
    rows, at = toxicity.word_rows(np.frombuffer("Achlicher achlichkeit r\u00e9eux achl".encode(), np.uint8), np.array([0, 35, 35]))
    assert rows.shape == (toxicity.PARTS, 4) and at.tolist() == [0, 4, 4]
    same = rows[:, 0] == rows[:, 1]
    assert same.tolist() == [False, True, True, True, True] and (rows[:, 0] == rows[:, 3]).tolist() == [False, True, True, False, False]


def test_held_out_rows_of_one_id_and_several_texts(spark):
    """Rows that share an id are one training row, whichever task reads them, so models are the same."""
    rows = [(k % 80, f"{prose(k, 30)}{' moron' if k % 80 < 30 else ''}", "en") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(80)], "doc_id long, toxic int")
    models = [toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), labels) for n in (1, 7)]
    assert (models[0].table == models[1].table).all() and models[0].offset == models[1].offset


def test_accuracy_on_held_out_rows(spark):
    from passagework.llm import queries

    folder = "/root/testdata/sf0.1"
    scored = queries.op2_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic is not null").select("score", "toxic").collect()
    score, y = np.array([r.score for r in scored]), np.array([r.toxic for r in scored])
    above = (score[y == 1][:, None] > score[y == 0]).mean() + (score[y == 1][:, None] == score[y == 0]).mean() / 2
    assert above > 0.97 and ((score >= 0.5) & (y == 1)).sum() / (y == 1).sum() > 0.85 and ((score >= 0.5) & (y == 1)).sum() / (score >= 0.5).sum() > 0.85


def test_best_cut():
    assert toxicity.best_cut(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0]), np.ones(4)) == 1.5


def test_every_labelled_row_trains_or_calibrates(spark, monkeypatch):
    """Rows dealt over parts: all of them are trained on, with a result as good, whichever tasks read them."""
    rows = toxic_rows(700)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    one_round = toxicity._round
    monkeypatch.setattr(toxicity, "_round", lambda some, parts, *rest: (seen.append((some.count(), parts)), one_round(some, parts, *rest)))
    monkeypatch.setattr(toxicity, "cuts", lambda judged, f=toxicity.cuts: (seen.append((judged.count(), 0)), f(judged))[1])
    models = [toxicity.fit(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(n), labels) for n in (1, 5)]
    assert seen[0][1] == 7 and seen[0][0] + seen[5][0] == len(rows) and len(seen) == 12
    assert (models[0].table == models[1].table).all() and models[0].offset == models[1].offset and models[0].thresholds == models[1].thresholds
    for label in (0, 1):
        z = [models[0].scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t, _, y in rows if y == label]
        assert np.mean((np.array(z) >= 0.5) == label) > 0.95


def test_cuts_are_the_best_of_all_rows(spark):
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 600)
    logit = np.round(r.normal(2 * y - 1, 1), 2)
    lang = np.array(["en", "de", "", None], object)[r.choice(4, 600, p=[0.5, 0.4, 0.05, 0.05])]
    lang[:20] = "few"
    got = toxicity.cuts(spark.createDataFrame([(x, int(a), float(z)) for x, a, z in zip(lang, y, logit, strict=True)], "lang string, y int, logit double").repartition(5))
    assert set(got) == {None, "en", "de"}
    for name, cut in got.items():
        own = np.ones(600, bool) if name is None else lang == name
        assert cut == toxicity.best_cut(logit[own], y[own], np.ones(own.sum()))
