from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import sharding, topk, warc
from passagework.llm.common import new_path, shared_dir


def least_capacity(sizes: list[int], shards: int) -> int:
    def fits(c: int) -> bool:
        used, now = 1, 0
        for s in sizes:
            if s > c:
                return False
            if now + s > c:
                used, now = used + 1, 0
            now += s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_least(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 60) for _ in range(r.randint(1, 40))] + [r.choice([1, 400])]
    assert sharding.smallest_capacity(np.array(sizes), 8) == least_capacity(sizes, 8)


def test_shards(docs, clashing, nothing, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)  # cells of several groups, which must be split
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    rows = sharding.minimax_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    shard_of: dict = {}
    for r in rows:
        assert shard_of.setdefault(r.group_hash, r.shard) == r.shard
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    groups: dict = {}
    for r in rows:
        groups[r.group_hash] = groups.get(r.group_hash, 0) + r["size"]
    total: dict = {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    assert max(total.values()) == least_capacity([groups[g] for g in sorted(groups)], 4)
    assert sharding.minimax_shards(clashing, 4).count() == docs.count()
    assert sharding.minimax_shards(nothing, 4).collect() == []


PAGES = [(5, "http://a/ x", "<p>" + "same " * 40), (3, None, "<p>" + "same " * 40), (9, "http://b/é", "<p>" + "same " * 40), (1, "u", None), (2, "u", ""), (4, "v", "short"), (6, "v", "short"), (None, "w", "<p>" + "same " * 40), (7, "x", "a\r\n\r\nb" * 50), (7, "x", "a\r\n\r\nb" * 50), (8, "y", "WARC/1.1\r\n" + "é" * 30_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)


def test_through_archives(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)  # several archives, of both versions
    got = warc.pages_through_archives(pages.withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))).collect()
    assert len(got) == len(PAGES) and all(r.intact for r in got)
    bodies = sorted((i is None, i or 0, (h or "").encode()) for i, _, h in PAGES)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == sorted((a, b, len(c), hashlib.sha256(c).hexdigest()) for a, b, c in bodies)
    same = [r for r in got if r.payload_bytes == 203]
    assert {(r.page_id, r.record_type, r.refers_to) for r in same} == {(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3)}
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 7) == [("response", None), ("revisit", 7)]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    assert len({r.record_id for r in got}) == len(PAGES)


def test_no_pages(spark, pages):
    assert warc.pages_through_archives(pages.limit(0)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.arc_version_block("x.arc", version).encode() + warc.arc_record("http://h/p", warc.http_block(b"body\n\nmore", 5), version) + b"\n" + warc.arc_record(None, b"no http", version) + b"\n"
    rows = list(warc.parse_arc(data, "x"))
    assert rows[0]["kind"] == "version" and [(r["url"], r["payload"], r["date"]) for r in rows[1:]] == [("http://h/p", b"body\n\nmore", warc.CAPTURED), (None, b"no http", warc.CAPTURED)]
    cut = list(warc.parse_arc(data[:-20], "x"))
    assert [r["kind"] for r in cut] == ["version", "record", "error"]


def archive(version: int, n: int) -> list[bytes]:
    return [warc.arc_version_block("x.arc", version).encode()] + [warc.arc_record(f"http://h/{k}", warc.http_block(b"%d " % k * 60, k), version) + b"\n" for k in range(n)]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("damage", ["fields", "length", "rubbish"])
def test_damaged_headers_are_told_and_passed_over(spark, tmp_path, version, damage):
    parts = archive(version, 5)
    head, _, block = parts[3].partition(b"\n")
    own = head.split(b" ")
    parts[3] = {"fields": b" ".join([own[0], *own[2:]]), "length": b" ".join([*own[:-1], b"12x4"]), "rubbish": b"\xff\xfe"}[damage] + b"\n" + block
    data = b"".join(parts)
    kinds = [r["kind"] for r in warc.parse_arc(data, "x")]
    assert kinds == ["version", "record", "record", "error", "record", "record"]
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "a.arc.gz").write_bytes(b"".join(map(warc.member, parts)))
    (folder / "b.arc").write_bytes(b"".join(archive(version, 3)))
    warc.convert(spark, f"file://{folder}", f"file://{tmp_path}/warc")
    got = warc.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert all(r.intact for r in got)
    count = {k: sum(r.kind == k for r in got) for k in ("warcinfo", "response", "revisit", "metadata")}
    assert count == {"warcinfo": 2, "response": 5, "revisit": 2, "metadata": 1}
    assert [bytes(r.payload).startswith(b"damaged at") for r in got if r.kind == "metadata"] == [True]


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Skewed sizes: thousands of small pages and a few large ones; a member for each record."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    rows = [(k, "u", "x" * 60) for k in range(3000)] + [(10_000 + k, "u", chr(65 + k) * 90_000) for k in range(5)] + [(20_000, "u", "y" * 300_000)]
    warc.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/arc")
    sizes = []
    for (data,) in warc.files(spark, f"file://{tmp_path}/arc").select("content").collect():
        parts = list(warc.parse_arc(warc.unzipped(bytes(data))))
        assert bytes(data).count(b"\x1f\x8b\x08") >= len(parts) + 1 and parts[0]["kind"] == "version" and not any(r["kind"] == "error" for r in parts)
        sizes.append((len(warc.unzipped(bytes(data))), len(parts) - 1))
    assert sum(n for _, n in sizes) == len(rows) and len(sizes) > 8
    assert all(size < 130_000 or n == 1 for size, n in sizes)


def test_warc_dates_and_damage():
    assert warc.warc_date("1997") == "1997-01-01T00:00:00Z" and warc.warc_date("19970605040302") == "1997-06-05T04:03:02Z" and warc.warc_date("x") == "1970-01-01T00:00:00Z"
    good = warc.warc_record("response", "u", "1.2.3.4", "1997", "", b"p", "d", "<urn:a>", None) + warc.WARC_END.encode()
    assert [r["kind"] for r in warc.parse_warc(good + b"rubbish")] == ["response", "error"]


def brute(rows, k):
    out = []
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 7])
def test_exact_top_k(spark, shard, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "SEEDS", 12)
    r = random.Random(3)
    rows = [(i, [r.choice([r.gauss(0, 0.2), 0.25, -0.5]) for _ in range(8)]) for i in range(0, 330, 3)]
    rows += [(200, [0.5] * 8), (200, [0.25] * 8), (6, None), (400, [float("nan")] * 8), (500, [1.0, 2.0]), (700, []), (None, [0.1] * 8), (7, [None] * 8), (99, [0.5] * 8), (98, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("score", F.lit("x"))
    got = topk.search(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == [x for x in brute(rows, 10)]


def test_skips_what_cannot_enter():
    r = np.random.default_rng(1)
    rows = np.zeros((4000, 32), np.int64)
    rows[:, :4] = r.integers(-900, 900, (4000, 4))
    rows[:, 4:] = r.integers(-3, 3, (4000, 28))
    queries = rows[:5]
    for q, at, scores in topk.maxscore(queries, np.arange(5), rows, np.arange(4000), 10):
        exact = rows @ queries[q]
        exact[q] = -(10**9)
        assert scores.astype(int).tolist() == np.sort(exact)[::-1][:10].tolist() and (exact[at] == scores.astype(int)).all()


def test_new_paths_are_shared(spark):
    assert new_path(spark, "x").startswith(f"{shared_dir(spark)}/")
