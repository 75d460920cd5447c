from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.config import SKIP_BACK, SKIP_FORWARD, Page, ParseConfig, Semantic, Sliding, Snapping, chunk_config_from_json, chunk_config_to_json, collection_name
from passagework.errors import InvalidConfig
from passagework.functions.text import WHITE_SPACE
from passagework.operators.chunking import chunk_by_config, cluster, register, similarities, sliding, snap
from passagework.operators.sentences import groups, sentences_before


def windows(text: str, size: int, overlap: int) -> list[str]:
    """The fixed-size windows, one after the other."""
    data = text.strip(WHITE_SPACE).encode()
    if not data or len(data) <= size + overlap:
        return [data.decode()] if data else []
    out, k = [], 0
    while True:
        a, b = max(k * size - overlap, 0), (k + 1) * size + overlap
        while 0 < a < len(data) and data[a] & 0xC0 == 0x80:
            a -= 1
        stop = b > len(data)
        b = min(b, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        out.append(data[a:b].decode())
        if stop:
            return out
        k += 1


def native(spark, texts: list[str | None], c: Sliding) -> list[list[str] | None]:
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in df.select("i", sliding(F.col("t"), c).alias("c")).orderBy("i").collect()]


TEXTS = ["0123456789" * 3, "0123456789" * 2 + "01234", "0123456789" * 2, "", "  　 ", " padded \x85", "Ä" * 40, "a" * 7 + "😀" * 30 + "é", "x" * 200 + " ", None]


@pytest.mark.parametrize(("size", "overlap"), [(10, 5), (10, 0), (7, 7), (1000, 200), (3, 1)])
def test_native_windows(spark, size, overlap):
    assert native(spark, TEXTS, Sliding(size, overlap)) == [None if t is None else windows(t, size, overlap) for t in TEXTS]
    register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    assert [r.c for r in df.selectExpr("i", f"chunk_sliding(t, {size}, {overlap}) AS c").orderBy("i").collect()] == native(spark, TEXTS, Sliding(size, overlap))


def test_window_ranges(spark):
    text = "0123456789" * 3
    assert native(spark, [text], Sliding(10, 5)) == [[text[:15], text[5:25], text[15:]]]
    assert native(spark, ["0123456789" * 2], Sliding(10, 0)) == [["0123456789", "0123456789", ""]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab .é😀 \n", max_size=60), min_size=1, max_size=8), st.integers(1, 12), st.integers(0, 12))
def test_native_windows_of_any_text(texts, size, overlap):
    from pyspark.sql import SparkSession

    if overlap <= size:
        spark = SparkSession.getActiveSession()
        assert native(spark, texts, Sliding(size, overlap)) == [windows(t, size, overlap) for t in texts]


def test_sentences_with_overlap():
    assert snap("Aa bb. Cc dd. Ee ff. Gg hh.", Snapping(1, 1)) == ["Aa bb. Cc dd.", " Cc dd. Ee ff. Gg hh."]
    assert snap("Aa bb. Cc dd. Ee ff.", Snapping(1, 1)) == ["Aa bb. Cc dd.", " Cc dd. Ee ff."]
    assert snap("", Snapping(1, 1)) == [] and snap(" 　\n", Snapping(1, 1)) == []
    assert snap("One. Two.", Snapping(1000, 5)) == ["One. Two."]


def test_patterns_keep_sentences_whole():
    text = "We saw birds, cats, etc. and more. It was e.g. late, see our-site.com. Then we left."
    assert snap(text, Snapping(1, 1)) == ["We saw birds, cats, etc. and more. It was e.g. late, see our-site.com.", " It was e.g. late, see our-site.com. Then we left."]
    assert len(snap("See a.co. Then b.", Snapping(1, 0))) == 2
    assert len(snap("See a.co. Then b.", Snapping(1, 0).extended([], ["co"]))) == 1


def test_three_notions_of_a_stop():
    assert groups("A... B. C.", 1, ".", [], []) == ["A... B.", " C."]
    assert groups("See a.xyz now. End.", 1, ".", [], []) == ["See a.xyz now.", " End."]
    text = "See a.xyz now. End."
    assert text[sentences_before(text, 2, ".", [], []) :] == "xyz now. End."
    assert text[sentences_before(text, 1, ".", [], []) :] == " End."
    web = "Go to my.com now. End."
    assert web[sentences_before(web, 2, ".", SKIP_FORWARD, SKIP_BACK) :] == web


def test_scans_end():
    for text in ("ends in e.g.", "i.e.", "www.", "...", ".", "a. ", "e.g. e.g. e.g."):
        assert "".join(groups(text, 1, ".", SKIP_FORWARD, SKIP_BACK)) == text
        assert snap(text, Snapping(0, 0))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. .é　\nwe.gc", max_size=120), st.integers(0, 20), st.integers(0, 3))
def test_chunks_are_parts_and_reach_the_end(text, size, overlap):
    chunks = snap(text, Snapping(max(size, overlap), overlap))
    assert all(c in text for c in chunks)
    assert not chunks or text.endswith(chunks[-1])
    assert bool(chunks) == bool(text.strip(WHITE_SPACE))
    assert "".join(groups(text, 2, ".", SKIP_FORWARD, SKIP_BACK)) == text


def test_clusters():
    e1, e2 = [1.0, 0.0], [0.0, 1.0]
    parts = ["g0", " g1 ", " g2", " g3"]
    assert cluster(parts, np.array([e1, e2, e1, e2]), Semantic(threshold=0.5)) == ["g0 g2", "g1 g3"]
    near = np.array([[1.0, 0.2], [0.5, 1.0], [0.6, 1.0]])
    assert cluster(["a", "b", "c"], near, Semantic(threshold=0.7)) == ["a", "bc"]
    leaning = np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])
    assert cluster(["a", "b", "c"], leaning, Semantic(threshold=0.55)) == ["ac", "b"]
    assert cluster(["a", "b", "c"], leaning, Semantic(threshold=0.55, best_match=True)) == ["a", "bc"]
    assert cluster(["a", " ", "b"], np.zeros((3, 2)), Semantic(threshold=0.0)) == ["a", "b"]  # no direction, no match
    assert cluster(["x", "y", "z"], leaning, Semantic(threshold=1.5)) == ["x", "y", "z"]
    assert cluster(["x", "y", "z"], leaning, Semantic(threshold=-1.5)) == ["xyz"]
    assert cluster([], np.zeros((0, 2)), Semantic()) == []


def test_similarities():
    a, b = np.array([[1.0, 2.0, 3.0]]), np.array([2.0, 0.0, 4.0])
    want = {"cosine": 14 / np.sqrt(14 * 20), "euclidean": np.sqrt(6), "manhattan": 4, "chebyshev": 2, "dotProduct": 14, "angular": np.arccos(14 / np.sqrt(280)) / np.pi}
    assert all(np.isclose(similarities(n, a, b)[0], w) for n, w in want.items())
    assert np.isclose(similarities("minkowski", a, b, 3)[0], (1 + 8 + 1) ** (1 / 3))


def test_configs_round_trip():
    for c in (Sliding(30, 20), Snapping(5, 1, "!", ["x"], []), Semantic(2, 0.5), Semantic(distance="minkowski", p=3)):
        assert chunk_config_from_json(chunk_config_to_json(c)) == c
    old = json.loads(chunk_config_to_json(Semantic(2, 0.5)))
    old["semantic"]["embedModel"] = old["semantic"].pop("embeddingModel")
    assert chunk_config_from_json(json.dumps(old)) == Semantic(2, 0.5)
    assert ParseConfig.from_json(ParseConfig(1, 2, True, ["x"]).to_json()) == ParseConfig(1, 2, True, ["x"])
    assert [c.display for c in (Sliding, Snapping, Semantic)] == ["SlidingWindow", "SnappingWindow", "SemanticWindow"]
    assert (Sliding(), Snapping().size, Snapping().overlap, Semantic().size, Semantic().threshold) == (Sliding(1000, 200), 1000, 5, 10, 0.9)


@pytest.mark.parametrize(
    "bad",
    [
        lambda: Sliding(5, 6), lambda: Sliding(0, 0), lambda: Snapping(1, 2), lambda: Snapping(skip_f=[""]), lambda: Snapping(delimiter=".."), lambda: Semantic(distance="near"), lambda: Semantic(distance="minkowski"),
        lambda: ParseConfig(2, 2, True), lambda: ParseConfig(0, 3, True), lambda: ParseConfig(filters=["("]), lambda: Page(0), lambda: Page(per_page=0), lambda: Page(sort_by="a b"), lambda: Page(sort_by=""),
        lambda: chunk_config_from_json("{}"), lambda: chunk_config_from_json('{"other": {}}'), lambda: chunk_config_from_json('{"sliding": {"size": 3}}'), lambda: ParseConfig.from_json('{"start": 1}'),
        lambda: collection_name("_x"), lambda: collection_name("lower"), lambda: collection_name("A-b"), lambda: collection_name(" "),
    ],
)
def test_bad_configs(bad):
    with pytest.raises(InvalidConfig):
        bad()


def test_names():
    assert collection_name(" My_collection_0 ") == "My_collection_0"


def test_chunks_by_each_rows_configuration(spark):
    df = spark.createDataFrame([(1, "0123456789" * 3, 0), (2, "Aa. Bb. Cc.", 1), (3, " ", 0), (4, "x", None), (5, "x", 9)], "id int, text string, kind int")
    got = sorted((r.id, -1 if r.chunk_idx is None else r.chunk_idx, r.chunk, r.error) for r in chunk_by_config(df, [Sliding(10, 5), Snapping(1, 0)], "kind").collect())
    assert [(i, k) for i, k, _, _ in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, -1), (4, -1), (5, -1)]
    assert [e for *_, e in got][6:] == ["chunks cannot be empty", "no chunker", "no chunker"]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT chunk_snapping('Aa bb. Cc dd. Ee ff.', 1, 1) AS c, split_sentences('A b. C d.') AS s, vector_similarity('cosine', array(1D, 0D), array(1D, 0D)) AS v").first()
    rows = spark.sql("SELECT d.id, c.chunk_idx, c.chunk FROM VALUES (7, 'Aa bb. Cc dd.') AS d(id, t), LATERAL chunks(d.t, 1, 0) c").collect()
    assert [tuple(r) for r in rows] == [(7, 0, "Aa bb."), (7, 1, " Cc dd.")]
    assert row.c == ["Aa bb. Cc dd.", " Cc dd. Ee ff."] and row.s == ["A b.", " C d."] and row.v == 1.0
