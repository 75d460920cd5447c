"""What lambdas of page and line expressions use is computed once a row, with the results of the plain patterns."""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import functions as F

from passagework.functions.text import WHITE_SPACE, lines, unicode_trim
from passagework.operators import pivots
from passagework.operators.search import top_k
from passagework.plans.catalog import QUERIES
from passagework.sources.embedders import HashingEmbedder, embedding


def test_pages_are_split_once(spark, tmp_path):
    text = "\n".join(f" line {k} " for k in range(25))
    spark.createDataFrame([(1, text), (2, None), (3, "Licensed")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["parse_line_filters"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1
    assert [(r.doc_id, r.text) for r in out.collect()] == [(1, "".join(f"line {k}\n" for k in range(25)))]


def test_lines_and_trim_follow_their_patterns(spark):
    texts = ["".join(x) for n in range(6) for x in itertools.product("a\r\n", repeat=n)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(lines(F.col("t"))).collect()
    assert [r[0] for r in got] == [re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", t)) for t in texts]
    padded = [f"{a}x {b}y{a}" for a in [*WHITE_SPACE, WHITE_SPACE, "", "\x1c", "​", "᠎", "é", "😀"] for b in (" ", "　\n", "")] + [WHITE_SPACE, ""]
    got = spark.createDataFrame([(t,) for t in padded], "t string").select(unicode_trim(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.strip(WHITE_SPACE) for t in padded]


def test_search_embeds_once(spark):
    docs = spark.createDataFrame([(k, f"word{k} same") for k in range(6)] + [(6, ""), (7, None)], "vec_id long, text string")
    e = HashingEmbedder()
    vectors = docs.select("vec_id", embedding(F.col("text"), e).alias("embedding"))
    for ascending in (False, True):
        found = top_k(vectors, list(e.embed(["word3 same"])[0]), 10, ascending=ascending)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        rows = found.collect()
        assert {r.vec_id for r in rows} == set(range(6)) and rows[-1 if ascending else 0].vec_id == 3
        assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=not ascending)


def test_pruned_search_packs_queries(spark, tmp_path):
    """Queries meet a shard in packed blocks, not as a list of rows; copies and repeated ids beside the query's own."""
    rows = [(k % 300, [float(k % 7), float(k % 3)]) for k in range(1500)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 50 = 0").dropDuplicates(["vec_id", "embedding"]).withColumnRenamed("vec_id", "query_id")
    found = pivots.search(pivots.build(v, f"file://{tmp_path}/index", "euclidean"), asked, 4, skip_own=True)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    want: dict = {}
    for q in asked.collect():
        gaps = sorted((round(math.dist(q.embedding, x), 9), i) for i, x in rows if i != q.query_id)
        want.setdefault(q.query_id, []).append(gaps[:4])
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(sum(x, [])) for q, x in want.items()}
