"""What the sample that orders shingles finds in tables that are far larger than it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import bottomk, common, simhash
from passagework.llm.common import is_in

PASSAGE = "all of these documents hold this very same passage besides their own words so that many lists meet where nothing else of any two texts is alike"


def _docs(spark, n: int = 2000, every: int = 20):
    """Texts of their own words; one of `every` holds the passage."""
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("w"), F.col("id"), F.lit("x"), k)), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", own, F.when(F.col("id") % every == 0, PASSAGE)).alias("text"))


def _small(monkeypatch, module) -> None:
    monkeypatch.setattr(module, "SAMPLE", 20)
    monkeypatch.setattr(module, "FREQUENT", 2)
    monkeypatch.setattr(module, "HOT", 8)


def test_values_of_more_than_hot_documents_are_retained_last_at_any_size(spark, monkeypatch):
    _small(monkeypatch, bottomk)
    raw = np.frombuffer(PASSAGE.encode(), np.uint8)
    of_passage = bottomk.sets_of(raw, np.array([0, len(raw)]), 3)[0]
    assert np.isin(of_passage, bottomk.frequent(_docs(spark), 3)).all()


def test_documents_that_share_a_passage_are_no_family(spark, monkeypatch):
    """A hundred documents with one passage met in lists over HOT, which made them one family, compared pair by pair."""
    _small(monkeypatch, bottomk)
    kept, sizes = bottomk.materialize, []

    def told(df, name, *rest):
        out = kept(df, name, *rest)
        if name == "members" and "comp" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(bottomk, "materialize", told)
    found = bottomk.near_duplicates(_docs(spark)).collect()
    assert len(found) == 2000 and all(r.kept and r.component_id == r.doc_id for r in found)
    assert sizes == [0]


def test_shingles_of_more_than_hot_documents_are_looked_at_last_at_any_size(spark, monkeypatch):
    _small(monkeypatch, simhash)
    raw = np.frombuffer(PASSAGE.encode(), np.uint8)
    of_passage = simhash.shingle_sets(raw, np.array([0, len(raw)]))[0]
    docs = _docs(spark).withColumn("key", F.xxhash64("text"))
    assert np.isin(of_passage, simhash._frequent(docs)).all()


@pytest.mark.parametrize("some", [[], [5], [1, 5, 9]])
def test_is_in(some):
    values, some = np.array([9, 0, 5, 2**63], np.uint64), np.array(some, np.uint64)
    assert is_in(values, some).tolist() == np.isin(values, some).tolist()


def test_lists_and_retained_values_go_when_used_up(spark, monkeypatch):
    """They stayed on disk to the end."""
    gone, discard = [], bottomk.discard
    monkeypatch.setattr(bottomk, "discard", lambda t: (gone.append(set(t.columns)), discard(t)))
    df = spark.createDataFrame([(k, f"one two three four {k % 3}") for k in range(6)], "doc_id long, text string")
    assert {r.component_id for r in bottomk.near_duplicates(df).collect()} == {0, 1, 2}
    assert {"v", "key"} in gone and {"key", "n", "low", "retained", "rep"} in gone


def _half_common(n: int = 60) -> list[str]:
    """Texts that have nothing in common but runs of short words."""
    r = np.random.default_rng(8)
    return [" ".join([*r.choice(["a", "of", "to", "in"], 40), *(f"{r.integers(10**9)}longer" for _ in range(40))]) for _ in range(n)]


def test_lists_of_unlike_texts_do_not_grow_with_the_table(spark):
    """Values were retained in the order of hashes: texts met by each run of short words, the more the larger the table."""
    rule = bottomk.Rule(3, 85, 100)
    df = spark.createDataFrame(list(enumerate(_half_common())), "doc_id long, text string")
    marks = df.mapInArrow(bottomk._marks(rule, np.zeros(0, np.uint64)), "doc_id long, key long, n long, low binary, retained array<bigint>")
    assert bottomk.met_lists(bottomk.materialize(marks, "classes"), rule).count() == 0


def test_prefixes_of_unlike_texts_do_not_meet():
    import pyarrow as pa

    texts = _half_common()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    found = [x for out in simhash._prefixes(iter([batch]), np.zeros(0, np.uint64)) for x in out.column(0).to_pylist()]
    assert len(found) == len(set(found)) > 0


def test_the_sample_decides_an_order_alone(spark, monkeypatch):
    """Whatever the sample calls frequent, all documents are compared and the links are the same."""
    texts = [" ".join(f"{w}{k // 3}" for w in PASSAGE.split()) + f" {PASSAGE}" + (" more" if k % 3 == 1 else "") for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for share, frequent in ((1, 2), (1, 1000), (7, 1), (10**9, 1)):
        monkeypatch.setattr(bottomk, "sampled", lambda n, s=share: s)
        monkeypatch.setattr(bottomk, "FREQUENT", frequent)
        found.append(sorted((r.doc_id, r.component_id) for r in bottomk.near_duplicates(df).collect()))
    assert found == [[(k, k - k % 3) for k in range(30)]] * 4


def test_texts_that_no_join_needs_are_told_before_it(spark):
    """All texts were shuffled and sorted to meet a few ids; a row goes to one side, and none whose key is there is missed."""
    rows = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), F.lit("text").alias("text"))
    some = spark.createDataFrame([(k,) for k in range(0, 5000, 50)] + [(None,)], "k long")
    may, other = common.marked(rows, F.xxhash64("id"), some, F.xxhash64("k"))
    wanted = [r.id for r in rows.collect() if r.id is None or r.id % 50 == 0]
    got, rest = [r.id for r in may.collect()], [r.id for r in other.collect()]
    assert sorted(map(str, wanted)) == sorted(str(x) for x in got if x is None or x % 50 == 0)
    assert len(got) + len(rest) == 5000 and len(got) < len(wanted) + 5
    none = common.marked(rows, F.xxhash64("id"), some.where("false"), F.xxhash64("k"))
    assert none[0].isEmpty() and none[1].count() == 5000
