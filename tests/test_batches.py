"""Functions of batches, by slices of them; similarities at a threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.config import Semantic, Snapping
from passagework.functions.batches import in_slices, slices
from passagework.operators import chunking


def test_slices_hold_bounded_bytes_and_all_rows():
    texts = ["a" * 100, None, "", "b" * 5000, *["c" * 90] * 50]
    parts = [p.to_pylist() for p in slices(pa.array(texts), 1000)]
    assert [x for p in parts for x in p] == texts
    assert all(len(p) == 1 or sum(len(x or "") + 8 for x in p) <= 1000 for p in parts)
    assert list(slices(pa.array([], pa.string()))) == []
    assert [p.to_pylist() for p in slices(pa.array(texts).slice(3, 2), 1000)] == [texts[3:4], texts[4:5]]
    assert [p.to_pylist() for p in slices(pa.array([b"x" * 9, b"y"]), 1)] == [[b"x" * 9], [b"y"]]


def test_an_embedder_gets_a_part_of_a_batch(spark):
    """The texts of a batch, 3 MB here, were groups and vectors all at once."""
    most = 1 << 20

    def embed(parts: list[str]) -> np.ndarray:
        if sum(map(len, parts)) > most:
            raise AssertionError("a whole batch")
        return np.ones((len(parts), 2))

    df = spark.range(0, 300, 1, 1).select("id", F.repeat(F.concat(F.lit("Some words "), "id", F.lit(". ")), 700).alias("text"))
    out = df.select("id", chunking.semantic(F.col("text"), Semantic(threshold=0.5), embed).alias("c")).orderBy("id").collect()
    assert [(len(r.c), r.c[0].startswith(f"Some words {r.id}. ")) for r in out] == [(1, True)] * 300


@pytest.mark.parametrize("n", [0, 1, 40])
def test_rows_keep_their_order_and_nulls(spark, n):
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else f"Ab {i}. Cd. " * 5000) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    got = df.select("i", chunking.snapping(F.col("t"), Snapping(1000, 1)).alias("a"), in_slices(F.col("t"), lambda x: [t and t[:5] for t in x], "string", pa.string()).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(None, None) if t is None else (chunking.snap(t, Snapping(1000, 1)), t[:5]) for _, t in rows]


def test_a_cosine_at_the_threshold_joins_as_in_sql():
    """0.5 but for rounding: the SQL rounds cosines to 12 decimals."""
    under = np.array([[1.0, 0.0], [0.5 - 1e-14, np.sqrt(0.75)]])
    assert chunking.similarities("cosine", under[:1], under[1])[0] < 0.5
    assert chunking.cluster(["a. ", "b."], under, Semantic(threshold=0.5)) == ["a. b."]
    far = np.array([[1.0, 0.0], [0.5 - 1e-9, np.sqrt(0.75)]])
    assert chunking.cluster(["a. ", "b."], far, Semantic(threshold=0.5)) == ["a. ", "b."]


def test_results_go_out_slice_by_slice():
    """None is kept until its batch ends; a batch without rows gives none."""
    from passagework.functions import batches

    seen = []
    texts = pa.array(["a" * batches.SLICE, None, "b" * batches.SLICE, "c"])
    out = batches.by_slices(iter([pa.array([], pa.string()), texts]), lambda x: seen.append(len(x)) or [[t or ""] for t in x], pa.list_(pa.string()))
    first = next(out)
    assert len(seen) == 1 and len(first) == seen[0] < len(texts)
    rest = list(out)
    assert pa.concat_arrays([first, *rest]).to_pylist() == [[t or ""] for t in texts.to_pylist()]


def test_garbage_is_not_sought_among_modules_after_each_task():
    import gc

    from passagework.llm.common import lean

    assert list(lean(iter)(iter([1]))) == [1] and gc.get_freeze_count() > 1000


def test_near_duplicates_take_text_apart_in_small_slices():
    """A megabyte of text was hashed and sorted at once in each worker."""
    from passagework.llm import simhash

    texts = [" ".join(f"w{k}-{i}" for i in range(20_000)) for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["key", "text"])
    out = list(simhash._prefixes(iter([batch]), np.zeros(0, np.uint64)))
    assert len(out) == 4 and sorted({k for b in out for k in b.column(1).to_pylist()}) == [0, 1, 2, 3]
    both = pa.RecordBatch.from_arrays([pa.array(range(4)), *batch.columns], ["doc_id", "key", "text"])
    assert [b.num_rows for b in simhash._marks(iter([both]))] == [1] * 4
