"""Exact nearest vectors: one query, and many queries at once.

One query is a literal, so the scan scores rows in place and keeps k of them in each task. Many queries are packed into
blocks of about QUERY_BLOCK rows and the vectors into shards where they are scanned; each shard meets each block, and k rows
of a query come out of each. The blocks are broadcast if they are no larger than BROADCAST_BYTES together, else joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, similarity
from .chunking import similarities

QUERY_BLOCK, SHARD_ROWS, BROADCAST_BYTES = 1024, 8192, 64 << 20


def top_k(vectors: DataFrame, query: list[float], k: int = 5, name: str = "cosine", p: int | None = None, id_col: str = "vec_id", vector: str = "embedding", ascending: bool = False) -> DataFrame:
    """The k rows with the highest (ascending: lowest) similarity to the query, ties by id, with `score`."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", similarity(name, doubles(F.col(vector)), target, p))
    # nulls go last and are dropped from the k rows: a filter before would compute the score, and what it is made of, once more
    return scored.orderBy(F.asc_nulls_last("score") if ascending else F.desc_nulls_last("score"), id_col).limit(k).where("score is not null")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of `width` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(rows: DataFrame, limit: int) -> DataFrame:
    """(id, v) -> (width, ids, vectors): at most `limit` rows with vectors of one width, as little-endian bytes. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, limit):
                ids, v = batch.slice(i, limit).columns
                widths = v.value_lengths().to_numpy(zero_copy_only=False)
                for width in np.unique(widths).tolist():
                    of = pa.array(widths == width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32()), pa.array([ids.filter(of).to_numpy().astype("<i8").tobytes()]), pa.array([_matrix(v.filter(of), width).astype("<f8").tobytes()])], ["width", "ids", "vectors"]
                    )

    return rows.mapInArrow(run, "width int, ids binary, vectors binary")


def top_k_of_many(vectors: DataFrame, queries: DataFrame, k: int = 5, name: str = "cosine", p: int | None = None, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """query_id, rank, id, score: the k nearest rows of each query (columns query_id and `vector`), ties by id.

    A query meets the vectors of its own length; null ids and vectors, and those that hold a null, take no part.
    """

    def rows(df: DataFrame, key: str) -> DataFrame:
        some = df.select(F.col(key).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))
        return some.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    asked = rows(queries, query_id)
    n, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // QUERY_BLOCK))
    dealt = _packed(asked.repartition(blocks, F.xxhash64("id")), QUERY_BLOCK).select(F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    if n * (longest or 0) * 8 <= BROADCAST_BYTES:
        dealt = F.broadcast(dealt)
    met = _packed(rows(vectors, id_col), SHARD_ROWS).join(dealt, F.col("width") == F.col("q_width"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, data, _, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, asked_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                shard, some = (np.frombuffer(x, "<f8").reshape(-1, width) for x in (data, q_data))
                out = []
                for q, v in zip(asked_ids.tolist(), some, strict=True):
                    score = similarities(name, shard, v, p)
                    known = np.flatnonzero(~np.isnan(score))
                    order = known[np.lexsort((keys[known], -score[known]))[:k]]
                    out.append((np.full(len(order), q), keys[order], score[order]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "score"])

    found = met.mapInArrow(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
