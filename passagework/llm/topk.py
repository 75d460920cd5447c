"""Exact top-k search by inner product with MaxScore over shards.

Terms are the components of a vector; the posting list of a term holds that component of every candidate of a shard.
Shifted by its least possible value, a term's contribution to a query's score is never negative and at most the term's
bound. Terms are sorted by bound. While a query's threshold (its k-th best score so far) exceeds the sum of the smallest
bounds, those terms are non-essential: a candidate can only enter by its essential terms. Essential postings are
traversed in full; the others are probed term by term, and only for candidates whose partial score plus the bounds
still missing reaches the threshold. Shards give k rows for each query, which are merged by rank.

Queries and candidates meet in blocks of bounded size: a block of queries goes to every shard. Scores are integers and
exact: products run in doubles only while all partial sums stay below 2**53, otherwise in 64-bit integers, and where
those could overflow, in Python integers.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors whose length isn't
the query's are not its candidates; rows with a null id are candidates of nothing and no queries; rows with equal ids
are all candidates, except for the queries with that id, and queries once for each of their vectors; equal scores go by smaller id; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

#: Queries of a block, candidates of a shard, and candidates that give the first threshold.
QUERY_BLOCK, SHARD, SEEDS = 1024, 8192, 256
EXACT = float(2**53)


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale)))


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids, in that order."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def maxscore(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, candidates' places, scores): the k best of this shard for each query.

    queries (q x terms), rows (candidates x terms): integers; where sums could pass 2**63, arrays of Python integers.
    """
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float64 if reach < EXACT / 4 else np.int64 if reach < 2**61 else object
    lists = np.ascontiguousarray(rows.T.astype(kind))  # posting lists, term by term
    low, high = lists.min(axis=1), lists.max(axis=1)
    order_of_ids = np.argsort(ids, kind="stable")
    sorted_ids = ids[order_of_ids]
    own = [order_of_ids[np.searchsorted(sorted_ids, x) : np.searchsorted(sorted_ids, x, "right")] for x in query_ids]
    wanted = queries.astype(kind)
    seeds = min(len(ids), max(SEEDS, 4 * k))
    seed_scores = wanted @ lists[:, :seeds]
    least = np.minimum(wanted * low, wanted * high)
    bounds = np.maximum(wanted * low, wanted * high) - least
    for q in range(len(wanted)):
        start = np.delete(seed_scores[q], own[q][own[q] < seeds])
        threshold = np.sort(start)[-k] if len(start) >= k else None
        terms = np.argsort(-bounds[q].astype(np.float64), kind="stable")  # essential ones first
        still = np.concatenate([np.cumsum(bounds[q][terms][::-1])[::-1], [0]])  # bounds of the terms from here on
        floor = least[q].sum()
        essential = len(terms)
        if threshold is not None:
            while essential and floor + still[essential - 1] < threshold:
                essential -= 1
        first = terms[:essential]
        # partial scores: essential terms in full, the others at their least
        partial = wanted[q][first] @ lists[first] + least[q][terms[essential:]].sum()
        alive = np.ones(len(ids), bool)
        alive[own[q]] = False
        if threshold is not None:
            alive &= partial + still[essential] >= threshold
        at = np.flatnonzero(alive)
        partial = partial[at]
        for j in range(essential, len(terms)):
            t = terms[j]
            partial = partial + (wanted[q][t] * lists[t][at] - least[q][t])
            keep = partial + still[j + 1] >= threshold
            if not keep.all():
                at, partial = at[keep], partial[keep]
        best = top_of(partial, ids[at], k) if len(at) else np.zeros(0, np.int64)
        yield q, at[best], partial[best]


def _packed(df: DataFrame, group: str) -> DataFrame:
    """A row for each group and vector length: ids and components, as little-endian 64-bit integers."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        flat = np.concatenate(part["v"].to_numpy()).astype("<i8") if part["n"].iloc[0] else np.zeros(0, "<i8")
        return pd.DataFrame({"b": [part[group].iloc[0]], "n": [part["n"].iloc[0]], "ids": [part["id"].to_numpy().astype("<i8").tobytes()], "flat": [flat.tobytes()]})

    return df.groupBy(group, "n").applyInPandas(run, "b long, n int, ids binary, flat binary")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query marks, its k best among all other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).withColumn("n", F.size("v"))
    sizes = rows.groupBy("n").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("is_query").cast("long")).alias("queries"))
    total = sizes.agg(F.max("all").alias("all"), F.max("queries").alias("queries")).first()
    shards, blocks = max(1, -(-(total["all"] or 0) // SHARD)), max(1, -(-(total["queries"] or 0) // QUERY_BLOCK))
    spread = F.xxhash64("id", "v")  # also tells rows with equal ids apart
    candidates = _packed(rows.withColumn("shard", F.pmod(spread, F.lit(shards))), "shard").withColumnRenamed("b", "shard")
    asked = _packed(rows.where("is_query").select("id", "v", "n").distinct().withColumn("block", F.pmod(spread, F.lit(blocks))), "block")
    asked = asked.select(F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("flat").alias("qflat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("qshard"))
    met = candidates.join(asked, (F.col("shard") == F.col("qshard")) & (F.col("n") == F.col("qn"))).select("n", "ids", "flat", "qids", "qflat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                n, ids, flat, qids, qflat = (c[r].as_py() for c in b.columns)
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                data, asked_data = np.frombuffer(flat, "<i8").reshape(len(ids), n), np.frombuffer(qflat, "<i8").reshape(len(qids), n)
                out: list[tuple[np.ndarray, ...]] = []
                for q, at, scores in maxscore(asked_data, qids, data, ids, k):
                    out.append((np.full(len(at), qids[q]), np.full(len(at), zlib.crc32(asked_data[q].tobytes())), ids[at], scores.astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["query_id", "query_key", "vec_id", "score"])

    found = met.mapInArrow(lean(run), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
