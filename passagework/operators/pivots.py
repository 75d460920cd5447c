"""Exact nearest vectors without scoring all of them: pivot clusters and the triangle inequality.

An index puts each vector beside its nearest pivot, with its distance from it, and packs a cluster's vectors, by that
distance, into shards of SHARD_ROWS at most. For a query at distance t from a pivot, every vector x of the cluster is at least
|t - away(x)| from the query, so a cluster, a shard (a ring around the pivot) or a row whose bound is over the query's k-th
best distance can't enter. Two rounds: each query first searches its best clusters, by their bounds, until they hold k
vectors; what it finds there sets its threshold, and the second round opens only the clusters, rings and rows that
the threshold leaves. Results are those of scoring everything, and `scored` tells how many vectors were.

Queries travel in blocks, once to each group of clusters that one of them opens, and meet the group's shards there.

Pivots come from a bounded sample (SAMPLE vectors about, PIVOTS pivots at most) by a few rounds of k-means; any pivots give
the same results. Distances: euclidean, and for cosine the chord between vectors of length 1.

Ids are longs, integers or strings. Defined results: null ids and vectors, those with null or non-finite components, of another length than the first pivot's,
and for cosine those of length 0, take no part; equal scores go by smaller id; repeated ids are all candidates; fewer than k
candidates are all given; an empty table gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..functions.vectors import doubles
from .chunking import similarities

#: Vectors of the sample, pivots, rows of a shard and queries of a block, at most (sample and blocks: about).
SAMPLE, PIVOTS, SHARD_ROWS, QUERY_BLOCK = 16_384, 1024, 1024, 1024
#: Vectors of a group of clusters, to which a block of queries goes once, at least, and such groups, about: a query is copied
#: to 2 * GROUPS places at most.
GROUP_ROWS, GROUPS = 8192, 64
_SHARD = "cluster int, n int, ids array<{}>, away binary, vectors binary"


@dataclass(frozen=True)
class PivotIndex:
    #: "cosine" or "euclidean".
    name: str
    #: (clusters x length), and by cluster the number of its vectors, their least and greatest distance from the pivot.
    pivots: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    most: np.ndarray
    #: cluster, n, ids, away, vectors: packed rows, by distance from the pivot.
    shards: DataFrame

    @property
    def size(self) -> int:
        return int(self.counts.sum())


def _usable(v: Column, name: str, length: int | None = None) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(v) > 0)
    if name == "cosine":
        ok = ok & F.exists(v, lambda x: x != 0)
    return ok if length is None else ok & (F.size(v) == length)


def _points(v: np.ndarray, name: str) -> np.ndarray:
    """Where the vectors stand, for distances."""
    return v / np.sqrt((v * v).sum(axis=1))[:, None] if name == "cosine" else v


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _means(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """k pivots, or fewer: k-means from evenly spread rows of the sample."""
    pivots = np.unique(sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)], axis=0)
    for _ in range(rounds):
        near = np.concatenate([_distances(sample[i : i + 4096], pivots).argmin(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(pivots))
        pivots = sums[count > 0] / count[count > 0][:, None]
    return pivots


def build(vectors: DataFrame, place: str, name: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> PivotIndex:
    """The index of these vectors; its shards are written to the folder `place`, which executors share."""
    if name not in ("cosine", "euclidean"):
        raise InvalidConfig(f"no index for {name}")
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    shard = _SHARD.format(kind)
    rows = vectors.select(F.col(id_col).alias("id"), doubles(F.col(vector)).alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v"), name))
    total, length = rows.agg(F.count(F.lit(1)), F.min(F.struct(F.xxhash64("id").alias("h"), F.size("v").alias("n")))["n"]).first()
    if not total:
        return PivotIndex(name, np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), spark.createDataFrame([], shard))
    rows = rows.where(F.size("v") == length)
    share = max(1, total // SAMPLE)
    sample = rows.where((F.pmod(F.xxhash64("id"), F.lit(share)) == 0) | F.lit(share == 1)).orderBy(F.xxhash64("id", "v")).limit(2 * SAMPLE).select("v").toArrow()["v"]
    pivots = _means(_points(_matrix(sample), name), min(PIVOTS, max(1, int(total**0.5)))) if len(sample) else np.zeros((1, length))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                if part.num_rows:
                    away = _distances(_points(_matrix(part.column(1)), name), pivots)
                    near = away.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], ["id", "v", "cluster", "away"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                now = [np.array(batch.column(0).to_pylist()), _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is None:
                continue
            ids, v, cluster, away = held
            edges = np.concatenate([[0], np.flatnonzero(cluster[1:] != cluster[:-1]) + 1, [len(ids)]])
            done = 0
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                last = batch is not None and j == len(ids)  # more of this cluster may come
                for a in range(i, j, SHARD_ROWS):
                    b = min(a + SHARD_ROWS, j)
                    if last and b - a < SHARD_ROWS:
                        break
                    done = b
                    whole = [pa.array([int(cluster[a])], pa.int32()), pa.array([b - a], pa.int32()), pa.array([ids[a:b].tolist()])]
                    yield pa.RecordBatch.from_arrays([*whole, *[pa.array([x[a:b].astype("<f8").tobytes()]) for x in (away, v)]], ["cluster", "n", "ids", "away", "vectors"])
            held = [x[done:].copy() for x in held]
            held = held if len(held[0]) else None

    assigned = rows.mapInArrow(assign, f"id {kind}, v array<double>, cluster int, away double")
    assigned.repartitionByRange("cluster", "away").sortWithinPartitions("cluster", "away").mapInArrow(pack, shard).write.parquet(place)
    shards = spark.read.schema(shard).parquet(place)
    counts, least, most = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.zeros(len(pivots))
    for r in shards.select("cluster", "n", *_ends()).groupBy("cluster").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect():  # a row for each pivot
        counts[r.cluster], least[r.cluster], most[r.cluster] = r.n, r.first, r.last
    return PivotIndex(name, pivots, counts, least, most, shards)


def _ends() -> list[Column]:
    """The least and greatest distance of a shard, which is sorted by it."""

    @F.pandas_udf("first double, last double")
    def ends(away):
        import pandas as pd

        both = [np.frombuffer(x, "<f8")[[0, -1]] for x in away]
        return pd.DataFrame({"first": [x[0] for x in both], "last": [x[1] for x in both]})

    both = ends(F.col("away"))
    return [both["first"].alias("first"), both["last"].alias("last")]


def _scores(name: str, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return similarities(name, rows, query, None)


def search(index: PivotIndex, queries: DataFrame, k: int = 5, vector: str = "embedding", query_id: str = "query_id", id_col: str = "vec_id", skip_own: bool = False) -> DataFrame:
    """query_id, rank, id, score, scored, of: the k nearest vectors of each query, ties by id, and how many of all vectors
    were scored for it. skip_own leaves out rows with the query's id."""
    name, pivots, counts, least, most = index.name, index.pivots, index.counts, index.least, index.most
    spark, asker, kind = queries.sparkSession, queries.schema[query_id].dataType.simpleString(), index.shards.schema["ids"].dataType.elementType.simpleString()
    if not index.size:
        return spark.createDataFrame([], f"query_id {asker}, rank int, {id_col} {kind}, score double, scored long, of long")
    asked = queries.select(F.col(query_id).alias("q"), doubles(F.col(vector)).alias("v"))
    asked = asked.where(F.col("q").isNotNull() & _usable(F.col("v"), name, pivots.shape[1])).distinct().withColumn("key", F.xxhash64("v"))
    slack = 1e-6 * float((np.sqrt((pivots * pivots).sum(axis=1)) + most).max())  # for rounding of distances
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    q_type, id_type = (pa.string() if x == "string" else pa.int32() if x == "int" else pa.int64() for x in (asker, kind))
    closest_first = name == "cosine"  # higher scores are nearer
    rows_of_group = max(GROUP_ROWS, -(-index.size // GROUPS))
    _, begins, group = np.unique((np.cumsum(counts) - counts) // rows_of_group, return_index=True, return_inverse=True)
    slices = np.maximum(1, -(-np.bincount(group, counts).astype(np.int64) // rows_of_group))  # of a large cluster's shards
    of_cluster = lambda x: F.element_at(F.lit(x.astype(np.int32).tolist()), F.col("cluster") + 1)

    packed = "g int, slice int, q array<{}>, key array<long>, v binary, t binary, upto binary".format(asker)

    def probes(again: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """(q, v, key, far) -> the queries that open clusters of a group, packed, with their distances from each of its pivots (none
        where they don't open the cluster): by their bounds the first that hold k vectors; again: of the others those that `far`
        leaves."""
        need = k + skip_own

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, QUERY_BLOCK):
                    q, v, key, far = batch.slice(i, QUERY_BLOCK).columns
                    v, far = _matrix(v), far.to_numpy()
                    t = _distances(_points(v, name), pivots)
                    bound = np.maximum(np.maximum(t - most, least - t), 0)
                    bound[:, counts == 0] = np.inf
                    order = np.lexsort((t, bound), axis=1)
                    held = np.empty_like(order)
                    np.put_along_axis(held, order, np.cumsum(counts[order], axis=1) - counts[order], axis=1)
                    opens = (counts > 0) & ((held >= need) & (bound <= far[:, None] + slack) if again else held < need)
                    t[~opens] = np.nan
                    for g, (i, j) in enumerate(zip(begins.tolist(), [*begins[1:].tolist(), len(counts)], strict=True)):
                        some = np.flatnonzero(opens[:, i:j].any(axis=1))
                        if not len(some):
                            continue
                        data = [pa.array([x.tobytes()]) for x in (v[some], t[some, i:j], far[some])]
                        asking = [pa.array([x.take(pa.array(some)).to_pylist()], pa.list_(x.type)) for x in (q, key)]
                        for m in range(int(slices[g])):
                            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([m], pa.int32()), *asking, *data], ["g", "slice", "q", "key", "v", "t", "upto"])

        return run

    def opened(pairs: DataFrame) -> DataFrame:
        """Packed queries -> (q, key, id, score, distance, scored): the k best of each query in each shard; how many were scored
        comes in rows by themselves."""
        own = index.shards.withColumn("s_g", of_cluster(group)).withColumn("s_slice", F.pmod(F.xxhash64("ids"), of_cluster(slices[group])).cast("int"))
        # what was packed is far larger than Spark takes it for: it would be broadcast
        met = pairs.hint("merge").join(own, (F.col("g") == F.col("s_g")) & (F.col("slice") == F.col("s_slice"))).select("cluster", "n", "ids", "away", "vectors", "q", "key", "v", "t", "upto")
        columns, kinds = ["q", "key", "id", "score", "distance", "scored"], (q_type, pa.int64(), id_type, pa.float64(), pa.float64(), pa.int64())

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], columns)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scored: dict[tuple, int] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    cluster, n, ids, away, data, q, key, v, t, upto = (c[r].as_py() for c in batch.columns)
                    away, t, upto = (np.frombuffer(x, "<f8") for x in (away, t, upto))
                    t = t.reshape(len(q), -1)[:, cluster - begins[group[cluster]]]
                    open_ = np.flatnonzero(~np.isnan(t))
                    if not len(open_):
                        continue
                    ids, rows, queries = np.array(ids), np.frombuffer(data, "<f8").reshape(n, -1), np.frombuffer(v, "<f8").reshape(len(q), -1)[open_]
                    q, key, t, upto = [q[x] for x in open_.tolist()], [key[x] for x in open_.tolist()], t[open_], upto[open_]
                    first, last = np.searchsorted(away, t - upto - slack), np.searchsorted(away, t + upto + slack, "right")
                    points, out = _points(rows, name), []
                    for i in range(0, len(q), 128):  # 128 x SHARD_ROWS distances at once
                        gaps = _distances(_points(queries[i : i + 128], name), points)
                        for j in range(i, min(i + 128, len(q))):
                            a, b = int(first[j]), int(last[j])
                            if a >= b:
                                continue
                            scored[q[j], key[j]] = scored.get((q[j], key[j]), 0) + b - a
                            # a candidate is no farther than the threshold and the k-th best here, but for rounding
                            gap = gaps[j - i, a:b]
                            near = np.flatnonzero(gap <= upto[j] + slack)
                            if skip_own:
                                near = near[ids[a:b][near] != q[j]]
                            if len(near) > k:
                                near = near[gap[near] <= np.partition(gap[near], k - 1)[k - 1] + 2 * slack]
                            if not len(near):
                                continue
                            own = ids[a:b][near]
                            s = _scores(name, rows[a:b][near], queries[j])
                            known = np.flatnonzero(~np.isnan(s))
                            top = known[np.lexsort((own[known], -s[known] if closest_first else s[known]))[:k]]
                            out += [(q[j], key[j], *x, 0) for x in zip(own[top].tolist(), s[top].tolist(), gap[near[top]].tolist(), strict=True)]
                    if out:
                        yield batch_of(out)
                    if len(scored) > 1 << 16:
                        yield batch_of([(*x, None, None, None, m) for x, m in scored.items()])
                        scored = {}
            if scored:
                yield batch_of([(*x, None, None, None, m) for x, m in scored.items()])

        return met.mapInArrow(score, f"q {asker}, key long, id {kind}, score double, distance double, scored long")

    nearer = F.col("score").desc() if closest_first else F.col("score").asc()
    order = Window.partitionBy("q", "key").orderBy(nearer, "id")
    everything = F.lit(float("inf"))
    asked = asked.repartition(blocks, "key")
    one = opened(asked.withColumn("far", everything).mapInArrow(probes(False), packed))
    kth = one.where("id is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy(F.col("q").alias("k_q"), F.col("key").alias("k_key")).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    limits = kth.select("k_q", "k_key", F.when(F.col("n") == k, F.col("far")).otherwise(everything).alias("far"))
    rest = asked.join(limits.hint("merge"), (F.col("q") == F.col("k_q")) & (F.col("key") == F.col("k_key")), "left").select("q", "v", "key", F.coalesce("far", everything).alias("far"))
    two = opened(rest.repartition(blocks, "key").mapInArrow(probes(True), packed))
    both = one.unionByName(two)
    scored = F.sum("scored").over(Window.partitionBy("q", "key"))
    ranked = both.withColumn("scored", scored).where("id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score", "scored", F.lit(index.size).cast("long").alias("of"))


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder for an index in the one that executors share."""
    from ..sources.tables import new_base

    return f"{new_base(spark)}-{name}"
