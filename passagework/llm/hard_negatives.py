"""Hard negatives by branch and bound over ball trees.

Rows are dealt to shards by a hash. In a shard the rows of each label make a ball tree: a node has a centre c, a radius r
and its rows, split in two across the line between two far rows until LEAF are left. For a query q every row x of a node
has q.c - |q| r <= q.x <= q.c + |q| r, so a node is left out if it is wholly over or under the wanted window of scores, or
if even its upper bound is strictly beneath the k-th best score that is known already; equal ones are visited, as ties go
by id. Nodes are visited by descending upper bound. Each shard gives k rows for a query, and these are merged by rank.

Two searches: an anchor's positives are its k best rows of the same label, without a window. Then each of its positives
opens a window of scores, and one walk over the trees of the other labels serves all windows of an anchor. Anchors meet
shards in blocks of bounded size; scores are exact integers.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors whose
length isn't the anchor's are no candidates; rows with the anchor's id are none either, other rows with equal ids all are;
repeated anchor rows count once, those with one id but different vectors or labels are searched one by one; a positive with
a negative score has an empty window; equal scores go by smaller id; scores past
64 bits count as the greatest or the least long; an empty table gives none.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize
from .topk import EXACT, quantized, top_of

#: Anchors of a block, rows of a shard, and rows of a leaf.
BLOCK, SHARD, LEAF = 1024, 8192, 64


class Forest:
    """Ball trees over the rows of a shard, one a label. Rows are put in such an order that every node has a stretch of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        points = rows.astype(np.float64)
        centres, radii, begins, ends, children, self.roots = [], [], [], [], [], {}
        order: list[np.ndarray] = []
        placed = 0
        for label in np.unique(labels).tolist():
            self.roots[label] = len(centres)
            todo = [(np.flatnonzero(labels == label), -1)]
            while todo:
                own, parent = todo.pop()
                k, x = len(centres), points[own]
                centre = x.mean(axis=0)
                away = np.sqrt(((x - centre) ** 2).sum(axis=1))
                centres.append(centre)
                radii.append(away.max())
                children.append([])
                if parent >= 0:
                    children[parent].append(k)
                begins.append(placed)
                ends.append(placed)
                if len(own) <= LEAF or away.max() == 0:
                    order.append(own)
                    placed += len(own)
                    ends[k] = placed
                    continue
                far = x[away.argmax()]
                other = x[((x - far) ** 2).sum(axis=1).argmax()]
                by = np.argsort(x @ (other - far), kind="stable")
                todo += [(own[by[len(by) // 2 :]], k), (own[by[: len(by) // 2]], k)]
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.rows = ids[at], rows[at]
        self.centres, self.radii = np.array(centres).reshape(len(centres), rows.shape[1]), np.array(radii)
        self.begins, self.ends, self.children = begins, ends, children
        self.reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries x nodes): the least and the greatest score that a row of the node may have, a little widened for rounding."""
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        middle, spread = q @ self.centres.T, length * (self.radii + 1e-9 * self.reach) + 1e-6
        return middle - spread, middle + spread

    def scores(self, node: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.begins[node], self.ends[node])
        return self.rows[some] @ query, self.ids[some]


class Best:
    """The k best (score, id) so far, by score and then smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, None, None

    def least(self) -> object | None:
        """The k-th best score, once there are k."""
        return self.scores[-1] if self.scores is not None and len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.scores is not None:
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        top = top_of(scores, ids, self.k) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda x: (-scores[x], ids[x]))[: self.k])
        self.scores, self.ids = scores[top], ids[top]


def walk(forest: Forest, roots: list[int], query: np.ndarray, own_id: int, low: np.ndarray, high: np.ndarray, windows: list[tuple[object, object]], k: int) -> list[Best]:
    """The k best rows of these trees for each window (least, greatest score; None: open), without rows with the own id."""
    best = [Best(k) for _ in windows]
    heap = [(-high[x], x) for x in roots]
    heapq.heapify(heap)
    while heap:
        up, node = heap[0]
        up = -up
        floors = [max((x for x in (lo, b.least()) if x is not None), default=None) for (lo, _), b in zip(windows, best, strict=True)]
        wanted = [f is None or up >= f for f in floors]
        if not any(wanted):
            break  # what is left is beneath every window, or every k-th best
        heapq.heappop(heap)
        wanted = [w and (hi is None or low[node] <= hi) for w, (_, hi) in zip(wanted, windows, strict=True)]
        if not any(wanted):
            continue
        if forest.children[node]:
            for x in forest.children[node]:
                heapq.heappush(heap, (-high[x], x))
            continue
        scores, ids = forest.scores(node, query)
        other = ids != own_id
        for w, f, (_, hi), b in zip(wanted, floors, windows, best, strict=True):
            if w:
                some = other if f is None else other & (scores >= f)
                some = some if hi is None else some & (scores <= hi)
                if some.any():
                    b.add(scores[some], ids[some])
    return best


def _kind(queries: np.ndarray, rows: np.ndarray) -> type:
    """The type in which these integers' inner products are exact."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    return np.float64 if reach < EXACT / 4 else np.int64 if reach < 2**61 else object


def _long(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def _packed(df: DataFrame, group: str, columns: list[str], arrays: list[str]) -> DataFrame:
    """A row for each group and vector length: its number of rows m and each column as little-endian 64-bit integers, arrays
    one after another."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = {"b": [part[group].iloc[0]], "n": [part["n"].iloc[0]], "m": [len(part)]}
        for c in columns:
            out[c] = [part[c].to_numpy().astype("<i8").tobytes()]
        for c in arrays:
            out[c] = [np.concatenate([np.asarray(x, "<i8") for x in part[c]]).astype("<i8").tobytes()]
        return pd.DataFrame(out)

    schema = ", ".join(["b long, n int, m int", *[f"{c} binary" for c in columns + arrays]])
    return df.select(group, "n", *columns, *arrays).groupBy(group, "n").applyInPandas(run, schema)


def _met(candidates: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """Every block of anchors beside every shard of rows of the same length."""
    named = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("q_shard"))
    return candidates.join(named, (F.col("b") == F.col("q_shard")) & (F.col("n") == F.col("q_n")))


def _read(row: dict, name: str, shape: tuple[int, ...] | None = None) -> np.ndarray:
    found = np.frombuffer(row[name], "<i8")
    return found if shape is None else found.reshape(shape)


def _walks(batches: Iterator[pa.RecordBatch], k: int, with_windows: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _met() -> (anchor, positive, place of the anchor's key, id, score): the best rows of the shard."""
    last, forest = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: c[i].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}
            if last != (row["b"], row["n"]):
                last = row["b"], row["n"]
                forest = Forest(_read(row, "id"), _read(row, "label"), _read(row, "v", (row["m"], row["n"])))
            ids, labels, queries = _read(row, "q_id"), _read(row, "q_label"), _read(row, "q_v", (row["q_m"], row["n"]))
            kind = _kind(queries, forest.rows)
            if forest.rows.dtype != kind:
                forest.rows = forest.rows.astype(kind)
            wanted = queries.astype(kind)
            low, high = forest.bounds(queries)
            opened = np.searchsorted(_read(row, "q_place"), np.arange(len(ids) + 1)) if with_windows else None
            out: list[tuple] = []
            for q in range(len(ids)):
                if not with_windows:
                    roots = [r for label, r in forest.roots.items() if label == labels[q]]
                    found = zip([0], walk(forest, roots, wanted[q], ids[q], low[q], high[q], [(None, None)], k), strict=True)
                else:
                    roots = [r for label, r in forest.roots.items() if label != labels[q]]
                    some = slice(opened[q], opened[q + 1])
                    windows = list(zip(_read(row, "q_least")[some].tolist(), _read(row, "q_most")[some].tolist(), strict=True))
                    found = zip(_read(row, "q_window")[some].tolist(), walk(forest, roots, wanted[q], ids[q], low[q], high[q], windows, k), strict=True)
                key = zlib.crc32(queries[q].tobytes() + labels[q].tobytes())
                out += [(ids[q], key, window, b.ids, b.scores) for window, b in found if b.ids is not None]
            if out:
                n = [len(x[3]) for x in out]
                flat = [np.repeat([int(x[c]) for x in out], n) for c in range(3)] + [np.concatenate([x[3] for x in out]), np.concatenate([_long(x[4]) for x in out])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], ["anchor_id", "anchor_key", "window", "id", "score"])


_FOUND = "anchor_id long, anchor_key long, window long, id long, score long"


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the anchor's key, by which equal ids with different vectors are told apart."""
    for part in batches:
        keys = [zlib.crc32(np.asarray(v, "<i8").tobytes() + np.int64(label).tobytes()) for v, label in zip(part["v"], part["label"], strict=True)]
        yield part.assign(key=np.array(keys, np.int64))


def _asked(anchors: DataFrame, positives: DataFrame, blocks: int, window: tuple[int, int, int]) -> DataFrame:
    """Blocks of anchors with the windows of scores that their positives open."""
    least, most, of = window
    own = positives.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # k a row
    p = anchors.join(own, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")))
    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = lambda c: np.asarray(c, "<i8").astype("<i8").tobytes()
        count = [len(x) for x in part["p"]]
        score = [int(x["score"]) for xs in part["p"] for x in xs]
        # least * score <= of * x <= most * score, in whole numbers; a score under 0 opens none
        return pd.DataFrame({
            "b": [part["block"].iloc[0]], "n": [part["n"].iloc[0]], "m": [len(part)], "id": [wide(part["id"])], "label": [wide(part["label"])], "v": [wide(np.concatenate([np.asarray(x, "<i8") for x in part["v"]]))],
            "place": [wide(np.repeat(np.arange(len(part)), count))], "window": [wide([int(x["rank"]) for xs in part["p"] for x in xs])],
            "least": [wide([-(-least * s // of) for s in score])], "most": [wide([most * s // of for s in score])],
        })

    schema = "b long, n int, m int, id binary, label binary, v binary, place binary, window binary, least binary, most binary"
    return p.select("id", "label", "v", "n", "block", "p").groupBy("block", "n").applyInPandas(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, window: tuple[int, int, int] = (30, 90, 100), id_col: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that is_anchor marks and each of
    its best `positives` rows of the same label, the k best rows of other labels whose score is within the window: at least
    window[0] and at most window[1] parts in window[2] of the positive's score."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantized(F.col(vector), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where("id is not null and label is not null and v is not null").withColumn("n", F.size("v"))
    sizes = rows.groupBy("n").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("is_anchor").cast("long")).alias("anchors"))
    total = sizes.agg(F.max("all").alias("all"), F.max("anchors").alias("anchors")).first()
    shards, blocks = max(1, -(-(total["all"] or 0) // SHARD)), max(1, -(-(total["anchors"] or 0) // BLOCK))
    spread = F.xxhash64("id", "v", "label")
    candidates = _packed(rows.withColumn("shard", F.pmod(spread, F.lit(shards))), "shard", ["id", "label"], ["v"])
    anchors = rows.where("is_anchor").select("id", "label", "v", "n").distinct().withColumn("block", F.pmod(spread, F.lit(blocks)))
    anchors = anchors.mapInPandas(_windows_of, "id long, label long, v array<bigint>, n int, block long, key long")
    met = _met(candidates, _packed(anchors, "block", ["id", "label"], ["v"]), shards)
    found = met.mapInArrow(lean(lambda b: _walks(b, positives, False)), _FOUND)
    best = materialize(_ranked(found, ["anchor_id", "anchor_key"], positives).drop("window"), "positives")
    met = _met(candidates, _asked(anchors, best, blocks, window), shards)
    found = met.mapInArrow(lean(lambda b: _walks(b, k, True)), _FOUND)
    negatives = _ranked(found, ["anchor_id", "anchor_key", "window"], k)
    own = best.select(F.col("anchor_id").alias("p_anchor"), F.col("anchor_key").alias("p_key"), F.col("rank").alias("p_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(own, (F.col("anchor_id") == F.col("p_anchor")) & (F.col("anchor_key") == F.col("p_key")) & (F.col("window") == F.col("p_rank")))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
