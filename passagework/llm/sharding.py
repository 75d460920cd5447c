"""Minimax contiguous sharding of atomic groups.

Groups (rows with equal texts) are ordered by a 64-bit hash and cut into contiguous shards so that the largest shard is
as small as any contiguous partition allows. The smallest feasible capacity is found by binary search; a capacity is
feasible if greedy filling needs no more shards than there are. The driver holds sums of hash ranges ("cells"), never
rows or groups: 2**16 cells at first, and those that a cut may fall into are split further until every cut stands
between two groups. All row work is native DataFrame code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize, text_or_empty

FIRST_BITS, MORE_BITS, CELLS_AT_ONCE = 16, 12, 256


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Numbers of cells before each cut when shards are filled in order up to capacity; None if they don't suffice.

    ends: running sums of the cells' sizes.
    """
    cuts, done, at = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, "right"))
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
        done = int(ends[at - 1]) if at else 0
    return None


def smallest_capacity(sizes: np.ndarray, shards: int, low: int = 0) -> int:
    """Binary search for the least capacity with which greedy filling of ordered atomic sizes needs at most `shards`."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    low, high = max(low, -(-total // shards), int(sizes.max())), total
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _uncertain(cells: list[list[int]], shards: int, low: int, high: int) -> list[int]:
    """Cells of several groups into which a cut may fall for some capacity from low to high."""
    sizes = np.array([c[2] for c in cells], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total, early, late, found = int(ends[-1]), 0, 0, set()
    for _ in range(shards - 1):
        i = int(np.searchsorted(ends, early + low, "right"))
        j = int(np.searchsorted(ends, late + high, "right"))
        if i >= len(cells):
            break
        early = int(starts[i])
        upto = min(j, len(cells) - 1)
        found.update(k for k in range(i, upto + 1) if cells[k][3] > 1)
        late = total if j >= len(cells) else int(ends[j]) if cells[j][3] > 1 else int(starts[j])
    return sorted(found)


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First group hashes of the shards 1, 2, ... and the capacity. groups: gid long, size long, a row for each group.

    Returned are at most shards - 1 hashes; a shard that gets nothing has the hash None.
    """
    sums = [F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.min("gid").alias("lo"), F.max("gid").alias("hi")]
    rows = groups.groupBy(F.shiftright("gid", 64 - FIRST_BITS).alias("cell")).agg(*sums).collect()  # 2**16 rows at most
    if not rows:
        return [], 0
    cells = sorted([r.lo, r.hi, int(r["size"]), int(r.n), FIRST_BITS] for r in rows)
    largest = max(int(r.most) for r in rows)
    total = sum(c[2] for c in cells)
    low = max(-(-total // shards), largest)
    while True:
        sizes = np.array([c[2] for c in cells], np.int64)
        high = smallest_capacity(sizes, shards, low)
        split = _uncertain(cells, shards, low, high)[:CELLS_AT_ONCE]
        if not split:
            break
        parts, kept = [], [c for k, c in enumerate(cells) if k not in set(split)]
        by_bits: dict[int, list[list[int]]] = {}
        for k in split:
            by_bits.setdefault(cells[k][4], []).append(cells[k])
        for bits, some in by_bits.items():
            finer = min(64, bits + MORE_BITS)
            some_ids = [c[0] >> (64 - bits) for c in some]
            inside = groups.where(F.shiftright("gid", 64 - bits).isin(some_ids))
            parts += [[r.lo, r.hi, int(r["size"]), int(r.n), finer] for r in inside.groupBy(F.shiftright("gid", 64 - finer).alias("cell")).agg(*sums).collect()]
        cells = sorted(kept + parts)
    cuts = greedy(np.cumsum(sizes), high, shards) or []
    return [cells[c][0] if c < len(cells) else None for c in cuts[: shards - 1]], high


def shard_of(gid: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for c in cuts:
        if c is not None:
            out = out + F.when(gid >= F.lit(c), 1).otherwise(0)
    return out.cast("int")


def minimax_shards(df: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of df in contiguous shards of nearly equal bytes; rows with equal texts share a shard.

    Returns id, size (UTF-8 bytes plus 1; a null text counts as empty), text_crc32, group_hash, shard and slot (0, 1, ...
    in each shard). Other columns of df, whatever their names, are not read. Null ids and repeated rows are kept as they
    are; an empty table gives an empty result. Cost: one scan of the texts, then rows of a few dozen bytes.
    """
    body = text_or_empty(text)
    base = materialize(
        df.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("group_hash")),
        "sharding",
    )
    groups = base.groupBy(F.col("group_hash").alias("gid")).agg(F.sum("size").alias("size"))
    cuts, _ = plan_cuts(groups, shards)
    placed = base.withColumn("shard", shard_of(F.col("group_hash"), cuts))
    return gapless_rank(placed, ["shard"], ["doc_id", "group_hash"], "slot")
