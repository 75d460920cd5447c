"""Connected components of a link table, by alternating large-star and small-star steps. All native DataFrame code; links
and components stay distributed, and each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, edges["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, with their number and a digest of them, told by the same job."""
    seen = Observation()
    now = materialize(edges, "links", seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("digest"))
    return now, (seen.get["n"], seen.get["digest"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the smallest node that it reaches; other nodes than the
    links' own are absent. Null ends, loops and repeated links are dropped. Rounds go on until the links stay the same, which
    is when each node but a root has one link, to its root."""
    now, before = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        now, after = _written(_small_star(_large_star(now)))
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
