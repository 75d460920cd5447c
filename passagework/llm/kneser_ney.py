"""Interpolated modified Kneser-Ney model over byte n-grams, and documents' perplexities by sharded count joins.

Trained on trusted documents (labelled quality 1), all of them but every LEFT_OUT-th by a hash of the id, whose
perplexities, of texts that the model has not seen, set the thresholds. Documents are dealt into blocks by a hash of their ids.
One pass over the blocks gives each block's distinct n-grams with their counts in its trusted documents. Counts of all
blocks are summed by n-gram, which shards them; the lower orders' continuation counts, discounts, and interpolated
probabilities follow order by order, joined by n-gram. The probabilities go back to the blocks that need them (a row for
each block and distinct n-gram, not for each occurrence), and a second pass over the blocks sums them up by document.
Nothing of the model is broadcast or collected but the three discounts of each order.

A document is rejected if its perplexity exceeds its language's threshold: the quantile over the trusted documents of that
language that were left out; a language with fewer than LEAST of them takes the threshold over all that were left out.

Defined results: null and empty texts have a null perplexity and are rejected; null or repeated labels: a document is
trusted if its least label is 1; rows with equal ids are each scored; a null language counts as one of its own; without
trusted documents every perplexity is that of the uniform distribution (256) and nothing but empty texts is rejected;
where no trusted document is left out, those that the model has seen set the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, pieces

ORDER = 5
#: Text bytes of a block, about.
BLOCK_BYTES = 64 << 20
#: Share of a language's left-out trusted documents under its threshold, and the documents a quantile needs.
QUANTILE, LEAST = 0.99, 50
#: One of so many trusted documents is left out of the counts.
LEFT_OUT = 5


def grams(raw: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte its n-gram as a number, the byte last; before a text's start stand zeros."""
    n, pad = np.diff(at), order - 1
    padded = np.zeros(len(raw) + pad * len(n), np.int64)
    where = np.arange(len(raw)) + pad * (1 + np.repeat(np.arange(len(n)), n))
    padded[where] = raw
    out = np.zeros(len(raw), np.int64)
    for j in range(order):
        out = (out << 8) | padded[where - pad + j]
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, inverse = np.unique(keys, return_inverse=True)
    return [(unique, np.bincount(inverse, counts, len(unique)).astype(np.int64))]


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, doc_id, text, ...) sorted by block and kind; kind 0 are trusted ids, kind 1 documents."""
    block, trusted, parts = None, set(), []

    def flush() -> Iterator[pa.RecordBatch]:
        if parts:
            ((keys, counts),) = _merge(parts)
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int32)), pa.array(k), pa.array(counts[i : i + (1 << 16)])], ["block", "gram", "n"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i == j:
                continue
            if blocks[i] != block:
                yield from flush()
                block, trusted, parts = int(blocks[i]), set(), []
            for part, raw, at in pieces(batch.slice(i, j - i), "text"):
                ids, kinds = part.column(2).to_pylist(), part.column(1).to_numpy()
                trusted.update(x for x, kind in zip(ids, kinds, strict=True) if kind == 0)
                if len(raw):
                    g = grams(raw, at)
                    sure = np.repeat(np.array([k == 1 and x in trusted for x, k in zip(ids, kinds, strict=True)]), np.diff(at))
                    keys, inverse = np.unique(g, return_inverse=True)
                    parts.append((keys, np.bincount(inverse[sure], minlength=len(keys)).astype(np.int64)))
            if len(parts) >= 16:
                parts = _merge(parts)
    yield from flush()


def _discounts(table: DataFrame) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams with the counts 1 to 4; absolute ones where these are too few."""
    n = dict.fromkeys(range(1, 5), 0) | {int(r["c"]): r["count"] for r in table.where("c between 1 and 4").groupBy("c").count().collect()}
    if not all(n.values()):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p) for every n-gram of counts (gram, c), those with c = 0 included: p of its last byte after the others."""
    tables = {order: counts.select("gram", "c")}
    for k in range(order - 1, 0, -1):
        # c: how many different bytes stand before the n-gram in trusted text
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        tables[k] = materialize(tables[k + 1].groupBy(shorter).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), "orders")
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(tables[k])
        c = F.col("c")
        discount = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        after = Window.partitionBy("context")  # 256 rows at most
        table = tables[k].withColumn("context", F.shiftright("gram", 8))
        table = table.select("gram", "c", F.sum("c").over(after).alias("total"), F.sum(discount).over(after).alias("spared"), discount.alias("discount"))
        if lower is None:
            table = table.withColumn("q", F.lit(1 / 256))
        else:
            known = lower.select(F.col("gram").alias("short"), F.col("p").alias("q"))
            table = table.join(known, F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("short"))
        p = F.when(F.col("total") > 0, (c - F.col("discount")) / F.greatest("total", F.lit(1)) + F.col("spared") / F.greatest("total", F.lit(1)) * F.col("q")).otherwise(F.col("q"))
        lower = materialize(table.select("gram", p.alias("p")), "probabilities")
    return lower


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, doc_id, text, lang, gram, p, key) sorted by block and kind: kind 0 probabilities, kind 1 documents."""
    block, keys, logs, table = None, [], [], None
    for batch in batches:
        blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        mark = blocks.astype(np.int64) * 2 + kinds
        cuts = np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1, [len(mark)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i == j:
                continue
            if blocks[i] != block:
                block, keys, logs, table = int(blocks[i]), [], [], None
            some = batch.slice(i, j - i)
            if kinds[i] == 0:
                keys.append(some.column(5).to_numpy().copy())
                logs.append(np.log2(some.column(6).to_numpy()))
                continue
            if table is None:
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                order = np.argsort(flat)
                table = flat[order], (np.concatenate(logs) if logs else np.zeros(0))[order]
                keys, logs = [], []
            for part, raw, at in pieces(some, "text"):
                n = np.diff(at)
                unique, inverse = np.unique(grams(raw, at), return_inverse=True)
                value = table[1][np.searchsorted(table[0], unique)] if len(unique) else np.zeros(0)
                sums = np.concatenate([[0.0], np.cumsum(value[inverse])])
                bits = -(sums[at[1:]] - sums[at[:-1]])
                ppl = np.where(n > 0, np.exp2(bits / np.maximum(n, 1)), np.nan)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(7), part.column(4), pa.array(n, pa.int64()), pa.array(ppl, mask=n == 0)], ["doc_id", "key", "lang", "n_bytes", "perplexity"])


def left_out(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("left out")), F.lit(LEFT_OUT)) == 0


def perplexities(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, key (xxhash64 of the text), lang, n_bytes, perplexity (per byte) of every row, and whether it is trusted and
    left_out (trusted, but not counted)."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(16, -(-size // BLOCK_BYTES)))).cast("int").alias("block")
    trusted = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast(kind).alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    first = docs.select(block, F.lit(1).alias("kind"), "doc_id", "text").unionByName(trusted.where(~left_out(F.col("doc_id"))).select(block, F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("string").alias("text")))
    needed = materialize(first.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(lean(_block_grams), "block int, gram long, n long"), "grams")
    counts = materialize(needed.groupBy("gram").agg(F.sum("n").alias("c")), "counts")
    p = probabilities(counts)
    back = needed.select("block", "gram").join(p, "gram")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("doc_id", kind), ("text", "string"), ("lang", "string"))]
    tables = back.select("block", F.lit(0).alias("kind"), *empty, "gram", "p", F.lit(None).cast("long").alias("key"))
    texts = docs.select(block, F.lit(1).alias("kind"), "doc_id", "text", "lang", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("p"), "key")
    summed = texts.unionByName(tables).repartition("block").sortWithinPartitions("block", "kind")
    scored = materialize(summed.mapInArrow(lean(_sum_up), f"doc_id {kind}, key long, lang string, n_bytes long, perplexity double"), "perplexities")
    sure = trusted.select(F.col("doc_id").alias("t_id"))
    return scored.join(sure, F.col("doc_id") == F.col("t_id"), "left").withColumn("trusted", F.col("t_id").isNotNull()).withColumn("left_out", F.col("trusted") & left_out(F.col("doc_id"))).drop("t_id")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> tuple[dict[str | None, float], float]:
    """A threshold for each language with enough left-out documents, and the common one."""
    sure = scored.where("trusted and perplexity is not null")
    unseen = sure.where("left_out")
    at = F.percentile_approx("perplexity", quantile, 10_000).alias("t")
    by = unseen.groupBy("lang").agg(at, F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).collect()  # a row for each language
    common = unseen.agg(at).first()["t"]
    if common is None:
        common = sure.agg(at).first()["t"]
    return {r["lang"]: r["t"] for r in by}, float("inf") if common is None else common


def threshold_of(cuts: dict[str | None, float], common: float, lang: Column) -> Column:
    out = F.lit(common)
    for name, cut in cuts.items():
        out = F.when(lang.eqNullSafe(F.lit(name)), F.lit(cut)).otherwise(out)
    return out


def keep_accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df, all columns, that are not rejected."""
    scored = quality(df, labels, id_col, text, lang)
    rejected = scored.where("not accepted").select(F.col("doc_id").alias("_r_id"), F.col("key").alias("_r_key"))
    on = F.col(id_col).eqNullSafe(F.col("_r_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_r_key"))
    return df.join(rejected, on, "left_anti")


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, key (xxhash64 of the text), lang, n_bytes, perplexity, threshold, accepted for every row."""
    scored = materialize(perplexities(df, labels, id_col, text, lang), "scored")
    cut = threshold_of(*thresholds(scored, quantile), F.col("lang"))
    return scored.select("doc_id", "key", "lang", "n_bytes", "perplexity", cut.alias("threshold"), F.coalesce(F.col("perplexity") <= cut, F.lit(False)).alias("accepted"))
