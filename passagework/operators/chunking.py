"""The three chunkers as column expressions that give arrays of chunks.

Fixed-size windows are native expressions. Sentence-aware windows and sentence groups scan text with state, so they are
Arrow-batched functions. Clustering joins groups by their embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig, Semantic, Sliding, Snapping
from ..functions.batches import in_slices
from ..functions.text import WHITE_SPACE, boundary_at_or_after, boundary_at_or_before, once, unicode_trim
from .sentences import groups, sentences_ahead, sentences_before

Embed = Callable[[list[str]], "np.ndarray"]
_CHUNKS = "array<string>", pa.list_(pa.string())


def sliding(text: Column, c: Sliding = Sliding()) -> Column:
    """Byte windows [k size - overlap, (k + 1) size + overlap) of the trimmed text, widened to whole characters."""

    def windows(x: Column) -> Column:
        data, size, ascii_only = x["data"], x["size"], x["ascii"]

        def window(k: Column) -> Column:
            start = F.greatest(k * c.size - c.overlap, F.lit(0))
            end = F.least((k + 1) * c.size + c.overlap, size)
            a = F.when(ascii_only, start).otherwise(boundary_at_or_before(data, start))
            b = F.when(ascii_only, end).otherwise(boundary_at_or_after(data, end, size))
            return F.substring(data, a + 1, b - a).cast("string")

        last = F.floor((size - c.overlap) / c.size).cast("int")
        few = F.when(size == 0, F.array().cast("array<string>")).when(size <= c.size + c.overlap, F.array(data.cast("string")))
        return few.otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window))

    def measured(t: Column) -> Column:
        parts = F.struct(F.encode(t, "UTF-8").alias("data"), F.octet_length(t).alias("size"), (F.octet_length(t) == F.length(t)).alias("ascii"))
        return once(parts, windows)

    return F.when(text.isNotNull(), once(unicode_trim(text), measured))


def snap(text: str, c: Snapping) -> list[str]:
    """Sentence-aware chunks of one text; see Snapping."""
    if not text.strip(WHITE_SPACE):
        return []
    n, ascii_only = len(text), text.isascii()
    out, begin, look = [], 0, 0
    while begin < n:
        hit = text.find(c.delimiter, look)
        if hit < 0 or hit == n - 1:
            before = text[:begin]
            out.append(before[sentences_before(before, c.overlap, c.delimiter, c.skip_f, c.skip_b) :] + text[begin:])
            break
        look = hit + 1
        size = hit - begin if ascii_only else len(text[begin:hit].encode())
        if size < c.size or text[look] not in WHITE_SPACE or any(len(b) <= hit - begin and text.endswith(b, begin, hit) for b in c.skip_b) or any(text.startswith(f, look) for f in c.skip_f):
            continue
        before = text[:begin]
        first = sentences_before(before, c.overlap, c.delimiter, c.skip_f, c.skip_b)
        end = sentences_ahead(text, look, c.overlap, c.delimiter, c.skip_f, c.skip_b)
        out.append(before[first:] + text[begin:end])
        begin = look = end
    return out


def snapping(text: Column, c: Snapping | None = None) -> Column:
    config = c or Snapping()
    return in_slices(text, lambda texts: [None if t is None else snap(t, config) for t in texts], *_CHUNKS)


def sentence_groups(text: Column, size: int = 1, delimiter: str = ".", skip_f: list[str] | None = None, skip_b: list[str] | None = None) -> Column:
    from ..config import SKIP_BACK, SKIP_FORWARD

    forward, back = SKIP_FORWARD if skip_f is None else skip_f, SKIP_BACK if skip_b is None else skip_b

    return in_slices(text, lambda texts: [None if t is None else groups(t, size, delimiter, forward, back) for t in texts], *_CHUNKS)


def similarities(name: str, seeds: np.ndarray, v: np.ndarray, p: int | None = None) -> np.ndarray:
    """The similarity function of v and every seed; NaN where it has none."""
    if name in ("cosine", "angular"):
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = seeds @ v / (np.linalg.norm(seeds, axis=1) * np.linalg.norm(v))
        return cos if name == "cosine" else np.arccos(np.clip(cos, -1, 1)) / np.pi
    if name == "dotProduct":
        return seeds @ v
    gap = np.abs(seeds - v)
    if name == "euclidean":
        return np.sqrt((gap**2).sum(axis=1))
    if name == "manhattan":
        return gap.sum(axis=1)
    if name == "chebyshev":
        return gap.max(axis=1, initial=0)
    return (gap**p).sum(axis=1) ** (1 / p)


def cluster(parts: list[str], vectors: np.ndarray, c: Semantic) -> list[str]:
    """Groups joined to the first cluster (best_match: the best one, of those that are equal to 12 decimals the first) whose
    first group is similar enough; NaN is not. A cosine counts to 12 decimals, so that rounding doesn't decide at the threshold."""
    if not parts:
        return []
    vectors = np.asarray(vectors, np.float64)
    texts, seeds, n = [parts[0]], vectors[:1].copy(), 1  # the first n seeds count; the array doubles
    for i in range(1, len(parts)):
        stripped = parts[i].strip(WHITE_SPACE)
        if not stripped:
            continue
        near = similarities(c.distance, seeds[:n], vectors[i], c.p)
        near = near.round(12) if c.distance == "cosine" else near
        ok = np.flatnonzero(near >= c.threshold)
        if len(ok):
            texts[ok[near[ok].round(12).argmax()] if c.best_match else ok[0]] += parts[i]
        else:
            texts.append(stripped)
            if n == len(seeds):
                seeds = np.concatenate([seeds, np.empty_like(seeds)])
            seeds[n] = vectors[i]
            n += 1
    return texts


def semantic(text: Column, c: Semantic, embed: Embed) -> Column:
    """Semantic chunks; `embed` gives a row of numbers for each of a list of texts and is called once for a slice of a batch."""

    def chunks(texts: list[str | None]) -> list[list[str]]:
        split = [groups(t, c.size, c.delimiter, c.skip_f, c.skip_b) if t else [] for t in texts]
        flat = [p for parts in split for p in parts]
        vectors = np.asarray(embed(flat)) if flat else np.zeros((0, 1))
        out, at = [], 0
        for parts in split:
            out.append(cluster(parts, vectors[at : at + len(parts)], c))
            at += len(parts)
        return out

    return in_slices(text, chunks, *_CHUNKS)


def chunk(text: Column, c: ChunkConfig, embed: Embed | None = None) -> Column:
    if isinstance(c, Sliding):
        return sliding(text, c)
    if isinstance(c, Snapping):
        return snapping(text, c)
    if embed is None:
        raise ValueError("semantic chunking needs an embedder")
    return semantic(text, c, embed)


def chunk_rows(df: DataFrame, c: ChunkConfig, text: str = "text", embed: Embed | None = None) -> DataFrame:
    """A row for each chunk: all columns of df but the text, chunk_idx from 0, chunk."""
    rest = [x for x in df.columns if x != text]
    return df.select(*rest, chunk(F.col(text), c, embed).alias("_chunks")).select(*rest, F.posexplode("_chunks").alias("chunk_idx", "chunk"))


def chunk_by_config(df: DataFrame, configs: list[ChunkConfig], kind: str, text: str = "text", embed: Embed | None = None) -> DataFrame:
    """Chunks of each row by the configuration whose number is in column `kind`; rows without one, or whose chunks are
    empty, come out with a null chunk_idx and an error. One scan, whatever the number of configurations."""
    rest = [x for x in df.columns if x not in (text, kind)]
    known = F.col(kind).isin(list(range(len(configs)))) if configs else F.lit(False)
    own = [chunk(F.when(F.col(kind) == i, F.col(text)), c, embed) for i, c in enumerate(configs)]  # null for the other rows
    chunks = F.coalesce(*own) if own else F.lit(None).cast("array<string>")
    some = df.select(*rest, F.coalesce(known, F.lit(False)).alias("_known"), chunks.alias("_chunks"))
    some = some.select(*rest, "_known", F.posexplode_outer("_chunks").alias("chunk_idx", "chunk"))
    error = F.when(~F.col("_known"), "no chunker").when(F.col("chunk_idx").isNull(), "chunks cannot be empty")
    return some.withColumn("error", error).drop("_known")


def slide(text: str, c: Sliding) -> list[str]:
    """The chunks of sliding() for one text, for SQL functions."""
    data = text.strip(WHITE_SPACE).encode()
    n = len(data)
    if n <= c.size + c.overlap:
        return [data.decode()] if n else []
    inner = np.frombuffer(data + b"\0", np.uint8) & 0xC0 == 0x80  # the end starts a character too
    starts = np.flatnonzero(~inner)
    k = np.arange((n - c.overlap) // c.size + 1)
    first = starts[np.searchsorted(starts, np.maximum(k * c.size - c.overlap, 0), "right") - 1]
    last = starts[np.searchsorted(starts, np.minimum((k + 1) * c.size + c.overlap, n))]
    return [data[i:j].decode() for i, j in zip(first.tolist(), last.tolist(), strict=True)]


def _sum_sql(term: str) -> str:
    return f"aggregate(zip_with(a, b, (x, y) -> {term}), 0D, (s, x) -> s + x)"


_COSINE_SQL = f"try_divide({_sum_sql('x * y')}, sqrt({_sum_sql('x * x')}) * sqrt({_sum_sql('y * y')}))"
#: The similarity functions as one native expression.
_SIMILARITY_SQL = f"""CASE WHEN size(a) <> size(b) THEN NULL
  WHEN name = 'cosine' THEN {_COSINE_SQL} WHEN name = 'dotProduct' THEN {_sum_sql("x * y")}
  WHEN name = 'euclidean' THEN sqrt({_sum_sql("(x - y) * (x - y)")}) WHEN name = 'manhattan' THEN {_sum_sql("abs(x - y)")}
  WHEN name = 'angular' THEN CASE WHEN {_COSINE_SQL} IS NOT NULL THEN acos(least(1D, greatest(-1D, {_COSINE_SQL}))) / pi() END
  WHEN name = 'chebyshev' THEN CASE WHEN a IS NULL OR b IS NULL OR exists(zip_with(a, b, (x, y) -> x - y), x -> x IS NULL) THEN NULL ELSE coalesce(array_max(zip_with(a, b, (x, y) -> abs(x - y))), 0D) END
  WHEN name = 'minkowski' THEN power({_sum_sql("power(abs(x - y), p)")}, 1D / p) END"""


def register(spark) -> None:
    """SQL functions: chunk_sliding and chunk_snapping (text, size, overlap), split_sentences, vector_similarity (name, two
    vectors, and minkowski's power, 3 if it isn't given), and the table function chunks (text, size, overlap) for LATERAL.
    vector_similarity is a native expression."""

    @F.pandas_udf("array<string>")
    def chunk_sliding(texts: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else slide(t, Sliding(int(s), int(o))) for t, s, o in zip(texts, size, overlap, strict=True)])

    @F.pandas_udf("array<string>")
    def chunk_snapping(texts: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else snap(t, Snapping(int(s), int(o))) for t, s, o in zip(texts, size, overlap, strict=True)])

    @F.pandas_udf("array<string>")
    def split_sentences(texts: pd.Series) -> pd.Series:
        from ..config import SKIP_BACK, SKIP_FORWARD

        return texts.map(lambda t: None if t is None else groups(t, 1, ".", SKIP_FORWARD, SKIP_BACK))

    @F.udtf(returnType="chunk_idx int, chunk string")
    class Chunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(snap(text or "", Snapping(size, overlap)))

    for f in (chunk_sliding, chunk_snapping, split_sentences):
        spark.udf.register(f.__name__, f)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_similarity(name STRING, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, p INT DEFAULT 3) RETURNS DOUBLE RETURN {_SIMILARITY_SQL}")
    spark.udtf.register("chunks", Chunks)
