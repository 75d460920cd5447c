"""Helpers shared by the training-data operators: the shared folder, gapless ranks, and whole texts as numpy bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets over which gapless ranks are counted; fixed, so their table has a known size.
RANK_BUCKETS = 4096

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that goes to a Python worker, at most: with whole texts and sets in them the default would be tens of MB,
#: once in the worker and once in the JVM.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048

#: Bytes of a row group of an intermediate table, which its writer holds.
ROW_GROUP = 16 << 20

#: What separates words: space and the ASCII controls 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# odd 64-bit multipliers of the rolling hashes
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, without a cluster (tests), a local one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="passagework-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/passagework/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, seen: Observation | None = None, *what: Column) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost executors. `seen`
    gets the aggregates `what` of the rows as they are written.

    The shuffle files of the write are removed when it is over, not whenever the driver next collects its garbage.
    """
    spark = df.sparkSession
    schema = df.schema
    df = df if seen is None else df.observe(seen, *what)
    path = new_path(spark, name)
    before = {name: spark.conf.get(name, None) for name in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    rows = int(before[BATCH] or 0)
    spark.conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.schema(schema).parquet(path)
    out._passagework_path = path
    return out


def discard(table: DataFrame) -> None:
    """Removes what materialize() wrote; nothing may be computed from it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._passagework_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all that materialize() has written to the shared folder, for when results have been read or written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/passagework")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gapless_rank(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within equal `by`, in no stated order, without ever gathering a group in one task.

    Rows are dealt by a hash of `order` over RANK_BUCKETS buckets; the counts of the buckets give each its first rank.
    df is read twice, so it should be cheap or materialized.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int"))
    counts = dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_fb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    ranked = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    on = [ranked[c].eqNullSafe(first[f"_k{i}"]) for i, c in enumerate(by)] + [ranked["_b"] == first["_fb"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return ranked.join(first, cond).withColumn(name, (F.col("_r") + F.col("_first")).cast("long")).drop("_b", "_r", "_fb", "_first", *[f"_k{i}" for i in range(len(by))])


#: Bits that tell rows of a table from others before a join, of 32,768 in a row of their table: 4 MB, whatever the tables.
MARKED = 1 << 25


def marked(rows: DataFrame, key: Column, some: DataFrame, some_key: Column) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among those of `some`, and the others, whose key is not: a join with `some` needs to shuffle only the
    first. The keys are equal where these hashes are; a bit for each hash, in a table of fixed size, is broadcast."""
    place = lambda c: F.pmod(c, F.lit(MARKED))
    bit = some.select(place(some_key).alias("p")).groupBy(F.shiftright("p", 15).alias("_m_row")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(1 << 15))).alias("_m_bits"))
    p = F.pmod(place(key), F.lit(1 << 15))
    byte = F.conv(F.hex(F.substring(F.col("_m_bits"), F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1, F.lit(False))
    met = rows.join(F.broadcast(materialize(bit, "bits")), F.shiftright(place(key), 15) == F.col("_m_row"), "left")
    return met.where(found).select(rows.columns), met.where(~found).select(rows.columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings one after another, and the n + 1 offsets; a null counts as an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, "" if kind == pa.large_string() else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of the batch of about `limit` text bytes (one whole row at least) with their bytes and offsets."""
    n = batch.num_rows
    if not n:
        return
    raw, at = buffers(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, after which its worker, which lives on, gives memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        yield from f(batches)
        give_back()

    return run


@cache
def settle() -> None:
    """Once in a worker: what stands now, modules above all, is left out of the search for garbage at each task's end, which would
    take longer than a small task."""
    gc.freeze()


#: What a worker forgets when a task ends, as it lives on for tasks that don't need it.
forget: list[Callable[[], object]] = []


def give_back() -> None:
    """Memory that this process has freed, or need not keep, goes back to the system."""
    import ctypes

    for drop in forget:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


forget.append(lambda: _powers.update({name: row[:1].copy() for name, row in _powers.items()}))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, np.uint64(base & _MASK), np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * base**position over [i, j); times base**-i it is a hash of the bytes alone."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte spans [starts, ends); equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def is_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among `some`, which ascend: without a sort of these for every slice."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the offsets by row of their first words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~IS_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < n)]  # a row's end also ends a word
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)
