"""Arrow-batched functions of one column whose memory doesn't grow with a batch.

A batch has up to 10,000 rows, whole texts among them. As Python objects these and what is made of them are many times their
size, so they are worked on by slices of about SLICE bytes, each of which gives a batch of results: none is kept. After each
batch, so also when a task ends, the worker, which lives on, gives memory back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are Python objects at once, or one row's.
SLICE = 1 << 18


def slices(values: pa.Array, limit: int = SLICE) -> Iterator[pa.Array]:
    """Consecutive rows of strings or bytes, about `limit` bytes at once, one row at least."""
    size = pc.cumulative_sum(pc.add(pc.fill_null(pc.binary_length(values), 0).cast(pa.int64()), 8)).to_numpy()
    i, n = 0, len(values)
    while i < n:
        before = size[i - 1] if i else 0
        j = min(max(i + 1, int(size.searchsorted(before + limit, "right"))), n)
        yield values.slice(i, j - i)
        i = j


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def by_slices(batches: Iterator[pa.Array], f: Callable[[list], list], arrow: pa.DataType) -> Iterator[pa.Array]:
    """f's results, slice by slice."""
    for batch in batches:
        for some in slices(batch):
            yield pa.array(f(some.to_pylist()), arrow)
        give_back()


def in_slices(values: Column, f: Callable[[list], list], kind: str, arrow: pa.DataType) -> Column:
    """f, on lists of values, which gives one result for each; in slices."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_slices(batches, f, arrow)

    return run(values)
